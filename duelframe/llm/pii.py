"""Personal data by anchor expansion (operator 9).

One Aho-Corasick pass finds anchors: at-signs, plus signs and dots before a digit, pairs of
digits (alone, or with a blank or hyphen between), URL schemes and identifier cues.  Around
each anchor a deterministic local parser expands to both sides as far as its grammar's
characters reach, and validates what it finds (parts of an address, Luhn and mod-97 check
digits, digit counts).  Text without anchors is never parsed.

Base kinds, leftmost and non-overlapping for each kind, positions in code points, end
exclusive: ``email``, ``ip``, ``card``, ``phone``; a match that fails its validation is
dropped and not retried.  The method adds ``iban`` (country, check digits and account
after the cue ``IBAN``, mod 97 = 1; it ends at the country's length, else where the longest
expansion ends or, of a country without a known length, at the last possible end before
another character than a capital letter or digit), ``login`` (user and password inside a URL) and
``account`` (6 to 20 digits, single blanks or hyphens between, after an account cue).

Defined results: null text is empty and has no spans.  Empty table: no rows.  Rows are
scanned independently, repeated rows alike; input columns named as a result column are
replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import with_struct

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "login", "account")
KINDS = BASE + ADDED

# Characters of the base grammars.
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[:\x20]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
_IBAN_END = re.compile(r"[A-Z0-9](?![A-Z0-9])")
_IBAN_LENGTHS = {c: int(n) for c, n in (x.split(":") for x in (
    "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BI:27 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DJ:27 DK:18 DO:28 "
    "EE:20 EG:29 ES:24 FI:18 FK:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HN:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 "
    "IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MN:20 MR:27 MT:31 MU:30 NI:28 "
    "NL:18 NO:15 OM:23 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 RU:33 SA:24 SC:31 SD:18 SE:24 SI:19 SK:24 SM:27 SO:23 ST:25 "
    "SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20 YE:30").split())}
_LOGIN = re.compile(r"([^\s/@:?#]++:[^\s/@?#]++)@[A-Za-z0-9]")
_ACCOUNT = re.compile(r"(?:\x20(?:number|no\.?|nr\.?|num\.?))?\x20?[:#]?\x20?([0-9](?:[\x20-]?[0-9]){5,19})(?![0-9])", re.IGNORECASE)
_SCHEMES = ("http://", "https://", "ftp://", "ssh://")
_ACCOUNT_CUES = ("account", "acct", "konto", "cuenta", "compte")


def _anchors() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", "email")
    for d in "0123456789":
        a.add_word("+" + d, "phone")
        a.add_word("." + d, "ip")
        for e in "0123456789":
            for sep in ("", " ", "-"):
                a.add_word(d + sep + e, "card")
    for s in _SCHEMES:
        a.add_word(s, "login")
    a.add_word("iban", "iban")
    a.add_word("IBAN", "iban")
    for c in _ACCOUNT_CUES:
        a.add_word(c, "account")
        a.add_word(c.capitalize(), "account")
        a.add_word(c.upper(), "account")
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _iban(text: str, at: int) -> tuple[int, int] | None:
    """The account after a cue that ends at ``at``."""
    m = _IBAN.match(text, at)
    if not m:
        return None
    start = m.start(1)
    # (end, characters) of each possible account, the longest first
    ends = [(e, n) for e in (x.end() for x in _IBAN_END.finditer(text, start, m.end(1) + 1))
            if e <= m.end(1) and (n := e - start - text.count(" ", start, e)) >= 15][::-1]
    length = _IBAN_LENGTHS.get(text[start:start + 2])
    if length is not None:
        ends = [x for x in ends if x[1] == length] + ends[:1]
    return next(((start, e) for e, _ in ends if mod97(text[start:e].replace(" ", ""))), None)


def _digits(text: str, start: int, end: int) -> str:
    return "".join(c for c in text[start:end] if c in _DIGITS)


def _left(text: str, at: int, least: int, allowed: frozenset) -> int:
    """The leftmost start >= least such that text[start:at] has allowed characters only."""
    while at > least and text[at - 1] in allowed:
        at -= 1
    return at


def find(text: str | None, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans, by kind as listed, then start."""
    if not text:
        return []
    spans: dict[str, list[tuple[str, int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)             # where the last match of each kind ended, valid or not
    for last, kind in anchors.iter(text):
        if last < done[kind]:
            continue
        if kind == "card":
            # the automaton meets the first two digits of a run first, so the run starts there
            at = last if text[last - 1] in _DIGITS else last - 1
            at -= 1
            if at < done["card"]:
                continue
            m = _CARD.match(text, at)
            done["card"] = m.end()
            d = _digits(text, at, m.end())
            if 13 <= len(d) <= 19 and luhn(d):
                spans["card"].append(("card", at, m.end()))
        elif kind == "ip":
            at = _left(text, last - 1, done["ip"], _DIGITS)
            m = _IP.match(text, at) if at < last - 1 else None
            if m:
                done["ip"] = m.end()
                if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
                    spans["ip"].append(("ip", at, m.end()))
        elif kind == "phone":
            m = _PHONE.match(text, last - 1)
            if m:
                done["phone"] = m.end()
                if 9 <= len(_digits(text, m.start(), m.end())) <= 15:
                    spans["phone"].append(("phone", m.start(), m.end()))
        elif kind == "email":
            at = _left(text, last, done["email"], _LOCAL)
            m = _DOMAIN.match(text, last + 1) if at < last else None
            if m:
                done["email"] = m.end()
                spans["email"].append(("email", at, m.end()))
        elif kind == "iban":
            found = _iban(text, last + 1)
            if found:
                done["iban"] = found[1]
                spans["iban"].append(("iban", *found))
        elif kind == "login":
            m = _LOGIN.match(text, last + 1)
            if m:
                done["login"] = m.end()
                spans["login"].append(("login", m.start(1), m.end(1)))
        else:
            m = _ACCOUNT.match(text, last + 1)
            if m:
                done["account"] = m.end()
                spans["account"].append(("account", m.start(1), m.end(1)))
    return [s for k in KINDS for s in spans[k]]


RESULT = [f"n_{k}" for k in KINDS] + ["base_sha256", "spans"]


def scanner(kinds: tuple[str, ...] = KINDS) -> Callable[[Column], Column]:
    """A Column function: text -> struct of the fields in ``RESULT``."""
    def name(spans):
        return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)

    fields = ", ".join([f"n_{k} long" for k in KINDS] + ["base_sha256 string", "spans string"])

    @F.arrow_udf(fields)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        anchors = _anchors()
        for texts in batches:
            cols: list[list] = [[] for _ in RESULT]
            for t in texts.to_pylist():
                spans = [s for s in find(t, anchors) if s[0] in kinds]
                row = [sum(s[0] == k for s in spans) for k in KINDS]
                base = name([s for s in spans if s[0] in BASE])
                row += [hashlib.sha256(base.encode()).hexdigest(), name(spans)]
                for c, v in zip(cols, row):
                    c.append(v)
            types = [pa.int64()] * len(KINDS) + [pa.string()] * 2
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], names=RESULT)

    return run


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the number of spans of each kind, the base spans' digest and all spans."""
    return with_struct(docs, scanner()(F.col(text_col)), RESULT)
