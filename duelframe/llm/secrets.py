"""Secret scan: key patterns and a randomness test battery (operator 5).

Base kinds, leftmost and non-overlapping for each kind, positions in code points, end
exclusive: ``assign`` (a key word, a sign, a value of 12 or more characters), ``access``
(AKIA and capitals or digits, 18 or more) and ``hex`` (16 or more lower-case hex digits).

The method adds kind ``random``: runs of 20 or more characters of ``[A-Za-z0-9+/_-]``, with
their ``=`` padding, that hold a letter.  A ``=`` before such a character is a sign between a
name and its value and ends a run; of a run that meets base spans the rests around them are
runs of their own.  For the encoding that a run's characters fit (hex,
base 32, base 64) three tests ask whether it looks uniformly random: chi-squared of the
alphabet's use (with as many cells as the length allows), Wald-Wolfowitz runs about the
alphabet's middle, and serial correlation of neighbours.  A run that any test rejects at
``ALPHA`` / 3 is ordinary.

Short runs pass such tests too easily, so passing is not enough: against the null
hypothesis of ordinary text (the corpus's own character frequencies, counted over all
documents) each run has the p-value ``1 / likelihood ratio`` of uniform to text, and for
each length class the Benjamini-Hochberg rule over all runs of that class in the corpus
sets the level at which the expected share of false discoveries is ``FDR``.

Defined results: null text is empty and has no spans.  Empty table: no rows.  Rows are
scanned independently, repeated rows alike; input columns named as a result column are
replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.llm.common import utf8_buffers, with_struct

KINDS = ("assign", "access", "hex", "random")
ALPHA = 0.01
FDR = 0.01
MIN_RUN = 20
BIN = 0.1                     # width of the histogram of -log10 p
TOP = 100.0
LENGTH_CLASSES = (24, 32, 40, 48, 64, 96, 128, 256, 1024)   # upper bounds; longer runs are one class

# The patterns of the base kinds.
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}(?:=+(?![A-Za-z0-9+/_=-]))?" % (MIN_RUN - 4))   # the length is tested with the padding
_CUES = ("password", "passwd", "secret", "token", "api_key", "apikey", "akia")

_ENCODINGS = tuple((re.compile(pattern + r"=*"), alphabet) for pattern, alphabet in (
    (r"[0-9a-f]+", "0123456789abcdef"),
    (r"[0-9A-F]+", "0123456789ABCDEF"),
    (r"[A-Z2-7]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    (r"[A-Za-z0-9+/_-]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
))


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for cue in _CUES:
        a.add_word(cue, cue)
    a.make_automaton()
    return a


_LOWER = {c: c + 32 for c in range(65, 91)}


def base_spans(text: str, cues: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by kind and start."""
    low = text.lower()
    if len(low) != len(text):                  # some letters change length: fold ASCII only
        low = text.translate(_LOWER)
    assign, access, end = [], [], {"assign": 0, "access": 0}
    for last, cue in cues.iter(low):
        at = last + 1 - len(cue)
        kind, pattern = ("access", _ACCESS) if cue == "akia" else ("assign", _ASSIGN)
        if at < end[kind]:
            continue
        m = pattern.match(text, at)
        if m:
            end[kind] = m.end()
            if kind == "access":
                access.append((kind, at, m.end()))
            elif len(m[1]) >= 12:
                assign.append((kind, at, m.end()))
    return assign + access + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def _chi2_tail(x: float, dof: int) -> float:
    """Upper tail of the chi-squared distribution (Wilson and Hilferty's normal form)."""
    z = ((x / dof) ** (1 / 3) - (1 - 2 / (9 * dof))) / math.sqrt(2 / (9 * dof))
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str) -> tuple[str, float, float, float] | None:
    """(alphabet, p of chi-squared, p of runs, p of serial correlation) of a token under its
    inferred encoding; None if it has none or too few symbols."""
    for pattern, alphabet in _ENCODINGS:
        if pattern.fullmatch(token):
            break
    else:
        return None
    place = {c: i for i, c in enumerate(alphabet)} | ({"-": 62, "_": 63} if len(alphabet) == 64 else {})
    v = np.array([place[c] for c in token.rstrip("=")], dtype=float)
    n, m = len(v), len(alphabet)
    if n < MIN_RUN - 4:
        return None
    cells = max(2, min(m, n // 5))
    counts = np.bincount((v * cells / m).astype(int), minlength=cells)
    share = np.bincount((np.arange(m) * cells / m).astype(int), minlength=cells) / m
    p_chi = _chi2_tail(float((((counts - n * share) ** 2) / (n * share)).sum()), cells - 1)
    high = v >= m / 2
    a, b = int(high.sum()), int(n - high.sum())
    if not a or not b:
        p_runs = 2.0 ** (1 - n)
    else:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * a * b / n
        var = max(1e-9, (mean - 1) * (mean - 2) / (n - 1))
        p_runs = math.erfc(abs(runs - mean) / math.sqrt(2 * var))
    d = v - v.mean()
    total = float((d * d).sum())
    r = float((d[1:] * d[:-1]).sum()) / total if total else 1.0
    p_serial = math.erfc(abs(r + 1 / n) * math.sqrt(n / 2))
    return alphabet, p_chi, p_runs, p_serial


def length_class(n: int) -> int:
    return int(np.searchsorted(LENGTH_CLASSES, n))


def _rests(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of what ``spans`` leave of each run."""
    taken, k = sorted((a, b) for _, a, b in spans), 0
    at = 0                                     # the end of the spans passed so far
    for m in _RUN.finditer(text):
        s, e = m.span()
        while k < len(taken) and taken[k][0] < e:
            if taken[k][0] > max(s, at):
                yield max(s, at), taken[k][0]
            at, k = max(at, taken[k][1]), k + 1
        if at < e:
            yield max(s, at), e


def random_runs(text: str, log_text: np.ndarray, spans: list[tuple[str, int, int]]):
    """(start, end, length class, evidence, passed) of each tested run outside ``spans``:
    evidence is -log10 p against ordinary text, passed the battery's verdict."""
    for s, e in _rests(text, spans):
        token = text[s:e]
        if len(token) < MIN_RUN:
            continue
        tested = battery(token) if any(c.isalpha() for c in token) else None
        if tested is None:
            continue
        body = np.frombuffer(token.rstrip("=").encode(), np.uint8)
        evidence = (-len(body) * math.log(len(tested[0])) - float(log_text[body].sum())) / math.log(10)
        yield s, e, length_class(len(body)), evidence, min(tested[1:]) >= ALPHA / 3


@dataclass
class SecretModel:
    log_text: list[float]     # natural log of each ASCII character's share of the corpus
    level: list[float]        # evidence a run needs, for each length class


def fit(docs: DataFrame, text_col: str = "text", fdr: float = FDR) -> SecretModel:
    """Character frequencies and levels of evidence over all texts of ``docs``; what comes to
    the driver is bounded (128 counts; a histogram of length classes by evidence)."""
    texts = docs.select(F.col(text_col).alias("text"))

    def characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, dtype=np.int64)
        for b in batches:
            total += np.bincount(utf8_buffers(b.column(0))[0], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(128)), pa.array(total[:128])], names=["c", "n"])

    share = np.ones(128)
    for r in texts.mapInArrow(characters, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect():
        share[r["c"]] += r["n"]
    log_text = np.log(share / share.sum())

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cues = _automaton()
        for b in batches:
            cls, bins = [], []
            for t in b.column(0).to_pylist():
                if t and _RUN.search(t):
                    for _, _, k, x, passed in random_runs(t, log_text, base_spans(t, cues)):
                        cls.append(k)
                        bins.append(math.floor(min(max(x, 0.0), TOP) / BIN) if passed else 0)
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int32()), pa.array(bins, pa.int32())], names=["cls", "bin"])

    level = [math.inf] * (len(LENGTH_CLASSES) + 1)
    counts: dict[int, dict[int, int]] = {}
    for r in texts.mapInArrow(evidence, "cls int, bin int").groupBy("cls", "bin").agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["cls"], {})[r["bin"]] = r["n"]
    for cls, by_bin in counts.items():
        tested, found = sum(by_bin.values()), 0
        for k in sorted((k for k in by_bin if k > 0), reverse=True):
            found += by_bin[k]
            if tested * 10 ** (-k * BIN) <= fdr * found:
                level[cls] = k * BIN
    return SecretModel(log_text.tolist(), level)


def find(text: str | None, model: SecretModel, cues: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind."""
    if not text:
        return []
    spans = base_spans(text, cues)
    log_text = np.asarray(model.log_text)
    spans += [("random", s, e) for s, e, cls, x, passed in random_runs(text, log_text, spans)
              if passed and math.floor(min(max(x, 0.0), TOP) / BIN) * BIN >= model.level[cls]]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


RESULT = ["n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans", "redacted"]
MASK = "[SECRET]"


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with every span's secret (of an assignment: its value) replaced by ``MASK``."""
    if not spans:
        return text
    cuts = []
    for kind, s, e in spans:
        if kind == "assign":
            s = _ASSIGN.match(text, s).start(1)
        if cuts and s < cuts[-1][1]:
            cuts[-1][1] = max(cuts[-1][1], e)
        else:
            cuts.append([s, e])
    cuts.sort()
    out, at = [], 0
    for s, e in cuts:
        if s >= at:
            out += [text[at:s], MASK]
        at = max(at, e)
    return "".join(out) + text[at:]


def scanner(spark: SparkSession, model: SecretModel, with_text: bool = False):
    """A Column function: text -> struct of the fields in ``RESULT`` (``redacted`` is null
    unless ``with_text``)."""
    def name(spans):
        return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)

    @F.arrow_udf("n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string, redacted string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cues = _automaton()
        for texts in batches:
            cols: list[list] = [[] for _ in RESULT]
            for t in texts.to_pylist():
                spans = find(t, model, cues)
                base = [s for s in spans if s[0] != "random"]
                row = [sum(s[0] == k for s in spans) for k in KINDS]
                row += [hashlib.sha256(name(base).encode()).hexdigest(), name(spans),
                        redact(t, spans) if with_text else None]
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 3
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=RESULT)

    return run


def scan(docs: DataFrame, model: SecretModel, text_col: str = "text") -> DataFrame:
    """``docs`` with counts, digest, spans and the redacted text."""
    return with_struct(docs, scanner(docs.sparkSession, model, True)(F.col(text_col)), RESULT)
