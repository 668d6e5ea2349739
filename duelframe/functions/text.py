"""Token, length and string helpers (T1-T7, G3) as Column expressions.

Tokens are whitespace-separated words; every function works on whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = r"\s+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text, pattern: str = WHITESPACE) -> Column:
    """Split on a separator pattern and drop empty pieces (leading/trailing separators).

    ``array_remove`` keeps this inside generated code (no lambda evaluation per token).
    """
    return F.array_remove(F.split(F.coalesce(_c(text), F.lit("")), pattern), "")


def truncate_prompt(toks, n: int | None, keep: str = "end") -> Column:
    """Keep at most n tokens (None: all); 'end' keeps the last n, 'start' the first n."""
    t = _c(toks)
    if n is None:
        return t
    if keep == "start":
        return F.slice(t, F.lit(1), F.lit(int(n)))
    if keep != "end":
        raise ValueError("keep must be 'start' or 'end'")
    return F.slice(t, F.greatest(F.size(t) - F.lit(int(n)) + F.lit(1), F.lit(1)), F.lit(int(n)))


def truncate_answer(answer_toks, prompt_len, max_length: int | None, keep: str = "start") -> Column:
    """Cut the answer so that prompt + answer fits max_length (None: whole)."""
    a = _c(answer_toks)
    if max_length is None:
        return a
    budget = F.greatest(F.lit(int(max_length)) - _c(prompt_len), F.lit(0))
    if keep == "start":
        return F.slice(a, F.lit(1), budget)
    if keep != "end":
        raise ValueError("keep must be 'start' or 'end'")
    return F.slice(a, F.greatest(F.size(a) - budget + F.lit(1), F.lit(1)), budget)


def nonpad_len(ids, pad) -> Column:
    """T5: number of entries different from the pad value."""
    p = pad if isinstance(pad, Column) else F.lit(pad)
    return F.size(F.filter(_c(ids), lambda x: ~(x.eqNullSafe(p))))


def char_len(text) -> Column:
    """Length in code points."""
    return F.length(_c(text))


def preview(text, n: int) -> Column:
    """First n code points."""
    return F.substring(_c(text), 1, int(n))


def strip_ws(text) -> Column:
    """Leading and trailing whitespace removed (newlines included, unlike trim)."""
    return F.regexp_replace(F.regexp_replace(_c(text), r"^\s+", ""), r"\s+$", "")


def answer_after_prompt(text, prompt) -> tuple[Column, Column]:
    """Text after the FIRST occurrence of prompt, stripped; the whole text when absent.

    Returns (answer, matched).  An empty prompt counts as not matched.
    """
    t, p = _c(text), _c(prompt)
    pos = F.when(F.length(p) > 0, F.position(p, t)).otherwise(F.lit(0))
    rest = F.call_function("substr", t, pos + F.length(p))
    answer = strip_ws(F.when(pos > 0, rest).otherwise(t))
    return answer, pos > 0
