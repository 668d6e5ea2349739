"""Array-valued scoring helpers (L1, L8) for small label sets.

Vocabulary-wide logits must not travel through Spark; these are for short vectors
(the 64-wide fixture) and for checking a scorer's arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def log_sum_exp(z) -> Column:
    a = _c(z)
    m = F.array_max(a)
    return m + F.log(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))


def log_softmax_gather(z, target) -> Column:
    """L1: log-softmax of ``z`` evaluated at 0-based position ``target`` (NULL when out of range)."""
    a = _c(z)
    t = _c(target)
    picked = F.when((t >= 0) & (t < F.size(a)), F.element_at(a, F.greatest(t, F.lit(0)) + F.lit(1)))
    return picked - log_sum_exp(a)


def array_mean(z) -> Column:
    """L8 building block: mean of the entries, NULL for an empty array."""
    a = _c(z)
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x) / F.size(a))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
