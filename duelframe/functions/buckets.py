"""Length buckets (A6) compiled from an edge list into a CASE WHEN chain."""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_edges(spec: str | Iterable[int]) -> list[int]:
    """Boundaries of adjacent buckets: whole numbers in rising order, two at least.

    A string lists them between commas; empty places are skipped.
    """
    given = re.split(r"\s*,\s*", spec.strip()) if isinstance(spec, str) else list(spec)
    wrong = [x for x in given if not re.fullmatch(r"[+-]?\d*", str(x))]
    if wrong:
        raise ValueError(f"not a whole number: {wrong[0]!r}")
    edges = [int(x) for x in given if x != ""]
    if any(a >= b for a, b in pairwise(edges)):
        raise ValueError("boundaries must rise")
    if not edges[1:]:
        raise ValueError("one bucket needs two boundaries")
    return edges


def bucket_id(x, edges: list[int], mode: str = "underflow") -> Column:
    """Half-open buckets [e_i, e_{i+1}).

    mode='reference': anything outside every bucket goes to the last bucket, including
    values below the first edge.  mode='underflow': values below the first edge get -1
    and values at or above the last edge go to the last bucket.
    """
    col = F.col(x) if isinstance(x, str) else x
    last = len(edges) - 2
    expr = None
    for i in range(len(edges) - 1):
        cond = (col >= F.lit(edges[i])) & (col < F.lit(edges[i + 1]))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    if mode == "underflow":
        expr = expr.when(col < F.lit(edges[0]), F.lit(-1))
    elif mode != "reference":
        raise ValueError("mode must be 'reference' or 'underflow'")
    return F.when(col.isNull(), F.lit(None).cast("int")).otherwise(expr.otherwise(F.lit(last)))


def bucket_label(bid, edges: list[int]) -> Column:
    """'[lo,hi)' for bucket ids, '(-inf,e0)' for the underflow bucket."""
    col = F.col(bid) if isinstance(bid, str) else bid
    expr = F.when(col == F.lit(-1), F.lit(f"(-inf,{edges[0]})"))
    for i in range(len(edges) - 1):
        expr = expr.when(col == F.lit(i), F.lit(f"[{edges[i]},{edges[i + 1]})"))
    return expr
