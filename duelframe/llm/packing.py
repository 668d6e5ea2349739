"""Packing into length buckets with the least padding (operator 10).

The lengths of all documents are counted into one histogram.  A dynamic program over it
chooses at most ``BUCKETS`` boundaries such that the padding, every document filled up to
the boundary of its bucket, is smallest.  Inside a bucket documents form batches of
``floor(budget / boundary)`` rows (at least one), so that a padded batch stays within the
token budget unless one document alone is longer.

The histogram has one entry for each length up to ``EXACT``, where the padding is the least
that any boundaries give; beyond, an entry covers 1/128 of a power of two and boundaries lie
at the longest length present in an entry.  So it is bounded, and the padding is exact for the
boundaries it can choose.  The cost is convex (of Monge's form), so that the best last boundary
only moves up with the length: each row of the program takes n log n steps.

A bucket may hold any share of all rows, so its rows are dealt by a hash of the id into
groups of about ``GROUP_ROWS`` that are batched independently; each group has at most one
batch that is not full.  Rows without an id, and the rows of an id that alone has more rows than
a group, are dealt by their place in the table as written (see ``pack``); the groups of all other
rows depend on their ids only.

Defined results: null and empty texts have length 0 and are packed like others.  Documents
of equal length and id are ordered arbitrarily, their columns are equal either way.  Empty
table: no rows.  No document is dropped or cut.  Input columns named as a result column are
replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.session import materialize

BUCKETS = 16
TOKEN_BUDGET = 16_384
EXACT = 1 << 16
GROUP_ROWS = 8192

RESULT = ["n_tokens", "bucket", "edge", "padding", "part", "batch", "slot"]


def word_count(text: Column) -> Column:
    """Number of words (runs without blank, tab or line break characters); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _entry(n: Column) -> Column:
    """The histogram entry of a length (see the module text)."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))) - 7).cast("long")
    return F.when(n <= EXACT, n).otherwise(F.ceil(n / step) * step)


def _least(best: np.ndarray, edge: np.ndarray, c: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry j >= 1 the least of ``best[i]`` plus the padding of the entries i + 1 to j
    in one bucket, over all i < j, and the first such i; by divide and conquer, level by level."""
    h = len(edge)
    value, first = np.full(h, np.iinfo(np.int64).max), np.full(h, -1, dtype=np.int64)
    # ranges of j (lo to hi), whose first best i lies from a to b
    lo, hi, a, b = (np.array([x], dtype=np.int64) for x in (1, h - 1, 0, h - 2))
    while len(lo):
        mid = (lo + hi) // 2
        n = np.minimum(b, mid - 1) - a + 1
        at = np.concatenate([[0], np.cumsum(n)])
        i = np.arange(at[-1]) - np.repeat(at[:-1] - a, n)
        j = np.repeat(mid, n)
        cost = best[i] + edge[j] * (c[j + 1] - c[i + 1]) - (s[j + 1] - s[i + 1])
        value[mid] = np.minimum.reduceat(cost, at[:-1])
        hits = np.flatnonzero(cost == np.repeat(value[mid], n))
        first[mid] = i[hits[np.searchsorted(hits, at[:-1])]]
        left, right = lo < mid, mid < hi
        lo, hi, a, b = (np.concatenate(x) for x in ((lo[left], mid[right] + 1), (mid[left] - 1, hi[right]),
                                                    (a[left], first[mid[right]]), (first[mid[left]], b[right])))
    return value, first


def optimal_edges(lengths: np.ndarray, counts: np.ndarray, sums: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Boundaries with the least padding: ``lengths`` ascending, ``counts`` and ``sums`` (of
    lengths) of each histogram entry.  Of equal choices, fewer buckets win, then lower edges."""
    h = len(lengths)
    if not h:
        return []
    c = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    s = np.concatenate([[0], np.cumsum(sums)]).astype(np.int64)
    edge = lengths.astype(np.int64)
    best = edge * c[1:] - s[1:]                       # one bucket for the first j entries
    choice = [np.zeros(h, dtype=np.int64)]
    totals = [best[-1]]
    for _ in range(1, min(buckets, h)):
        value, first = _least(best, edge, c, s)
        back = np.where(value < best, first, -1)
        best = np.minimum(value, best)
        choice.append(back)
        totals.append(best[-1])
    k = int(np.argmin(totals))
    edges, j = [], h - 1
    while True:
        edges.append(int(edge[j]))
        while k > 0 and choice[k][j] < 0:              # no gain from one more bucket here
            k -= 1
        if k == 0:
            break
        j = int(choice[k][j])
        k -= 1
    return edges[::-1]


def pack(docs: DataFrame, length: Column, id_col: str = "doc_id", buckets: int = BUCKETS,
         budget: int = TOKEN_BUDGET, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``docs`` with length, bucket and its boundary, padding, and the place in a batch:
    batch ``(bucket, part, batch)`` holds slots 0, 1, ...

    The rows are written once with their lengths and places: each text is counted once, and a
    place stays the same if an executor is lost.  Callers select the columns that they carry."""
    taken = {n.lower() for n in RESULT}
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken]
    rows = materialize(docs.select(*rest, F.coalesce(length.cast("long"), F.lit(0)).alias("n_tokens"),
                                   F.monotonically_increasing_id().alias("_llm_place")), "packing-rows")
    hist = (rows.groupBy("n_tokens").agg(F.count("*").alias("c"))
            .groupBy(_entry(F.col("n_tokens")).alias("e"))
            .agg(F.max("n_tokens").alias("top"), F.sum("c").alias("c"), F.sum(F.col("c") * F.col("n_tokens")).alias("s"))
            .orderBy("e").toPandas())
    edges = optimal_edges(hist["top"].to_numpy(), hist["c"].to_numpy(), hist["s"].to_numpy(), buckets) or [0]
    held = np.bincount(np.searchsorted(edges, hist["top"].to_numpy()), weights=hist["c"].to_numpy(), minlength=len(edges))
    parts = [max(1, int(round(x / group_rows))) for x in held]
    fit = [max(1, budget // max(1, e)) for e in edges]

    def pick(values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("bucket") + 1)

    n = F.col("n_tokens")
    bucket = sum((F.when(n > e, 1).otherwise(0) for e in edges[:-1]), F.lit(0))
    ids = rows.groupBy(F.col(f"`{id_col}`").alias("_llm_id")).agg(F.count("*").alias("_llm_n"))
    heavy = ids.where(F.col("_llm_n") > group_rows)        # at most one of group_rows rows
    rows = rows.join(heavy, F.col(f"`{id_col}`") == F.col("_llm_id"), "left")
    by_place = F.col(f"`{id_col}`").isNull() | F.col("_llm_id").isNotNull()
    spread = F.xxhash64(F.when(by_place, F.concat_ws(":", F.lit("place"), F.col("_llm_place").cast("string")))
                        .otherwise(F.col(f"`{id_col}`").cast("string")))
    rows = (rows.withColumn("bucket", bucket.cast("int"))
            .withColumn("edge", pick(edges).cast("long"))
            .withColumn("padding", F.col("edge") - n)
            .withColumn("part", F.pmod(spread, pick(parts).cast("long")).cast("int")))
    order = Window.partitionBy("bucket", "part").orderBy("n_tokens", F.col(f"`{id_col}`"), "_llm_place")
    at = F.row_number().over(order) - 1
    return (rows.withColumn("_at", at)
            .withColumn("batch", F.floor(F.col("_at") / pick(fit)).cast("int"))
            .withColumn("slot", F.pmod(F.col("_at"), pick(fit)).cast("int"))
            .select(*rest, *RESULT))
