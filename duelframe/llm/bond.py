"""Hard-negative mining by a vertical scan with branch and bound (operator 11).

Vectors become integers, ``floor(scale * x)``.  Rows are dealt by a hash of their place into
shards of about ``SHARD_ROWS``.  A shard is one row that holds its vectors by column (one
run of values per dimension) with the least and the greatest value of every dimension.

An anchor reads a shard's columns in descending magnitude of its own components, ``STEP``
columns at a time, and adds them to the partial scores of the candidates that are left.  What
the unread columns can still add lies between the sums of their least and greatest
contributions; so each candidate has a lower and an upper bound, and the bitmap of candidates
shrinks to those whose bounds still meet a window of the anchor.  A window is a range of
scores of which the ``k`` highest are wanted; its lower end rises to the k-th best lower bound
of candidates that lie in it for certain.  After the last column partial scores are exact.

There are two searches.  The first has one open window an anchor, over rows of its label, and
gives the positives.  The second has one window per positive, over rows of other labels: scores
``s`` with ``low * positive <= 100 * s <= high * positive``.

The k-th score is shared between shards in rounds: a block of anchors meets one shard, then up
to ``ROUND`` shards, then ``ROUND`` times as many, and starts each round with the k-th scores
of all rounds before it.  So the hits written grow with the logarithm of the number of shards.
Equal scores pass a k-th score, and ties are settled by id at the end.

Defined results: rows whose label or vector is null, or whose vector holds a null, NaN or
infinite component, take no part.  A row is told from others by its place, not by its id: rows
that repeat an id are candidates for each other, and each anchor row has its own result rows.
A null id is no anchor unless ``is_anchor`` says so; as a candidate it follows all ids among
equal scores.  Vectors of different lengths are compared as if filled up with zeros.  An anchor
without positives, or a positive whose window is empty (any negative score), has no rows.
Components so large that sums would not be exact are an error.  Empty table: no rows.  Other
columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.llm.topk import LARGEST, quantised
from duelframe.session import materialize

SCALE = 256.0
SHARD_ROWS = 8192
BLOCK = 256                  # anchors that meet a shard together
STEP = 8                     # columns between two looks at the bounds
ROUND = 8
LAST = np.iinfo(np.int64).max

_SHARD = "shard int, row binary, id binary, known binary, label binary, columns binary, least binary, greatest binary"
_HIT = "row long, window int, id long, score long"


def dense(column: pa.Array, dim: int) -> np.ndarray:
    """A list array as a matrix of ``dim`` columns, short lists filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), dim))
    ends = np.asarray(column.offsets, dtype=np.int64)
    n = np.diff(ends)
    flat = column.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]]
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], n)] = flat
    return out


def scan(anchor: np.ndarray, columns: np.ndarray, least: np.ndarray, greatest: np.ndarray, alive: np.ndarray,
         low: np.ndarray, high: np.ndarray, floor: np.ndarray, k: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """The rows of a shard that can be among the ``k`` highest scores of a window [low, high]
    given the scores ``floor`` that are reached already, their exact scores, and the number of
    products computed.  ``alive`` is the bitmap of candidates."""
    order = np.argsort(-np.abs(anchor), kind="stable")
    a = anchor[order]
    ends = np.stack([a * least[order], a * greatest[order]])
    rest_low = np.concatenate([np.cumsum(ends.min(axis=0)[::-1])[::-1], [0.0]])     # of columns from here on
    rest_high = np.concatenate([np.cumsum(ends.max(axis=0)[::-1])[::-1], [0.0]])
    bar = np.maximum(low, floor)
    rows = np.flatnonzero(alive)
    partial, work = np.zeros(len(rows)), 0
    for at in range(0, len(a), step):
        if not len(rows) or not a[at]:
            break                                        # columns of weight 0 add nothing
        to = min(at + step, len(a))
        partial = partial + a[at:to] @ columns[order[at:to, None], rows]
        work += (to - at) * len(rows)
        down, up = partial + rest_low[to], partial + rest_high[to]
        keep = np.zeros(len(rows), dtype=bool)
        for w in range(len(bar)):
            if len(rows) > k:
                sure = down[(down >= low[w]) & (up <= high[w])]
                if len(sure) >= k:
                    bar[w] = max(bar[w], np.partition(sure, len(sure) - k)[len(sure) - k])
            keep |= (up >= bar[w]) & (down <= high[w])
        if not keep.all():
            rows, partial = rows[keep], partial[keep]
    return rows, partial, work


def _shards(rows: DataFrame, shards: int, dim: int, top: int) -> DataFrame:
    kind = np.int16 if top < 2 ** 15 else np.int32

    def build(t: pa.Table) -> pa.Table:
        m = dense(t.column("v"), dim)
        known = t.column("id").is_valid().to_numpy()
        parts = [t.column("row").to_numpy().astype(np.int64), t.column("id").fill_null(LAST).to_numpy().astype(np.int64),
                 known, t.column("label").to_numpy().astype(np.int64), np.ascontiguousarray(m.T.astype(kind)),
                 m.min(axis=0), m.max(axis=0)]
        return pa.table([pa.array([t.column("shard")[0].as_py()], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]],
                        names=["shard", "row", "id", "known", "label", "columns", "least", "greatest"])

    dealt = rows.select(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), "row", "id", "label", "v")
    return materialize(dealt.groupBy("shard").applyInArrow(build, _SHARD), "bond-shards")


def _meet(dim: int, top: int, k: int, same: bool):
    kind = np.int16 if top < 2 ** 15 else np.int32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                row, ids, labels = (np.frombuffer(r[c], np.int64) for c in ("row", "id", "label"))
                known = np.frombuffer(r["known"], bool)
                columns = np.frombuffer(r["columns"], kind).reshape(dim, len(row)).astype(float)
                least, greatest = np.frombuffer(r["least"]), np.frombuffer(r["greatest"])
                own, own_label = np.frombuffer(r["a_row"], np.int64), np.frombuffer(r["a_label"], np.int64)
                q = np.frombuffer(r["a_v"]).reshape(len(own), dim)
                low, high, floor = (np.frombuffer(r[c]).reshape(len(own), -1) for c in ("low", "high", "floor"))
                found: list[tuple[int, int, np.ndarray, np.ndarray]] = []
                for i in range(len(own)):
                    on = np.flatnonzero(low[i] <= high[i])           # windows that hold a score at all
                    alive = (labels == own_label[i]) if same else (labels != own_label[i])
                    alive &= row != own[i]
                    if not len(on):
                        continue
                    hit, score, _ = scan(q[i], columns, least, greatest, alive, low[i, on], high[i, on], floor[i, on], k)
                    for w in on:
                        fits = np.flatnonzero((score >= max(low[i, w], floor[i, w])) & (score <= high[i, w]))
                        h = hit[fits]
                        first = np.lexsort((ids[h], ~known[h], -score[fits]))[:k]
                        found.append((i, w, h[first], score[fits][first]))
                sizes = [len(h) for _, _, h, _ in found]
                h = np.concatenate([h for _, _, h, _ in found] or [np.zeros(0, np.int64)])
                s = np.concatenate([s for _, _, _, s in found] or [np.zeros(0)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([own[i] for i, _, _, _ in found], sizes).astype(np.int64)),
                     pa.array(np.repeat([w for _, w, _, _ in found], sizes).astype(np.int32)),
                     pa.array(ids[h], mask=~known[h]), pa.array(s.astype(np.int64))],
                    names=["row", "window", "id", "score"])
    return run


def _search(anchors: DataFrame, trees: DataFrame, shards: int, dim: int, top: int, k: int, same: bool) -> DataFrame:
    """(row, window, rank, id, score): the ``k`` best of every window of every anchor.  ``anchors``
    has block, row, label, v and ``ends``, an array of (low, high), one for each window."""

    def gather(t: pa.Table) -> pa.Table:
        n = t.num_rows
        wide = max(1, max(len(x) for x in t.column("ends").to_pylist()))
        low, high, floor = np.full((n, wide), math.inf), np.full((n, wide), -math.inf), np.full((n, wide), -math.inf)
        for i, (ends, reached) in enumerate(zip(t.column("ends").to_pylist(), t.column("reached").to_pylist())):
            for w, e in enumerate(ends):
                low[i, w] = -math.inf if e["low"] is None else e["low"]
                high[i, w] = math.inf if e["high"] is None else e["high"]
            for e in reached or []:
                floor[i, e["window"]] = e["score"]
        parts = [t.column("row").to_numpy().astype(np.int64), t.column("label").to_numpy().astype(np.int64),
                 dense(t.column("v"), dim), low, high, floor]
        return pa.table([pa.array([t.column("block")[0].as_py()], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]],
                        names=["block", "a_row", "a_label", "a_v", "low", "high", "floor"])

    best, at, to = None, 0, 1
    order = Window.partitionBy("row", "window").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    while at < shards:
        state = anchors.withColumn("reached", F.lit(None).cast("array<struct<window:int,score:long>>"))
        if best is not None:
            reached = (best.where(F.col("rank") == k).groupBy(F.col("row").alias("_row"))
                       .agg(F.collect_list(F.struct("window", "score")).alias("reached")))     # one for each window
            state = anchors.join(reached, anchors["row"] == reached["_row"], "left").drop("_row")
        blocks = state.groupBy("block").applyInArrow(
            gather, "block int, a_row binary, a_label binary, a_v binary, low binary, high binary, floor binary")
        last = min(to, shards) - 1
        hits = (blocks.withColumn("_at", F.explode(F.sequence(F.lit(at), F.lit(last))))
                .withColumn("shard", F.pmod(F.col("block") + F.col("_at"), F.lit(shards)).cast("int"))
                .join(trees, "shard").drop("_at", "block").mapInArrow(_meet(dim, top, k, same), _HIT))
        if best is not None:
            hits = hits.unionByName(best.drop("rank"))
        best = materialize(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "bond-best")
        at, to = to, to * ROUND
    return best


def mine(vectors: DataFrame, is_anchor: Column, label: Column, low: int = 30, high: int = 90, positives: int = 5,
         negatives: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE,
         shard_rows: int = SHARD_ROWS, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score):
    for every anchor its first ``positives`` rows of equal label, and for each of them the first
    ``negatives`` rows of other labels whose score is ``low`` to ``high`` percent of the positive's."""
    rows = materialize(vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                                      quantised(F.col(vector_col), scale).alias("v"),
                                      F.coalesce(is_anchor, F.lit(False)).alias("asks"))
                       .where("label is not null and v is not null")
                       .withColumn("row", F.monotonically_increasing_id()), "bond-rows")   # a row's place is fixed from here on
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.count_if("asks").alias("asks"),
                    F.max(F.array_max(F.transform("v", F.abs))).alias("top")).first()
    dim, top = size["dim"] or 1, size["top"] or 0
    if top > LARGEST or dim * float(top) ** 2 >= 2 ** 53:
        raise ValueError("components are too large for exact sums")
    shards, blocks = max(1, math.ceil(size["n"] / shard_rows)), max(1, math.ceil(size["asks"] / block))
    trees = _shards(rows, shards, dim, top)
    anchors = materialize(rows.where("asks").select(F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int").alias("block"),
                                                    "row", "id", "label", "v"), "bond-anchors")
    ends = "array<struct<low:double,high:double>>"
    whole = F.array(F.struct(F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))).cast(ends)
    near = _search(anchors.drop("id").withColumn("ends", whole), trees, shards, dim, top, positives, same=True)
    # exact ends: ceil(low * s / 100) and floor(high * s / 100)
    s = F.col("score")
    bounds = F.struct(((low * s + F.pmod(-low * s, F.lit(100))) / 100).alias("low"),
                      ((high * s - F.pmod(high * s, F.lit(100))) / 100).alias("high"))
    windows = (near.groupBy(F.col("row").alias("_row")).agg(F.sort_array(F.collect_list(F.struct("rank", bounds.alias("e")))).alias("w"))
               .select("_row", F.transform("w", lambda x: x["e"]).cast(ends).alias("ends")))       # at most ``positives``
    asks = anchors.drop("id").join(windows, anchors["row"] == windows["_row"]).drop("_row")
    far = _search(materialize(asks, "bond-windows"), trees, shards, dim, top, negatives, same=False)
    found = near.select(F.col("row").alias("_row"), (F.col("rank") - 1).alias("_window"), F.col("rank").alias("positive_rank"),
                        F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = anchors.select(F.col("row").alias("_anchor"), F.col("id").alias("anchor_id"))
    return (far.join(found, (far["row"] == found["_row"]) & (far["window"] == found["_window"]))
            .join(named, F.col("row") == F.col("_anchor"))
            .select("anchor_id", "positive_id", "positive_rank", "rank", F.col("id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))
