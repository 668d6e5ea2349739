"""Exact top-k search by inner product with ball trees (operator 7).

Vectors become integers, ``floor(scale * x)``.  Rows are dealt by a hash of their place into
shards of about ``SHARD_ROWS``; each shard is built once into a ball tree (nodes with a
centre and a radius, leaves of at most ``LEAF`` vectors) and stored as one row.  Queries go
in blocks of ``BLOCK``.  A block meets a shard by branch and bound: the bound of a node for
a query is ``q . centre + |q| * radius``.  Nodes are taken in the order of their bounds (the
largest of the block's queries), which raises the k-th scores early; a query leaves a node whose
bound is below its current k-th score, with all that is under it.

The k-th score is shared between shards in rounds: a block meets one shard, then up to
``ROUND`` shards, then ``ROUND`` times as many, and starts each round with the k-th scores of all
rounds before it.  A node is cut only if its bound is below that, so equal scores
survive and ties are settled by id at the end.  Sums are exact: the integers are far below the
point where a double rounds, which is checked.

Defined results: rows whose vector is null or holds a null, NaN or infinite component take
no part.  A row is told from others by its place, not by its id: every row but the query's own is
a candidate, also one of the same id, and each query row has a ranking of its own.  A null id is no
query unless ``is_query`` says so; as a candidate it follows all ids among equal scores.
Vectors of different lengths are compared as if filled up with zeros.  A
query has fewer than k rows if there are fewer other rows.  Empty table: no rows.  Other
columns of the input are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.session import materialize

SHARD_ROWS = 8192
LEAF = 128
BLOCK = 512
ROUND = 8
SCALE = 64.0
LARGEST = 2 ** 26             # of a component: products of two are exact in a double


def quantised(vector: Column, scale: float = SCALE) -> Column:
    """The integer vector; null if the vector is null or a component is null or not finite."""
    low, high = F.lit(-math.inf), F.lit(math.inf)

    def fine(x):
        return x.isNotNull() & ~F.isnan(x) & (x > low) & (x < high)

    v = vector.cast("array<double>")
    return F.when(F.forall(v, fine), F.transform(v, lambda x: F.floor(x * F.lit(scale)).cast("long")))


class BallTree:
    """Vectors in leaf order and nodes in breadth-first order; node i has children
    ``child[i]`` and ``child[i] + 1`` (0: a leaf) and rows ``first[i]`` to ``last[i]``.  ``rows`` are the
    rows' places in the table, and ``order`` ranks them among equal scores."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(rows))
        first, last, child, centre, radius = [0], [len(rows)], [], [], []
        k = 0
        while k < len(first):
            lo, hi = first[k], last[k]
            own = vectors[order[lo:hi]]
            c = own.mean(axis=0)
            d = np.sqrt(((own - c) ** 2).sum(axis=1))
            centre.append(c)
            radius.append(d.max())
            if hi - lo <= leaf or d.max() == 0:
                child.append(0)
            else:                               # split between two far points, half to each side
                a = own[d.argmax()]
                b = own[((own - a) ** 2).sum(axis=1).argmax()]
                side = np.argsort(own @ (b - a), kind="stable")
                order[lo:hi] = order[lo:hi][side]
                mid = (lo + hi) // 2
                child.append(len(first))
                first += [lo, mid]
                last += [mid, hi]
            k += 1
        self.rows, self.order, self.vectors = rows[order], order, vectors[order]
        self.first, self.last, self.child = (np.array(x) for x in (first, last, child))
        self.centre, self.radius = np.array(centre), np.array(radius)

    def search(self, q: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each row of ``q`` (places ``own``) the k best that reach ``floor``: scores, filled up
        with -inf, and ``order`` values (equal scores: the smaller one first), and the number of
        scores computed."""
        n = len(q)
        size = np.sqrt((q * q).sum(axis=1))
        scores = np.full((n, k), -np.inf)
        found = np.full((n, k), np.iinfo(np.int64).max)
        kth = floor.astype(float).copy()
        slack = 1e-9 * size * (np.abs(self.centre).max(initial=0.0) * np.sqrt(q.shape[1]) + self.radius.max(initial=0.0)) + 1e-6
        work = 0

        def reach(node: int, who: np.ndarray):
            bound = q[who] @ self.centre[node] + size[who] * self.radius[node] + slack[who]
            on = bound >= kth[who]
            return (-bound[on].max(), node, who[on], bound[on]) if on.any() else None

        queue = [x for x in [reach(0, np.arange(n))] if x]
        while queue:
            _, node, who, bound = heapq.heappop(queue)
            who = who[bound >= kth[who]]                   # the k-th scores may have risen
            if not len(who):
                continue
            if self.child[node]:
                for child in (self.child[node], self.child[node] + 1):
                    if x := reach(child, who):
                        heapq.heappush(queue, x)
                continue
            at = slice(self.first[node], self.last[node])
            s = q[who] @ self.vectors[at].T
            work += s.size
            s[own[who][:, None] == self.rows[at][None, :]] = -np.inf
            s[s < kth[who][:, None]] = -np.inf
            better = (s > -np.inf).any(axis=1)
            who, s = who[better], s[better]
            if not len(who):
                continue
            all_s = np.concatenate([scores[who], s], axis=1)
            all_o = np.concatenate([found[who], np.broadcast_to(self.order[at], s.shape)], axis=1)
            best = np.lexsort((all_o, -all_s), axis=1)[:, :k]
            scores[who] = np.take_along_axis(all_s, best, 1)
            found[who] = np.take_along_axis(all_o, best, 1)
            kth[who] = np.maximum(kth[who], scores[who][:, -1])
        return scores, found, work

    def packed(self) -> list[bytes]:
        return [x.tobytes() for x in (self.rows.astype(np.int64), self.order.astype(np.int64), self.vectors.astype(np.int64),
                                      self.first.astype(np.int64), self.last.astype(np.int64), self.child.astype(np.int64),
                                      self.centre, self.radius)]

    @classmethod
    def unpacked(cls, parts: list[bytes], dim: int) -> "BallTree":
        t = cls.__new__(cls)
        t.rows, t.order, v, t.first, t.last, t.child = (np.frombuffer(p, np.int64) for p in parts[:6])
        t.vectors = v.reshape(len(t.rows), dim).astype(float)
        t.centre, t.radius = np.frombuffer(parts[6]).reshape(-1, dim), np.frombuffer(parts[7])
        return t


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column.to_pylist()):
        out[i, :len(v)] = v
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           scale: float = SCALE, shard_rows: int = SHARD_ROWS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, score): for every row with ``is_query`` the ``k`` other rows
    of largest integer inner product, ties to the smaller id."""
    rows = materialize(vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"),
                                      F.coalesce(is_query, F.lit(False)).alias("asks"))
                       .where("v is not null").withColumn("at", F.monotonically_increasing_id()),
                       "topk-rows")                        # a row's place is fixed from here on
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.count_if("asks").alias("q"),
                    F.max(F.array_max(F.transform("v", F.abs))).alias("top")).first()
    dim = size["dim"] or 1
    if (size["top"] or 0) > LARGEST or dim * float(size["top"] or 0) ** 2 >= 2 ** 53:
        raise ValueError("components are too large for exact sums")
    shards = max(1, math.ceil(size["n"] / shard_rows))
    blocks = max(1, math.ceil(size["q"] / block))

    def build(t: pa.Table) -> pa.Table:                    # one shard: its size is bounded
        ids = t.column("id").fill_null(0).to_numpy()
        known = t.column("id").is_valid().to_numpy()
        by_id = np.lexsort((ids, ~known))                  # null ids last
        tree = BallTree(t.column("at").to_numpy()[by_id], _matrix(t.column("v"), dim)[by_id])
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int32()),
                         "tree": pa.array([tree.packed()], pa.list_(pa.binary())),
                         "ids": pa.array([ids[by_id].astype(np.int64).tobytes()], pa.binary()),
                         "known": pa.array([known[by_id].tobytes()], pa.binary())})

    trees = materialize(rows.select(F.pmod(F.xxhash64("at"), F.lit(shards)).cast("int").alias("shard"), "id", "at", "v")
                        .groupBy("shard").applyInArrow(build, "shard int, tree array<binary>, ids binary, known binary"), "topk-trees")
    queries = materialize(rows.where("asks").select(F.pmod(F.xxhash64("at", F.lit(1)), F.lit(blocks)).cast("int").alias("block"),
                                                    "id", "at", "v"), "topk-queries")

    def gather(t: pa.Table) -> pa.Table:
        floor = np.array([-math.inf if x is None else x for x in t.column("floor").to_pylist()], float)
        return pa.table({"block": pa.array([t.column("block")[0].as_py()], pa.int32()),
                         "own": pa.array([t.column("at").to_numpy().astype(np.int64).tobytes()], pa.binary()),
                         "q": pa.array([_matrix(t.column("v"), dim).tobytes()], pa.binary()),
                         "floor": pa.array([floor.tobytes()], pa.binary())})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own = np.frombuffer(r["own"], np.int64)
                ids, known = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["known"], bool)
                s, order, _ = BallTree.unpacked(r["tree"], dim).search(np.frombuffer(r["q"]).reshape(len(own), dim), own, k,
                                                                       np.frombuffer(r["floor"]))
                hit = s > -np.inf
                order = order[hit]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(own, hit.sum(axis=1))), pa.array(ids[order], mask=~known[order]), pa.array(s[hit].astype(np.int64))],
                    names=["at", "id", "score"])

    best, near, far = None, 0, 1
    ranks = Window.partitionBy("at").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    while near < shards:
        state = queries.drop("id").withColumn("floor", F.lit(None).cast("long"))
        if best is not None:
            reached = best.where(F.col("rank") == k).select(F.col("at").alias("_at"), F.col("score").alias("floor"))
            state = queries.drop("id").join(reached, queries["at"] == reached["_at"], "left").drop("_at")
        asks = state.groupBy("block").applyInArrow(gather, "block int, own binary, q binary, floor binary")
        hits = (asks.withColumn("_step", F.explode(F.sequence(F.lit(near), F.lit(min(far, shards) - 1))))
                .withColumn("shard", F.pmod(F.col("block") + F.col("_step"), F.lit(shards)).cast("int"))
                .join(trees, "shard").drop("_step", "block").mapInArrow(meet, "at long, id long, score long"))
        if best is not None:
            hits = hits.unionByName(best.drop("rank"))
        best = materialize(hits.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k), "topk-best")
        near, far = far, far * ROUND
    named = queries.select(F.col("at").alias("_at"), F.col("id").alias("query_id"))
    return best.join(named, best["at"] == named["_at"]).select("query_id", "rank", "id", "score")
