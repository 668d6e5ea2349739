"""Mixing sources to target weights by block draws (operator 13).

The words of a source's documents follow each other on one axis, which is cut into blocks of
``BLOCK_WORDS`` words (a document may lie in several blocks, a block may hold several documents;
the source's last block may be short).  A source's target is its weight's share of ``share``
times all words, but at most ``most`` times its own words; what that leaves over is shared by the
others by weight.  The target gives the number of slots that the source fills in the mix.

The slots are dealt to output shards of about ``SHARD_SLOTS`` slots by one multinomial draw for
each source, so the counts of the sources in a shard are multinomial and each source's sum over
all shards is exact.  The draw is made by halving the range of shards with binomial draws, so a
task finds the counts and the first slot numbers of its shard by itself in log2(shards) steps.
Slot ``j`` of a source with ``n`` blocks is block ``permute(j mod n)`` of its pass ``j div n``, with a
pseudorandom permutation (a Feistel network with cycle walking) for every source and pass: within a
pass no block comes twice.  The last slot of a source takes only the words still missing from
its target.  Slots and documents meet by (source, block).

Places on the axis come from sums over groups of about ``GROUP_ROWS`` documents by a hash of id and
text, so a source may hold any share of all rows, and they do not depend on how the table is split:
equal tables give equal mixes.  Equal rows (id, source, text) fold to one with a count, and unfold
again in steps of ``COPIES``.

Defined results: a null or empty text has no words and takes no part (``taken`` 0).  A null source is
a source of its own, the last.  Documents with null or repeated ids are documents of their own.
Over ``MAX_SOURCES`` sources are an error.  Empty table: no rows.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelframe.llm.packing import word_count
from duelframe.session import materialize

WEIGHTS = (3, 1, 2)          # of the sources in code point order, repeating
SHARE, MOST = 1.5, 2.0
BLOCK_WORDS = 512
SHARD_SLOTS = 4096
GROUP_ROWS = 16_384
COPIES = 4096
MAX_SOURCES = 65_536
SEED = 13


def targets(sizes: list[int], weights: list[int], share: float = SHARE, most: float = MOST) -> list[Fraction]:
    """Each source's words in the mix: ``share`` times all words by weight, a source stopping at
    ``most`` times its size and the excess reshared until none is above."""
    rest, total = Fraction(share) * sum(sizes), sum(weights)
    caps = [Fraction(most) * s for s in sizes]
    out: list[Fraction] = [Fraction(0)] * len(sizes)
    # sources reach their stop in the order of stop / weight
    order = sorted(range(len(sizes)), key=lambda i: caps[i] / weights[i])
    for k, i in enumerate(order):
        if caps[i] * total >= rest * weights[i]:           # neither this one nor any after it is above
            for j in order[k:]:
                out[j] = rest * weights[j] / total
            break
        out[i] = caps[i]
        rest, total = rest - caps[i], total - weights[i]
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Permutation:
    """A pseudorandom permutation of 0 to n - 1 without a table of n entries."""

    ROUNDS = 6

    def __init__(self, n: int, *key: int):
        self.n = n
        self.half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        k = np.zeros(1, np.uint64)
        for part in key:
            k = _mixed(k ^ np.uint64(part))
        self.keys = [_mixed(k + np.uint64(r))[0] for r in range(self.ROUNDS)]

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in (reversed(self.keys) if back else self.keys):
            if back:
                left, right = right ^ (_mixed(left ^ key) & self.mask), left
            else:
                left, right = right, left ^ (_mixed(right ^ key) & self.mask)
        return (left << self.half) | right

    def __call__(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        out = self._once(np.asarray(x, dtype=np.uint64), back)
        while (over := out >= self.n).any():               # walk the cycle back into the range
            out[over] = self._once(out[over], back)
        return out.astype(np.int64)


def last_pass(size: int, take: int, block: int, key: tuple[int, ...]) -> tuple[int, int]:
    """For ``take`` words of a source of ``size``: the number of slots, and of the words that the last
    one takes (``block`` if it is not cut)."""
    n = -(-size // block)
    passes, rest = divmod(take, size)
    if not rest:
        return passes * n, block
    tail, at = size - (n - 1) * block, int(Permutation(n, *key, passes)(np.array([n - 1]), back=True)[0])

    def words(slots: int) -> int:                          # in the first ``slots`` blocks of the pass
        return slots * block if slots <= at else (slots - 1) * block + tail

    slots = -(-rest // block)
    if slots > at:                                         # the short block is among them
        slots = max(at + 1, -(-(rest - tail) // block) + 1)
    return passes * n + slots, rest - words(slots - 1)


def shard_counts(shard: int, shards: int, totals: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first slot, number of slots) of every source in one shard of the multinomial draw."""
    first, n, lo, hi = np.zeros(len(totals), np.int64), np.array(totals, np.int64), 0, shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = np.random.default_rng([seed, lo, hi]).binomial(n, (mid - lo) / (hi - lo))
        if shard < mid:
            n, hi = left, mid
        else:
            first, n, lo = first + left, n - left, mid
    return first, n


@dataclass
class Mix:
    """What a mix is made from; see ``plan``."""

    places: DataFrame            # source_no, id, text_hash, size, copies, start
    sources: DataFrame           # source_no, source, source_size, target
    sizes: list[int]
    takes: list[int]
    block: int
    shards: int
    seed: int


def _source_sizes(rows: DataFrame) -> list:
    found = (rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.count("*").alias("rows"))
             .limit(MAX_SOURCES + 1).collect())
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
         block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED, id_col: str = "doc_id",
         source_col: str = "source", text_col: str = "text", group_rows: int = GROUP_ROWS) -> Mix:
    """Sizes, targets and every document's place on its source's axis."""
    spark = docs.sparkSession
    rows = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                                   word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("text_hash"))
                       .groupBy("id", "source", "size", "text_hash").agg(F.count("*").alias("copies")), "mix-documents")
    found = _source_sizes(rows)
    sizes = [r["size"] for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, most)
    sources = spark.createDataFrame([(i, r["source"], r["size"], float(t), max(1, -(-r["rows"] // group_rows)))
                                     for i, (r, t) in enumerate(zip(found, goal))],
                                    "source_no int, source string, source_size long, target double, groups long")
    # bounded by MAX_SOURCES rows
    named = F.broadcast(sources.select("source_no", F.col("source").alias("_source"), "groups"))
    dealt = (rows.join(named, rows["source"].eqNullSafe(F.col("_source")))
             .select("source_no", "id", "text_hash", "size", "copies",
                     F.pmod(F.xxhash64("id", "text_hash"), F.col("groups")).alias("_group")))
    words = F.col("size") * F.col("copies")
    groups = dealt.groupBy("source_no", "_group").agg(F.sum(words).alias("_n"))
    earlier = Window.partitionBy("source_no").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("source_no", "_group", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("source_no", "_group").orderBy("text_hash", "id").rowsBetween(Window.unboundedPreceding, -1)
    places = (dealt.withColumn("_in", F.coalesce(F.sum(words).over(inside), F.lit(0))).join(groups, ["source_no", "_group"])
              .withColumn("start", F.col("_first") + F.col("_in")).drop("_group", "_in", "_first"))
    takes = [math.floor(t) for t in goal]
    slots = sum(last_pass(s, t, block, (seed, i))[0] for i, (s, t) in enumerate(zip(sizes, takes)) if s)
    return Mix(materialize(places, "mix-places"), sources.drop("groups"), sizes, takes, block,
               max(1, -(-slots // shard_slots)), seed)


def draws(spark: SparkSession, mix: Mix) -> DataFrame:
    """(shard, slot, source_no, pass, block, words): the block of every slot of the mix, and how many
    of its words the slot takes."""
    used = [i for i, s in enumerate(mix.sizes) if s]
    ends = [last_pass(mix.sizes[i], mix.takes[i], mix.block, (mix.seed, i)) for i in used]
    totals = np.array([n for n, _ in ends], np.int64)
    blocks = [-(-mix.sizes[i] // mix.block) for i in used]
    length, seed, shards = mix.block, mix.seed, mix.shards

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                first, count = shard_counts(shard, shards, totals, seed)
                source, at, block, words = [], [], [], []
                for k in np.flatnonzero(count):
                    j = np.arange(first[k], first[k] + count[k])
                    turn, to = j // blocks[k], np.empty(len(j), np.int64)
                    for p in np.unique(turn):
                        to[turn == p] = Permutation(blocks[k], seed, used[k], int(p))(j[turn == p] % blocks[k])
                    source.append(np.full(len(j), used[k]))
                    at.append(turn)
                    block.append(to)
                    words.append(np.where(j == totals[k] - 1, ends[k][1], length))
                if not source:
                    continue
                order = np.random.default_rng([seed, shards, shard, 1]).permutation(sum(map(len, source)))
                columns = [np.concatenate(x)[order] for x in (source, at, block, words)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(order), shard, np.int64)), pa.array(np.arange(len(order), dtype=np.int32)),
                     pa.array(columns[0].astype(np.int32)), pa.array(columns[1].astype(np.int32)), pa.array(columns[2]),
                     pa.array(columns[3].astype(np.int64))], names=["shard", "slot", "source_no", "pass", "block", "words"])

    return spark.range(shards).mapInArrow(run, "shard long, slot int, source_no int, pass int, block long, words long")


def documents(mix: Mix) -> DataFrame:
    """One row per document: source_no, id, text_hash, size and ``start``, its place on the axis."""
    step = F.lit(COPIES).cast("long")
    some = mix.places.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, step)))
    some = some.where("copies = 1").unionByName(some.where("copies > 1").repartition("source_no", "start", "_from"))
    copy = F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + step, F.col("copies")) - 1))
    return (some.withColumn("_copy", copy).withColumn("start", F.col("start") + F.col("_copy") * F.col("size"))
            .select("source_no", "id", "text_hash", "size", "start"))


def pieces(mix: Mix) -> DataFrame:
    """The mix: in the slot (shard, slot) the words ``first_word`` to ``first_word + n_words - 1`` of
    a document; pieces of a slot stand in the order of ``start``."""
    held = documents(mix).where("size > 0")
    block = F.lit(mix.block).cast("long")
    spans = held.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    # Spark takes the size of the drawn rows from the few shards that they are made of, so it must be
    # told not to broadcast them; a block is drawn at most as often as there are passes
    met = spans.join(draws(mix.places.sparkSession, mix).hint("merge"), ["source_no", "block"])
    begin = F.greatest(F.col("start"), F.col("block") * block)
    end = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("words"))
    return (met.withColumn("first_word", begin - F.col("start")).withColumn("n_words", end - begin).where("n_words > 0")
            .select("shard", "slot", "pass", "source_no", "id", "text_hash", "size", "start", "first_word", "n_words"))


def taken(mix: Mix) -> DataFrame:
    """One row per document: id, size, source_size, target, and ``taken``, its words in the mix."""
    key = ["source_no", "start", "id", "size"]             # the place alone tells documents with words apart
    held = documents(mix).select(*key)
    parts = pieces(mix).select(*key, F.col("n_words").alias("n"))
    used = held.where("size > 0").withColumn("n", F.lit(0).cast("long")).unionByName(parts).groupBy(*key).agg(F.sum("n").alias("taken"))
    every = used.unionByName(held.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return every.join(F.broadcast(mix.sources), "source_no").select("id", "size", "source_size", "target", "taken")


def texts(mix: Mix, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, slot, source_no, text): the words of every slot, joined by blanks."""
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    by_id = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_hash"), F.col(text_col).alias(text_col))
    once = by_id.groupBy("_id", "_hash").agg(F.first(text_col, ignorenulls=True).alias(text_col)).select("_id", "_hash", words.alias("_words"))
    p = pieces(mix)
    part = F.array_join(F.slice("_words", (F.col("first_word") + 1).cast("int"), F.col("n_words").cast("int")), " ")
    found = p.join(once, p["id"].eqNullSafe(once["_id"]) & (p["text_hash"] == once["_hash"]))
    return (found.select("shard", "slot", "source_no", F.struct("start", part.alias("part")).alias("p"))
            .groupBy("shard", "slot", "source_no").agg(F.sort_array(F.collect_list("p")).alias("p"))     # at most a block's words
            .select("shard", "slot", "source_no", F.array_join("p.part", " ").alias("text")))
