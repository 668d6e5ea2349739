"""Byte-level BPE encoding and decoding in overlapping chunks (operator 8).

A text is cut into chunks of ``CHUNK`` code points that overlap by ``OVERLAP``; chunks are
rows of their own, so one very long text is pre-tokenised by many tasks.  A boundary is
trusted if its chunk goes on for ``MARGIN`` code points after it (the pattern then has seen
what ends the pre-token).  Where a
trusted boundary of one chunk is also a boundary of the next, the two resynchronise: from a
common boundary on, both split alike, as the pattern never looks back.  The first common
boundary in each overlap cuts the text into pieces, each piece starts at a true boundary,
and the pieces are pre-tokenised and merged independently.  Where an overlap has no common
boundary (one pre-token longer than it), the rest of that text stays one piece.

A pre-token's bytes are merged by rank, lowest first and leftmost of equals.  Ids are kept
as little-endian unsigned 32-bit integers; decoding concatenates the raw bytes of the ids.

Texts of one chunk need no stitching and are encoded where they are read.  Longer texts are
named by 128 bits of SHA-256, so only one copy of each is encoded, and joined back.

Defined results: null text is empty; an empty text has no ids.  Repeated rows get equal
results.  Empty table: no rows.  Unpaired surrogates cannot occur in Spark strings.  Input
columns named as a result column are replaced.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelframe.llm.common import with_struct
from duelframe.session import materialize

CHUNK = 16_384
OVERLAP = 512
MARGIN = 8                    # code points after its end that the pattern may look at, and more
MAX_RANKS = 1 << 20           # bound of the vocabulary that is sent to the workers
CACHE = 1 << 18               # merged pre-tokens a worker remembers, of up to CACHE_BYTES each
CACHE_BYTES = 64


def load_ranks(path: str) -> list[bytes]:
    """The vocabulary of a rank file (base64 token and rank on each line), by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    if len(pairs) > MAX_RANKS:
        raise ValueError("the rank file is larger than MAX_RANKS")
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token.  Neighbours whose concatenation has the lowest rank are joined
    until no neighbours have a rank; a heap of candidates keeps long pieces near linear."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    part: list[bytes | None] = [piece[i:i + 1] for i in range(n)]
    right = list(range(1, n + 1))
    left = list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, size = heapq.heappop(heap)
        j = right[i] if part[i] is not None else n
        if j >= n or len(part[i]) + len(part[j]) != size:
            continue                            # an entry for parts that have changed since
        part[i] += part[j]
        part[j] = None
        right[i] = right[j]
        if right[j] < n:
            left[right[j]] = i
            if (r := ranks.get(part[i] + part[right[j]])) is not None:
                heapq.heappush(heap, (r, i, size + len(part[right[j]])))
        k = left[i]
        if k >= 0 and (r := ranks.get(part[k] + part[i])) is not None:
            heapq.heappush(heap, (r, k, len(part[k]) + size))
    return [ranks[p] for p in part if p is not None]


class _Merged(dict):
    """Pre-token -> its ids as bytes, computed when first met."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> bytes:
        raw = word.encode("utf-8")
        ids = merge(raw, self.ranks)
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(raw) <= CACHE_BYTES:
            if len(self) >= CACHE:
                self.clear()
            self[word] = out
        return out


_WORKER: dict = {}


def _merged(vocabulary: list[bytes]) -> _Merged:
    """The worker's table for this vocabulary (one is kept while the worker lives)."""
    if _WORKER.get("of") is not vocabulary:
        _WORKER.update(of=vocabulary, table=_Merged({t: i for i, t in enumerate(vocabulary)}))
    return _WORKER["table"]


def _boundaries(split: "regex.Pattern", text: str) -> list[int]:
    return [m.start() for m in split.finditer(text)]


def _long_pieces(long: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(key, at, piece) of the texts ``long`` (key, text): pieces that start at true boundaries."""
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                for lo in range(0, len(text), 64 * chunk):
                    ks = range(lo // chunk, -(-min(len(text), lo + 64 * chunk) // chunk))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(ks), pa.binary()), pa.array(ks, pa.int32()),
                         pa.array([text[k * chunk:(k + 1) * chunk + overlap] for k in ks], pa.string())],
                        names=["key", "k", "body"])

    chunks = materialize(long.select("key", "text").mapInArrow(cut_up, "key binary, k int, body string")
                         .repartition("key", "k"), "bpe-chunks")

    @F.arrow_udf("head array<int>, tail array<int>")
    def edges(bodies: Iterator[pa.Array]) -> Iterator[pa.Array]:
        split = regex.compile(pattern)
        for batch in bodies:
            head, tail = [], []
            for body in batch.to_pylist():
                at = _boundaries(split, body)
                head.append([p for p in at if p < overlap])
                tail.append([p - chunk for p in at if chunk <= p <= len(body) - MARGIN])
            yield pa.StructArray.from_arrays([pa.array(head, pa.list_(pa.int32())), pa.array(tail, pa.list_(pa.int32()))],
                                             names=["head", "tail"])

    marks = chunks.select("key", "k", edges("body").alias("e")).select("key", "k", "e.head", "e.tail")
    by_text = Window.partitionBy("key").orderBy("k")     # the chunks of one text
    cut = (marks.withColumn("before", F.lag("tail").over(by_text))
           .withColumn("start", F.when(F.col("k") == 0, 0).otherwise(F.array_min(F.array_intersect("head", "before"))))
           # a chunk without a common boundary has not shown that it is in step, so neither it nor
           # those after it can confirm a boundary: they stay with the piece of the last one that has
           .withColumn("start", F.when(~F.max(F.col("start").isNull()).over(by_text), F.col("start")))
           .withColumn("piece", F.last(F.when(F.col("start").isNotNull(), F.col("k")), ignorenulls=True).over(by_text))
           .withColumn("stop", F.lead("start").over(by_text)))
    # a chunk gives its own code points: from its start (or 0) to its end, and the next chunk's up to that one's start
    own = chunks.join(cut.select("key", "k", "start", "stop", "piece"), ["key", "k"])
    begin = F.coalesce("start", F.lit(0))
    end = F.lit(chunk) + F.coalesce("stop", F.lit(0))
    # with it go the next code points, which the pattern may look at
    parts = (own.withColumn("_b", begin).withColumn("_e", end)
             .select("key", "piece", "k", F.expr("substring(body, _b + 1, _e - _b)").alias("part"),
                     F.expr(f"substring(body, _e + 1, {MARGIN})").alias("next")))
    return (parts.groupBy("key", "piece").agg(F.array_sort(F.collect_list(F.struct("k", "part", "next"))).alias("p"))
            .select("key", F.col("piece").alias("at"), F.array_join(F.col("p.part"), "").alias("piece"),
                    F.element_at("p", -1)["next"].alias("next")))


def _encoder(spark: SparkSession, vocabulary: list[bytes], pattern: str):
    """A Column function: (text that starts and ends at pre-token boundaries, the code points
    after it) -> ids as bytes."""
    shared = spark.sparkContext.broadcast(vocabulary)     # bounded by MAX_RANKS

    @F.arrow_udf(T.BinaryType())
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        split = regex.compile(pattern)
        table = _merged(shared.value)

        def words(text: str, after: str) -> list[str]:
            if not after:
                return split.findall(text)
            return [m.group() for m in split.finditer(text + after) if m.start() < len(text)]

        for texts, afters in batches:
            yield pa.array([b"".join(map(table.__getitem__, words(t, a)))
                            for t, a in zip(texts.to_pylist(), afters.to_pylist())], pa.binary())

    return run


def encode(docs: DataFrame, vocabulary: list[bytes], pattern: str, text_col: str = "text",
           chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with ``ids``: the token ids of the whole text, 4 little-endian bytes each."""
    if overlap >= chunk:
        raise ValueError("the overlap must be shorter than a chunk")
    run = _encoder(docs.sparkSession, vocabulary, pattern)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "ids"]
    is_long = F.length(text) > chunk
    short = docs.where(~is_long).select(*rest, run(text, F.lit("")).alias("ids"))
    key = F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))
    long = docs.where(is_long).withColumn("_llm_key", key)
    # one copy of each long text: repeats are dropped map-side before the shuffle
    once = long.select(F.col("_llm_key").alias("key"), text.alias("text")).dropDuplicates(["key"])
    pieces = _long_pieces(once, pattern, chunk, overlap).select("key", "at", run("piece", "next").alias("ids"))
    whole = (pieces.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("p"))
             .select(F.col("key").alias("_llm_of"), F.expr("unhex(array_join(transform(p, x -> hex(x.ids)), ''))").alias("ids")))
    stitched = long.join(whole, F.col("_llm_key") == F.col("_llm_of"))
    return short.unionByName(stitched.select(*rest, whole["ids"].alias("ids")))


def decode(encoded: DataFrame, vocabulary: list[bytes], ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of the ids, concatenated."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf(T.BinaryType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = shared.value.__getitem__
        for ids in batches:
            yield pa.array([None if x is None else b"".join(map(token, np.frombuffer(x, "<u4").tolist()))
                            for x in ids.to_pylist()], pa.binary())

    return with_struct(encoded, F.struct(run(F.col(ids_col)).alias("decoded")), ["decoded"])
