"""Near-duplicate documents by Order MinHash (operator 1).

A text's k-mers are its windows of five whitespace words (one window of all words if it has
fewer), each labelled with its occurrence number in the text, so a text is a sequence of
distinct labelled k-mers.  For each of ``HASHES`` hash functions the ``ELL`` smallest
labelled k-mers are taken and kept in text order; texts that agree on one such tuple are
candidates.  Unlike plain MinHash this asks for equal order and multiplicity, as edit
similarity does.

Candidates are verified by a banded alignment of their labelled k-mers: the longest common
subsequence within the band that similarity ``t`` leaves (at most ``(1-t)/(1+t) * (n+m)``
k-mers are unmatched, so no alignment that reaches ``t`` lies outside).  The similarity is
``lcs / (n + m - lcs)``, the Jaccard index of the five-word windows with their order;
``t`` is 0.8.  A pair at 0.8 agrees on one tuple with probability 0.8**3 (its three smallest
k-mers of either text are shared), so 16 tuples miss about one such pair in 10**5, and far
fewer above.

Classes are the connected components of the verified links.  Exact copies are one node from
the start (keyed by 128 bits of SHA-256 of the text).  Within a bucket of candidates every
text is first aligned with one pivot, so a bucket of ``n`` near copies costs about ``n``
alignments.  After components are merged, the texts outside the pivot's component are
compared with all others of the bucket that are of another component, in blocks of bounded
size, by a sketch of ``SKETCH`` minima: first each text's best partner is aligned and
components are merged again, then every remaining pair whose estimated similarity is at
least ``ESTIMATE``.  The estimate's standard deviation is below 0.018, so a pair at 0.8 is
passed over with a probability of about 10**-5; no pair is left out for the size of a group.

Defined results: null text: a class of its own, with the document's id.  A text without a
word joins only its exact copies.  Repeated rows share a class.  ``class_id`` is the class's
smallest doc_id (null if all are null).  Other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelframe.session import materialize

WORDS = 5
SIMILARITY = 0.8
HASHES = 16
ELL = 3
BLOCK = 1 << 15               # labelled k-mers hashed at once: bounds memory for long texts
SKETCH = 512                  # minima of the sketch, one byte each
ESTIMATE = 0.72               # four and a half standard deviations below SIMILARITY
BLOCK_ROWS = 512              # texts of one bucket that are compared at once

_rng = np.random.RandomState(20240601)
_MULTIPLIERS = (_rng.randint(0, 1 << 62, HASHES, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_SKETCHERS = (_rng.randint(0, 1 << 62, SKETCH, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def kmers(text: str | None, words: int = WORDS) -> np.ndarray:
    """The text's occurrence-labelled k-mers in text order, as 64-bit hashes."""
    parts = (text or "").encode("utf-8", "replace").split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(zlib.crc32, parts), dtype=np.uint64, count=len(parts))
    w = _mix(w + _C1)
    size = min(words, len(w))
    n = len(w) - size + 1
    h = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        h = _mix(h * _C1 + w[k:k + n])
    order = np.argsort(h, kind="stable")
    s = h[order]
    fresh = np.empty(n, dtype=bool)
    fresh[0] = True
    np.not_equal(s[1:], s[:-1], out=fresh[1:])
    if not fresh.all():                        # label the occurrences of repeated k-mers
        first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        nth = np.empty(n, dtype=np.uint64)
        nth[order] = (np.arange(n) - first).astype(np.uint64)
        again = nth > 0
        h[again] = _mix(h[again] + nth[again] * _C2)
    return h


def order_minhash(x: np.ndarray) -> np.ndarray:
    """One hash for each function: its ``ELL`` smallest k-mers, in text order."""
    if not len(x):
        return np.zeros(0, dtype=np.int64)
    best = val = None
    for lo in range(0, len(x), BLOCK):
        part = x[lo:lo + BLOCK]
        v = part[None, :] * _MULTIPLIERS[:, None]
        if len(part) > ELL:
            at = np.argpartition(v, ELL - 1, axis=1)[:, :ELL]
            v = np.take_along_axis(v, at, 1)
        else:
            at = np.broadcast_to(np.arange(len(part)), v.shape)
        at = at + lo
        if best is not None:
            at, v = np.concatenate([best, at], 1), np.concatenate([val, v], 1)
            if v.shape[1] > ELL:
                keep = np.argpartition(v, ELL - 1, axis=1)[:, :ELL]
                at, v = np.take_along_axis(at, keep, 1), np.take_along_axis(v, keep, 1)
        best, val = at, v
    picked = x[np.sort(best, axis=1)]
    out = np.arange(1, HASHES + 1, dtype=np.uint64)
    for k in range(picked.shape[1]):
        out = _mix(out * _C1 + picked[:, k])
    return out.view(np.int64)


def sketch(x: np.ndarray) -> np.ndarray:
    """One byte of each of ``SKETCH`` minima over the k-mers: the share of equal bytes of two
    sketches estimates the Jaccard index of their k-mers."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(x), 2048):
        np.minimum(least, (x[None, lo:lo + 2048] * _SKETCHERS[:, None]).min(axis=1), out=least)
    return (_mix(least) & np.uint64(255)).astype(np.uint8)


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated Jaccard index of a sketch with each row of ``many`` (chance hits taken out)."""
    return (np.count_nonzero(many == one, axis=1) / SKETCH - 1 / 256) / (1 - 1 / 256)


def alignment_similarity(x: np.ndarray, y: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity of two sequences of distinct k-mers by banded alignment; 0 if below ``least``."""
    n, m = len(x), len(y)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    if n == m and np.array_equal(x, y):
        return 1.0
    band = int((n + m) * (1 - least) / (1 + least) + 1e-9)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if len(i) < least * (n + m - len(i)):       # an upper bound of the alignment
        return 0.0
    j = j[np.argsort(i)]
    if (np.diff(j) > 0).all():
        lcs = len(j)
    else:                                       # distinct symbols: the alignment is an increasing subsequence
        tails: list[int] = []
        for v in j.tolist():
            k = bisect_left(tails, v)
            tails[k:k + 1] = [v]
        lcs = len(tails)
    s = lcs / (n + m - lcs)
    return s if s >= least else 0.0


@F.arrow_udf(T.ArrayType(T.LongType()))
def _sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([order_minhash(kmers(t)) for t in texts.to_pylist()], pa.list_(pa.int64()))


@F.arrow_udf(T.StructType([T.StructField("seq", T.BinaryType()), T.StructField("sketch", T.BinaryType())]))
def _sequence(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        x = [kmers(t) for t in texts.to_pylist()]
        yield pa.StructArray.from_arrays([pa.array([k.tobytes() for k in x], pa.binary()),
                                          pa.array([sketch(k).tobytes() for k in x], pa.binary())], names=["seq", "sketch"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sa, sb = batch.column("sa"), batch.column("sb")
        on = [alignment_similarity(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)) > 0
              for p, q in zip(sa, sb)]
        yield batch.select(["a", "b"]).filter(pa.array(on, pa.bool_()))


_PAIRS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _alike(t: pa.Table, best_only: bool) -> pa.Table:
    """Pairs (a > b) of two blocks of one bucket that are of different components and whose
    estimate reaches ``ESTIMATE``; with ``best_only`` each text's best partner alone.  A pair
    that meets in several buckets is compared in one of them."""
    h, i, j, both = (t.column(c)[0].as_py() for c in ("h", "i", "j", "both"))
    key = t.column("key").to_pylist()
    sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(key), SKETCH)
    bands = np.array(t.column("bands").to_pylist(), dtype=np.int64)
    comp = np.unique(np.array([c.hex() for c in t.column("comp").to_pylist()]), return_inverse=True)[1]
    outside, blk = t.column("outside").to_numpy(zero_copy_only=False), t.column("blk").to_numpy()
    left = np.flatnonzero(outside & (blk == i))
    right = np.flatnonzero(outside & (blk == j)) if both else np.flatnonzero(~outside)
    found = set()
    for n, x in enumerate(left):
        other = right[n + 1:] if both and i == j and not best_only else right
        other = other[comp[other] != comp[x]]
        if len(other):
            equal = bands[other] == bands[x]                # a pair is compared in the bucket of its first equal tuple
            other = other[bands[x][equal.argmax(axis=1)] == h]
        if not len(other):
            continue
        e = estimate(sk[x], sk[other])
        on = np.flatnonzero(e >= ESTIMATE)
        if best_only and len(on):
            on = on[[e[on].argmax()]]
        found.update((max(key[x], key[y]), min(key[x], key[y])) for y in other[on])
    return pa.Table.from_arrays([pa.array([p[k] for p in found], pa.binary()) for k in (0, 1)], schema=_PAIRS)


def _best(t: pa.Table) -> pa.Table:
    return _alike(t, True)


def _every(t: pa.Table) -> pa.Table:
    return _alike(t, False)


def content_key(text: Column) -> Column:
    """128 bits of SHA-256 of the text; null for null."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def components(edges: DataFrame) -> DataFrame:
    """(key, comp) for every node of the undirected edges (a, b): comp is the smallest key of
    its connected component.  Alternating large-star and small-star steps; every step is a
    minimum and a join, so a node with many edges is never gathered in one place."""
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.where("b < a")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        joined = both.join(least, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                least.select("a", F.col("m").alias("b")))
        return materialize(out.where("a <> b").distinct(), "omh-star")

    def unsettled(e: DataFrame) -> DataFrame:
        """Nodes that have two edges to smaller ones, or edges to both sides."""
        ends = e.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            e.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)")

    while True:
        edges = star(star(edges, True), False)
        if unsettled(edges).isEmpty():
            break
    comp = edges.select(F.col("a").alias("key"), F.col("b").alias("comp"))
    return comp.unionByName(comp.select(F.col("comp").alias("key"), "comp").distinct())


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, class_id, class_key) for every row of ``docs``: ``key`` names the text,
    ``class_key`` the text of the class's representative (that of its smallest id)."""
    rows = materialize(
        docs.select(F.col(id_col).alias("id"), content_key(F.col(text_col)).alias("key"),
                    _sketch(F.col(text_col)).alias("bands")), "omh-rows")
    nodes = materialize(rows.where("key is not null").groupBy("key")
                        .agg(F.min("id").alias("id"), F.first("bands").alias("bands")), "omh-nodes")
    labels = _labels(docs, nodes, id_col, text_col)
    if labels is None:
        known = nodes.select("key", F.col("id").alias("class_id"), F.col("key").alias("class_key"))
    else:
        # the representative: smallest id (nulls last), then key; only linked texts are moved
        linked = labels.join(nodes.select("key", "id"), "key")
        head = linked.groupBy("comp").agg(
            F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("least"))
        moved = linked.join(head, "comp").select("key", F.col("least.id").alias("class_id"),
                                                 F.col("least.key").alias("class_key"))
        known = (nodes.select("key", "id").join(moved, "key", "left")
                 .select("key", F.when(F.col("class_key").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
                         F.coalesce("class_key", "key").alias("class_key")))
    texts = rows.where("key is not null").select("id", "key").join(known, "key")
    blank = rows.where("key is null").select("id", "key", F.col("id").alias("class_id"), F.col("key").alias("class_key"))
    return texts.select("id", "key", "class_id", "class_key").unionByName(blank)


def _labels(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """(key, comp) of the texts that have a verified link, or None if there is none."""
    slots = nodes.select("key", F.explode("bands").alias("h"))
    shared = slots.groupBy("h").agg(F.count("*").alias("n"), F.min("key").alias("pivot")).where("n > 1")
    members = materialize(slots.join(shared.select("h", "pivot"), "h"), "omh-members")

    # the k-mers of candidate texts, each text once (by its row of smallest id)
    wanted = members.select("key").distinct().join(nodes, "key")
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_key", content_key(F.col("_text")))
    seqs = materialize(
        own.join(wanted, (F.col("_key") == F.col("key")) & F.col("_id").eqNullSafe(F.col("id")))
        .select("key", "bands", _sequence(F.col("_text")).alias("s"))
        .groupBy("key").agg(F.first("bands").alias("bands"), F.first("s").alias("s"))
        .select("key", "bands", "s.seq", "s.sketch"), "omh-kmers")

    def verify(pairs: DataFrame) -> DataFrame:
        left = seqs.select(F.col("key").alias("a"), F.col("seq").alias("sa"))
        right = seqs.select(F.col("key").alias("b"), F.col("seq").alias("sb"))
        return materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
                           .mapInArrow(_verified, "a binary, b binary"), "omh-links")

    tested = members.where("key <> pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b")).distinct()
    links = verify(tested)
    for best_only in (True, False):
        labels = None if links.isEmpty() else components(links)
        blocks = _blocks(members, seqs, labels)
        more = blocks.groupBy("h", "both", "i", "j").applyInArrow(_best if best_only else _every, "a binary, b binary")
        fresh = materialize(more.distinct().join(tested, ["a", "b"], "left_anti"), "omh-pairs")
        if fresh.isEmpty():
            if best_only:
                continue
            return labels
        links, tested = links.unionByName(verify(fresh)), tested.unionByName(fresh)
    return None if links.isEmpty() else components(links)


def _blocks(members: DataFrame, seqs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The buckets that hold several components, dealt out in pairs of blocks.

    ``outside`` marks texts that are not of the pivot's component: these meet each other
    (``both``) and the rest, the rest need not meet itself."""
    if labels is None:
        at = members.select("h", "key", "pivot", F.col("key").alias("comp"), F.col("pivot").alias("own"))
    else:
        at = (members.join(labels, "key", "left")
              .join(labels.select(F.col("key").alias("pivot"), F.col("comp").alias("own")), "pivot", "left")
              .select("h", "key", "pivot", F.coalesce("comp", "key").alias("comp"), F.coalesce("own", "pivot").alias("own")))
    at = materialize(at.select("h", "key", "comp", (F.col("comp") != F.col("own")).alias("outside")), "omh-at")
    share = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    sizes = (at.groupBy("h").agg(F.count_if("outside").alias("n"), F.count_if(~F.col("outside")).alias("m")).where("n > 0")
             .select("h", share.alias("nb"), F.ceil(F.col("m") / BLOCK_ROWS).cast("int").alias("mb")))
    x = F.col("blk")

    def upto(n):
        return F.sequence(F.lit(0), F.col(n) - 1)

    among = F.transform(upto("nb"), lambda y: F.struct(F.lit(True).alias("both"), F.least(x, y).alias("i"), F.greatest(x, y).alias("j")))
    across = F.transform(upto("mb"), lambda y: F.struct(F.lit(False).alias("both"), x.alias("i"), y.alias("j")))
    rest = F.transform(upto("nb"), lambda y: F.struct(F.lit(False).alias("both"), y.alias("i"), x.alias("j")))
    return (at.join(sizes, "h")
            .withColumn("blk", F.pmod(F.xxhash64("key"), F.when(F.col("outside"), F.col("nb")).otherwise(F.col("mb")).cast("long")).cast("int"))
            .select("h", "key", "comp", "outside", "blk",
                    F.explode(F.when(F.col("outside"), F.concat(among, across)).otherwise(rest)).alias("p"))
            .select("h", "key", "comp", "outside", "blk", "p.both", "p.i", "p.j")
            .join(seqs.select("key", "bands", "sketch"), "key"))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its id and its class id."""
    return classes(docs, id_col, text_col).select(F.col("id").alias(id_col), "class_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the representative's (see ``classes``); of rows
    with equal id and text one stays.  Rows with null text stay."""
    keepers = (classes(docs, id_col, text_col).where("key = class_key and (id <=> class_id)")
               .select(F.col("key").alias("_llm_k"), F.col("id").alias("_llm_i")).distinct())
    own = docs.withColumn("_llm_key", content_key(F.col(text_col)))
    kept = (own.where("_llm_key is not null")
            .join(keepers, (F.col("_llm_key") == F.col("_llm_k")) & F.col(id_col).eqNullSafe(F.col("_llm_i")), "left_semi")
            .dropDuplicates(["_llm_key", id_col]))
    return kept.unionByName(own.where("_llm_key is null")).select(*[F.col(f"`{c}`") for c in docs.columns])
