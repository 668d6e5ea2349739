"""Language identification by prediction by partial matching (operator 6).

Per language a variable-order byte context tree is learned: every context of up to three
bytes with the counts of the bytes that followed it.  A text is coded under the frozen
tree of each language with escape method C: in context ``c`` (``n`` symbols seen, ``t``
distinct) a byte seen ``k`` times costs ``-log2(k / (n + t))`` bits, any other byte costs
the escape ``-log2(t / (n + t))`` plus its cost in the next shorter context; a context
never seen passes on at no cost; below order 0 a byte costs 8 bits.  The language with the
shortest code wins.

Every context and byte seen in a language's sample is kept: a tree is a sparse table of
(context, byte) entries and of the contexts' escapes, so its size follows what was learned and not
contexts times alphabet times languages.  A text's bytes are looked up in the longest contexts
first, and only those not found go on to the shorter ones; below two bytes the tables are
dense.  The sums are the exact code lengths.  A model over ``MODEL_BYTES`` is an error.

Defined results: null text, or a text without a letter: ``und`` with score 0.  Equal code
lengths: the language that sorts first.  No training rows: every text is ``und``.  Rows are
independent: repeated rows get equal results.  Columns of the input named as a result
column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.llm.common import id_remainder, segment_sums, utf8_buffers, with_struct
from duelframe.session import materialize

UNDETERMINED = "und"
ORDER = 3
PAD = 10                      # the byte that is taken to precede every text
TRAIN_DOCS_PER_LANG = 1500    # bound of the labelled sample (expected size, whole texts)
MAX_LANGS = 512
MODEL_BYTES = 512 << 20       # bound of the trees that are sent to the workers
ENTRY_BYTES = 40              # of a tree for each gram, at most
CHUNK = 1 << 19               # bytes scored at once


class Sparse:
    """A frozen map from 32-bit keys to floats: open addressing, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint32(32 - max(2, int(2 * len(keys)).bit_length()))
        self.slots = np.full(1 << (32 - int(self.shift)), -1, dtype=np.int32)
        self.keys, self.values = keys.astype(np.uint32), values.astype(np.float32)
        left, at = np.arange(len(keys), dtype=np.int32), self._slot(self.keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]              # of several, the last one stays
            moved = self.slots[at] != left
            left, at = left[moved], (at[moved] + 1) % len(self.slots)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435769)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found); the value of a key not found is 0."""
        out, found = np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
        if not len(self.keys):
            return out, found
        at = self._slot(keys)
        entry = self.slots[at]
        hit = self.keys[entry] == keys                     # slot -1 reads the last key, and is sorted out next
        hit &= entry >= 0
        out[hit], found[hit] = self.values[entry[hit]], True
        left = np.flatnonzero(~hit & (entry >= 0))         # taken by another key: try the next slot
        while len(left):
            at[left] = (at[left] + 1) % len(self.slots)
            entry = self.slots[at[left]]
            left, entry = left[entry >= 0], entry[entry >= 0]
            hit = self.keys[entry] == keys[left]
            out[left[hit]], found[left[hit]] = self.values[entry[hit]], True
            left = left[~hit]
        return out, found


@dataclass
class Tree:
    """One language: bits of the bytes seen after three and two bytes, the escapes of these contexts,
    and the bits of any byte after one byte (orders 1 and 0 and the uniform code together)."""

    hit3: Sparse
    escape3: Sparse
    hit2: Sparse
    escape2: np.ndarray
    one: np.ndarray


@dataclass
class PPMModel:
    langs: list[str]
    trees: list[Tree]


def _previous(sym: np.ndarray, starts: np.ndarray, lengths: np.ndarray, back: int, pad: int) -> np.ndarray:
    """The symbol ``back`` places before each position of its own text (``pad`` before the start)."""
    prev = np.empty_like(sym)
    prev[back:] = sym[:-back] if back else sym
    prev[:back] = pad
    for k in range(back):
        prev[starts[lengths > k] + k] = pad
    return prev


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, three bytes and the next as one integer, count) of each batch."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        raw, off, _ = utf8_buffers(batch.column("text"))
        lengths = np.diff(off)
        prev = [_previous(raw, off[:-1], lengths, k, PAD) for k in (3, 2, 1)]
        key = np.zeros(len(raw), dtype=np.uint32)
        for p in (*prev, raw):
            key = (key << np.uint32(8)) | p
        names, code = np.unique(langs.astype(str), return_inverse=True)
        at = np.repeat(code, lengths)
        for i, name in enumerate(names):
            k, n = np.unique(key[at == i], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([str(name)] * len(k), pa.string()), pa.array(k.astype(np.int64)),
                 pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def train(docs: DataFrame, docs_per_lang: int = TRAIN_DOCS_PER_LANG, model_bytes: int = MODEL_BYTES) -> PPMModel:
    """Learn from ``text`` and ``lang`` of ``docs`` (rows with a null in either are left out).

    Of each language a hash sample by ``doc_id`` of about ``docs_per_lang`` documents is
    used, whole texts; the grams are counted in Spark, and all of them are kept.  The bound
    of the sample bounds what the driver holds; over ``model_bytes`` the training fails.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages to learn")
    langs = sorted(sizes)
    if not langs:
        return PPMModel([], [])
    slots = 1 << 24
    share = F.lit(0)
    for name in langs:
        share = F.when(F.col("lang") == name, int(min(1.0, docs_per_lang / sizes[name]) * slots)).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(slots)) < share).select("lang", "text")
    grams = materialize(sample.mapInArrow(_gram_counts, "lang string, gram long, n long")
                        .groupBy("lang", "gram").agg(F.sum("n").alias("n")), "ppm-grams")
    size = grams.count() * ENTRY_BYTES + len(langs) * (2 << 18)
    if size > model_bytes:
        raise ValueError(f"the context trees need up to {size} bytes, over {model_bytes}: learn from fewer documents")
    counts = grams.toPandas()                              # bounded: see above
    return PPMModel(langs, [_tree(own["gram"].to_numpy(np.int64), own["n"].to_numpy(np.int64))
                            for own in (counts[counts["lang"] == name] for name in langs)])


def _level(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From grams (context and byte) with counts: the bits of each gram, and the contexts with the
    bits of their escapes."""
    context, at = np.unique(grams >> 8, return_inverse=True)
    total, distinct = np.bincount(at, n, len(context)), np.bincount(at, minlength=len(context))
    with np.errstate(divide="ignore"):
        return -np.log2(n / (total + distinct)[at]), context, -np.log2(distinct / (total + distinct)), at


def _shorter(grams: np.ndarray, n: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The counts of the grams' last ``bits`` bits."""
    kept, at = np.unique(grams & ((1 << bits) - 1), return_inverse=True)
    return kept, np.bincount(at, n, len(kept)).astype(np.int64)


def _tree(grams: np.ndarray, n: np.ndarray) -> Tree:
    """The frozen tree from the counts of three bytes and the next (see the module text)."""
    bits3, context3, out3, _ = _level(grams, n)
    two, n2 = _shorter(grams, n, 24)
    bits2, context2, out2, _ = _level(two, n2)
    escape2 = np.zeros(1 << 16, np.float32)
    escape2[context2] = out2
    one, n1 = _shorter(two, n2, 16)
    zero, n0 = _shorter(one, n1, 8)
    bits0, _, out0, _ = _level(zero, n0)
    row = np.full(256, 8.0 + (out0[0] if len(out0) else 0.0))
    row[zero] = bits0
    bits1, context1, out1, _ = _level(one, n1)
    escape1 = np.zeros(256)
    escape1[context1] = out1
    dense = escape1[:, None] + row[None, :]
    dense[one >> 8, one & 255] = bits1
    return Tree(Sparse(grams, bits3), Sparse(context3, out3), Sparse(two, bits2), escape2, dense.astype(np.float32).reshape(-1))


def _bits(tree: Tree, key: np.ndarray) -> np.ndarray:
    """The bits of each byte; ``key`` is the three bytes before it and the byte."""
    bits, found = tree.hit3.get(key)
    left = np.flatnonzero(~found)
    if len(left):
        k = key[left]
        two, found = tree.hit2.get(k & np.uint32(0xFFFFFF))
        rest = tree.escape2[(k >> np.uint32(8)) & np.uint32(0xFFFF)] + tree.one[k & np.uint32(0xFFFF)]
        bits[left] = tree.escape3.get(k >> np.uint32(8))[0] + np.where(found, two, rest)
    return bits


def code_lengths(model: PPMModel, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bits of each text (rows) under each language (columns); ``off`` are byte offsets."""
    lengths = np.diff(off)
    out = np.zeros((len(lengths), len(model.langs)))
    for lo in range(0, len(raw), CHUNK):
        hi = min(len(raw), lo + CHUNK)
        a = max(0, lo - ORDER)                             # the context may lie in the chunk before
        first, last = np.searchsorted(off, a, "right") - 1, np.searchsorted(off, hi, "left")
        starts = off[first:last]
        inside = starts >= a
        local, local_len = (starts - a)[inside], np.minimum(lengths[first:last][inside], hi - off[first:last][inside])
        sym = raw[a:hi]
        key = np.zeros(hi - a, dtype=np.uint32)
        for back in (3, 2, 1):
            key = (key << np.uint32(8)) | _previous(sym, local, local_len, back, PAD)
        key = ((key << np.uint32(8)) | sym)[lo - a:]
        seg = np.clip(off[first:last + 1] - lo, 0, hi - lo)
        for li, tree in enumerate(model.trees):
            out[first:last, li] += segment_sums(_bits(tree, key), seg)
    return out


def _has_letter(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    folded = raw | 32
    ascii_letter = (folded >= 97) & (folded <= 122) & (raw < 128)
    found = segment_sums(ascii_letter.astype(np.float32), off) > 0
    for i in np.flatnonzero(~found & (np.diff(off) > 0)):
        found[i] = any(ch.isalpha() for ch in raw[off[i]:off[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


RESULT = ["lang_pred", "score", "bits_per_byte"]


def detect(docs: DataFrame, model: PPMModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (posterior of the shortest code among the
    languages) and ``bits_per_byte`` (the shortest code's bits by the text's bytes; null for
    ``und``)."""
    return with_struct(docs, scorer(docs.sparkSession, model)(F.col(text_col)), RESULT)


def scorer(spark: SparkSession, model: PPMModel):
    """A Column function: text -> struct of the fields in ``RESULT``."""
    shared = spark.sparkContext.broadcast(model)            # bounded by MODEL_BYTES

    @F.arrow_udf("lang_pred string, score double, bits_per_byte double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for texts in batches:
            raw, off, valid = utf8_buffers(texts)
            known = valid & _has_letter(raw, off) & bool(m.langs)
            names = np.full(len(valid), UNDETERMINED, dtype=object)
            prob = np.zeros(len(valid))
            rate = np.full(len(valid), np.nan)
            if m.langs and len(valid):
                bits = code_lengths(m, raw, off)
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(best)), best]
                p = 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                names[known] = np.array(m.langs, dtype=object)[best][known]
                prob[known] = p[known]
                rate[known] = (least / np.maximum(1, np.diff(off)))[known]
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(prob),
                 pa.array(rate, pa.float64(), mask=~known)], names=RESULT)

    return score


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: crc32 of the id's text modulo 4 is not 2 (nor null)."""
    return docs.where(id_remainder(F.col("doc_id"), 4) != 2)


def is_accepted(result: Column) -> Column:
    """The filter's decision on a ``scorer`` result: a language was found and the text codes
    better than raw bytes."""
    return (result["lang_pred"] != UNDETERMINED) & (result["bits_per_byte"] < 8.0)
