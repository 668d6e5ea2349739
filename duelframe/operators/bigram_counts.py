"""Bigram counts of whole texts, combined inside a task before Spark shuffles them.

Texts are cut at white space and counted a few megabytes at a time on Arrow and NumPy arrays; a task
gives one row for each distinct bigram of such a piece.  Spark sums the rows of all pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.session import ship_package

PIECE_BYTES = 8 << 20        # text counted at once (a longer text is a piece of its own)
ROWS_OUT = 1 << 16           # rows of an Arrow batch that goes back

PREV_FACTOR, W_FACTOR = 0x5BD1E995, 0x7FEB352D     # odd, below 2 ** 31


def _may_be_key(vocab: pa.Array, prev: np.ndarray, w: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the map of keys holds the slot of each bigram (``scoring.may_be_key`` on codes of words)."""
    _, offsets, data = vocab.buffers()
    ends, raw = np.frombuffer(offsets, np.int32)[vocab.offset:vocab.offset + len(vocab) + 1].tolist(), data.to_pybytes()
    crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(ends, ends[1:])), np.int64, len(vocab))
    h = (crc * PREV_FACTOR).take(prev)                     # scoring._slot
    h ^= (crc * W_FACTOR).take(w)
    h >>= 16
    at = (h % len(bits)) * 8 + ((h >> 26) & 7)
    h >>= 20
    h &= 63
    return (bits.reshape(-1).take(at) >> h) & 1 == 1


def _pieces(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """The rows of ``batches`` (text first) in tables of about ``limit`` bytes of text."""
    held, size = [], 0
    for b in batches:
        n = pc.fill_null(pc.binary_length(b.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(n) // limit)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(n)]):
            held.append(b.slice(lo, hi - lo))
            size += int(n[lo:hi].sum())
            if size >= limit:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _rows(prev: pa.Array, w: pa.Array, counts: np.ndarray, starts: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    columns = [prev, w, *[pa.array(np.ascontiguousarray(c)) for c in (*counts.T, *starts.T)]]
    whole = pa.RecordBatch.from_arrays(columns, names=names)
    for at in range(0, whole.num_rows, ROWS_OUT):
        yield whole.slice(at, ROWS_OUT)


def _count_piece(piece: pa.Table, only_first: bool, names: list[str],
                 bits: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Words under a NULL prev (each word, or the texts' first ones) and bigrams of one piece."""
    texts = pc.fill_null(piece.column(0), "").combine_chunks()
    flags = np.stack([c.to_numpy().astype(np.int64) for c in piece.columns[1:]], axis=1)
    cut = pc.ascii_split_whitespace(texts)                       # the six characters of \s
    words = cut.flatten()
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(cut).to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(words), 0)
    words, doc = words.filter(full), doc[full.to_numpy(zero_copy_only=False)]
    if not len(words):
        return
    coded = words.dictionary_encode()
    vocab, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    v = len(vocab)
    kinds, of_doc = np.unique(flags, axis=0, return_inverse=True)      # which models' corpora hold a text
    kind, k = of_doc.reshape(-1)[doc], len(kinds)
    follows = doc[1:] == doc[:-1]                                      # a token and the next one are of one text
    at = np.flatnonzero(np.append(True, ~follows)) if only_first else np.arange(len(code))
    seen = np.bincount((code[at] * k + kind[at]) * 2 + np.append(follows, False)[at], minlength=v * k * 2).reshape(v, k, 2)
    some = np.flatnonzero(seen.sum(axis=(1, 2)))
    yield from _rows(pa.nulls(len(some), pa.string()), vocab.take(pa.array(some)), seen[some].sum(axis=2) @ kinds,
                     seen[some, :, 1] @ kinds, names)
    first, second, kind = code[:-1][follows], code[1:][follows], kind[1:][follows]
    if bits is not None:
        asked = _may_be_key(vocab, first, second, bits)
        first, second, kind = first[asked], second[asked], kind[asked]
    pair, n = np.unique((first * v + second) * k + kind, return_counts=True)
    if not len(pair):
        return
    new = np.flatnonzero(np.diff(pair // k, prepend=-1))
    counts = np.add.reduceat(n[:, None] * kinds[pair % k], new)
    prev, w = np.divmod(pair[new] // k, v)
    yield from _rows(vocab.take(pa.array(prev)), vocab.take(pa.array(w)), counts, np.zeros_like(counts), names)


def bigram_rows(docs: DataFrame, models: Mapping[str, Column], text_col: str = "text", only_first: bool = False,
                bits: np.ndarray | None = None) -> DataFrame:
    """Partial counts of whole texts, to be summed by (prev, w): prev, w, c_<m>..., x_<m>...

    A bigram counts for the models whose corpus holds its text.  Rows with a NULL prev count words: every
    word, with ``x_<m>`` for how often it starts a bigram, or with ``only_first`` the texts' first words.
    ``bits`` (``scoring.key_bits``) drops most bigrams that are no scored key before they leave the task."""
    ship_package(docs.sparkSession)
    sent = None if bits is None else docs.sparkSession.sparkContext.broadcast(bits.tobytes())
    ids = list(models)
    names = ["prev", "w", *[f"c_{m}" for m in ids], *[f"x_{m}" for m in ids]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = None if sent is None else np.frombuffer(sent.value, dtype=np.int64).reshape(-1, 8)
        for piece in _pieces(batches, PIECE_BYTES):
            yield from _count_piece(piece, only_first, names, asked)

    flags = [F.coalesce(c, F.lit(False)).cast("long").alias(f"f_{m}") for m, c in models.items()]
    return docs.select(F.col(text_col), *flags).mapInArrow(run, "prev string, w string, " + ", ".join(f"{n} long" for n in names[2:]))
