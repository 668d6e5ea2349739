"""Toxicity scores by FTRL-proximal logistic regression (operator 4).

Features are hashed word n-grams and skip-grams of the whole text: words, pairs, and pairs
over a gap of one or two words, each a 32-bit hash, value 1 if present.  FTRL-proximal
learns with a rate for each coordinate, and its L1 term keeps rare or uninformative
coordinates at exactly zero, so the model is a short list of (hash, weight) pairs that is
broadcast to score every document.

Training is spread over shards of bounded size by Spark: each shard runs FTRL over its own
documents in an order given by a hash, the shards' weights are averaged (a weight that a
shard has at zero counts as zero).

Defined results: null and empty texts have no feature and score the intercept.  No label
to learn from: every score is 0.  One class only: the scores approach that class.
Repeated label rows of a document count as one (toxic if any says so).  Rows are scored
independently; input columns named as a result column are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.llm.common import id_remainder, with_struct

TRAIN_DOCS = 16_000           # bound of the labelled sample (expected size, whole texts)
SHARD_DOCS = 4_000            # bound of a shard (expected size): FTRL is sequential inside it
EPOCHS = 5
MAX_WEIGHTS = 1 << 16         # bound of the broadcast model; the largest weights stay
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.0
PREFILTER_BITS = 22

_ASCII = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
# one odd multiplier for each kind: the word itself, the next word, the word after a gap of 1 and of 2
_KINDS = tuple(np.uint64(m) for m in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63))


def features(text: str | None) -> np.ndarray:
    """Distinct 32-bit hashes of a text's words, pairs and skip-pairs (case is folded and
    ASCII punctuation separates words)."""
    return np.unique(_hashes(text))


def _hashes(text: str | None) -> np.ndarray:
    words = (text or "").lower().encode("utf-8", "replace").translate(_ASCII).split()
    if not words:
        return np.zeros(0, dtype=np.uint32)
    h = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))
    parts = [h * _KINDS[0]]
    for gap in (1, 2, 3):
        if len(h) > gap:
            parts.append((h[:-gap] * _KINDS[gap]) ^ (h[gap:] * _KINDS[0]))
    x = np.concatenate(parts)
    x ^= x >> np.uint64(29)
    x *= _MIX
    return (x >> np.uint64(32)).astype(np.uint32)


@dataclass
class ToxicityModel:
    hashes: np.ndarray        # sorted, uint32
    weights: np.ndarray
    intercept: float


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + float(np.exp(-min(max(x, -35.0), 35.0))))


def ftrl(docs: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, alpha: float = ALPHA,
         beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over documents given as arrays of feature hashes, in the given order.

    Returns (hashes, weights) of the coordinates that are not zero, and the intercept (a
    coordinate without L1)."""
    if not docs:
        return np.zeros(0, np.uint32), np.zeros(0), 0.0
    ids, flat = np.unique(np.concatenate(docs), return_inverse=True)
    ends = np.cumsum([len(d) for d in docs])
    z, n = np.zeros(len(ids)), np.zeros(len(ids))
    zb = nb = 0.0

    def weight(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for i, end in enumerate(ends):
            at = flat[end - len(docs[i]):end]
            zi, ni = z[at], n[at]
            w = weight(zi, ni)
            wb = -zb / ((beta + nb ** 0.5) / alpha + l2)
            g = _sigmoid(float(w.sum()) + wb) - float(labels[i])
            grown = ni + g * g
            z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[at] = grown
            zb += g - ((nb + g * g) ** 0.5 - nb ** 0.5) / alpha * wb
            nb += g * g
    w = weight(z, n)
    on = w != 0
    return ids[on].astype(np.uint32), w[on], -zb / ((beta + nb ** 0.5) / alpha + l2)


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS,
          shard_docs: int = SHARD_DOCS) -> ToxicityModel:
    """Learn ``toxic`` of ``labels`` (doc_id, toxic) from the texts of ``docs`` (doc_id, text).

    A hash sample by id of about ``train_docs`` labelled documents is used, whole texts.
    Its ids are few by that bound and are broadcast, so the texts are not shuffled to find
    them."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
             .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    total = known.count()
    shards = max(1, round(min(total, train_docs) / shard_docs))
    slots = 1 << 24
    share = int(min(1.0, train_docs / max(1, total)) * slots)
    # the limit never binds on hashed ids (it is four times the expected size): it proves the broadcast's bound
    sample = (known.where(F.pmod(F.xxhash64("doc_id"), F.lit(slots)) < share).limit(4 * train_docs))
    rows = (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
            .withColumn("order", F.xxhash64("doc_id", "text"))
            .withColumn("shard", F.pmod(F.col("order"), F.lit(shards)).cast("int")))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "doc_id", "toxic"])
        h, w, b = ftrl([features(t) for t in pdf["text"]], pdf["toxic"].to_numpy(dtype=float))
        return pd.DataFrame({"h": np.append(h.astype(np.int64), -1), "w": np.append(w, b)})

    parts = rows.groupBy("shard").applyInPandas(fit, "h long, w double")
    merged = parts.groupBy("h").agg(F.sum("w").alias("w"), F.count("*").alias("k"))
    got = merged.orderBy((F.col("h") == -1).desc(), F.abs("w").desc(), "h").limit(MAX_WEIGHTS + 1).toPandas()
    if got.empty:
        return ToxicityModel(np.zeros(0, np.uint32), np.zeros(0), -35.0)
    used = int(got.loc[got["h"] == -1, "k"].iloc[0])
    b = float(got.loc[got["h"] == -1, "w"].iloc[0]) / used
    got = got[got["h"] != -1].sort_values("h")
    return ToxicityModel(got["h"].to_numpy(dtype=np.uint32), got["w"].to_numpy() / used, b)


def logits(model: ToxicityModel, texts: list[str | None]) -> np.ndarray:
    """Intercept plus the weights of each text's distinct features."""
    mask = np.zeros(1 << PREFILTER_BITS, dtype=bool)
    shift = np.uint32(32 - PREFILTER_BITS)
    mask[model.hashes >> shift] = True
    out = np.full(len(texts), model.intercept)
    if not len(model.hashes):
        return out
    for i, t in enumerate(texts):
        h = _hashes(t)
        h = np.unique(h[mask[h >> shift]])
        if len(h):
            at = np.minimum(np.searchsorted(model.hashes, h), len(model.hashes) - 1)
            out[i] += model.weights[at][model.hashes[at] == h].sum()
    return out


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if the score is 0.5 or more)."""
    return with_struct(docs, scorer(docs.sparkSession, model)(F.col(text_col)), ["score", "predicted"])


def scorer(spark: SparkSession, model: ToxicityModel):
    """A Column function: text -> struct of score and predicted."""
    shared = spark.sparkContext.broadcast(model)               # bounded by MAX_WEIGHTS

    @F.arrow_udf("score double, predicted int")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            x = logits(shared.value, texts.to_pylist())
            p = 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))
            p[x <= -35] = 0.0
            yield pa.StructArray.from_arrays([pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                                             names=["score", "predicted"])

    return run


def training_labels(labels: DataFrame) -> DataFrame:
    """Label rows that may be learned from: crc32 of the id's text modulo 5 is not 0 (nor null)."""
    return labels.where(id_remainder(F.col("doc_id"), 5) != 0)
