"""Scores of models outside Spark's expressions (L5), and scores that are kept.

``external_scores`` runs a model inside the Python workers: loaded once for each worker, given
batches of similar length.  ``ScoreStore`` keeps the scores of frozen models under the digest
of what was scored, so a later run scores new texts and new models only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.functions.text import tokens
from duelframe.operators.scoring import NO_CONTEXT, predecessor_rows
from duelframe.session import materialize, path_exists, ship_package

BATCH_TOKENS = 16_384

_LOADED: dict[str, Any] = {}        # of one worker process


@dataclass(frozen=True)
class ExternalScorer:
    """A model that scores answers in Python.

    ``load()`` runs once in each worker process and returns the model (from a broadcast, or a path that
    all workers read).  ``score(model, contexts, answers)`` gets the last prompt word (or None) and
    the answer's tokens of a batch and returns the summed log-probability of each answer.  A batch
    holds answers of similar length; filled up to its longest it stays within ``batch_tokens``, unless
    one answer alone is longer."""

    model_id: str
    load: Callable[[], Any]
    score: Callable[[Any, list, list], Sequence[float]]
    batch_tokens: int = BATCH_TOKENS
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def model(self) -> Any:
        if self.key not in _LOADED:
            _LOADED[self.key] = self.load()
        return _LOADED[self.key]


def length_batches(lengths: np.ndarray, batch_tokens: int) -> Iterator[np.ndarray]:
    """Positions of a block of rows, shortest first, in batches within the token budget."""
    order = np.argsort(lengths, kind="stable")
    first = 0
    for k in range(1, len(order) + 1):
        if k == len(order) or (k + 1 - first) * lengths[order[k]] > batch_tokens:
            yield order[first:k]
            first = k


def external_scores(side_rows: DataFrame, scorer: ExternalScorer) -> DataFrame:
    """pair_id, side, n_tokens, sum_<m> and mean_<m> (NULL for an answer without tokens).

    Rows are sorted by length inside their partitions first (no shuffle), so that whole Arrow
    batches hold similar lengths; nothing is gathered."""
    spark = side_rows.sparkSession
    ship_package(spark)
    m = scorer.model_id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            context, answers = b.column("context0").to_pylist(), [x or [] for x in b.column("answer_tokens").to_pylist()]
            n = np.array([len(x) for x in answers], dtype=np.int64)
            total = np.zeros(len(n))
            for rows in length_batches(n, scorer.batch_tokens):
                rows = rows[n[rows] > 0]
                if len(rows):
                    total[rows] = scorer.score(scorer.model(), [context[i] for i in rows], [answers[i] for i in rows])
            yield pa.RecordBatch.from_arrays([b.column("pair_id"), b.column("side"), pa.array(n), pa.array(total, mask=n == 0)],
                                             names=["pair_id", "side", "n_tokens", f"sum_{m}"])

    kind = dict(side_rows.dtypes)
    rows = side_rows.select("pair_id", "side", "context0", "answer_tokens").sortWithinPartitions(F.size("answer_tokens"))
    out = rows.mapInArrow(run, f"pair_id {kind['pair_id']}, side string, n_tokens bigint, `sum_{m}` double")
    return out.withColumn(f"mean_{m}", F.col(f"sum_{m}") / F.col("n_tokens"))


# ---------------------------------------------------------------- a bounded external model

CLASSES = 256


def word_class(w: Column) -> Column:
    """One of ``CLASSES`` classes: the first byte of the word's MD5."""
    return F.conv(F.substring(F.md5(w), 1, 2), 16, 10).cast("int")


def class_bigram(docs: DataFrame, model_id: str = "classes", text_col: str = "text") -> ExternalScorer:
    """A bigram model over word classes, fitted on Spark and scored outside it:
    p(w | v) = (c(v, w) + 1) / (c(v) + 256) with the counts of classes.  Its table has 65,536
    entries whatever the corpus, and goes to the workers as a broadcast of 512 KB."""
    spark = docs.sparkSession
    pairs = docs.select(F.inline(predecessor_rows(tokens(F.col(text_col))))).where("prev IS NOT NULL AND w IS NOT NULL")
    counts = pairs.groupBy(word_class(F.col("prev")).alias("v"), word_class(F.col("w")).alias("w")).agg(F.count(F.lit(1)).alias("c"))
    table = np.zeros((CLASSES, CLASSES))
    for r in counts.collect():                     # at most CLASSES * CLASSES rows
        table[r["v"], r["w"]] = r["c"]
    sent = spark.sparkContext.broadcast(table.tobytes())

    def load():
        c = np.frombuffer(sent.value).reshape(CLASSES, CLASSES)
        return np.log((c + 1.0) / (c.sum(axis=1, keepdims=True) + CLASSES))

    return ExternalScorer(model_id, load, _class_sums)


def _class_sums(logp: np.ndarray, contexts: list, answers: list) -> np.ndarray:
    from hashlib import md5

    known: dict[str, int] = {}

    def of(w: str) -> int:
        if w not in known:
            known[w] = md5(w.encode()).digest()[0]
        return known[w]

    longest = max(map(len, answers))
    at = np.zeros((len(answers), longest + 1), dtype=np.int64)
    for i, (c, a) in enumerate(zip(contexts, answers)):
        at[i, :len(a) + 1] = [of(NO_CONTEXT if c is None else c), *map(of, a)]
    real = np.arange(longest)[None, :] < np.array([len(a) for a in answers])[:, None]
    return (logp[at[:, :-1], at[:, 1:]] * real).sum(axis=1)


# ---------------------------------------------------------------- kept scores

def answer_digest() -> Column:
    """The digest of what a score depends on: the last prompt word and the answer's tokens."""
    return F.sha2(F.concat(F.coalesce("context0", F.lit(NO_CONTEXT)), F.lit("\n"),
                           F.coalesce(F.array_join("answer_tokens", " "), F.lit(""))), 256)


class ScoreStore:
    """Scores of frozen models in a folder: model, digest, n_tokens, sum_logp.

    A model's name in the store must stand for one fit.  ``score`` adds what is missing and
    returns all; ``added`` is the number of scores that the last call computed.  A run that dies
    while it writes leaves some of its scores or none, and the next run adds the rest."""

    SCHEMA = "digest string, n_tokens bigint, sum_logp double, model string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.added = spark, path, 0

    def table(self) -> DataFrame:
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def missing(self, answers: DataFrame, model_ids: Sequence[str]) -> DataFrame:
        """Distinct ``answers`` (digest, context0, answer_tokens) that lack a score of a model, with
        ``todo``, the models they lack."""
        held = (self.table().where(F.col("model").isin(list(model_ids))).groupBy(F.col("digest").alias("_digest"))
                .agg(F.collect_set("model").alias("_models")))              # at most one entry a model
        every = F.array(*[F.lit(m) for m in model_ids])
        once = answers.groupBy("digest").agg(F.first(F.struct("context0", "answer_tokens")).alias("_a"))
        return (once.join(held, once["digest"] == held["_digest"], "left")
                .select("digest", "_a.context0", "_a.answer_tokens",
                        F.array_except(every, F.coalesce("_models", F.array().cast("array<string>"))).alias("todo"))
                .where(F.size("todo") > 0))

    def score(self, side_rows: DataFrame, model_ids: Sequence[str], scorer: Callable[[DataFrame, tuple], DataFrame]) -> DataFrame:
        """pair_id, side, n_tokens, sum_<m>, mean_<m> of ``side_rows``.  ``scorer(rows, ids)`` is given
        rows of the shape of sides that have no score yet and returns n_tokens and sum_<m> by pair_id."""
        answers = materialize(side_rows.select("pair_id", "side", answer_digest().alias("digest"), "context0", "answer_tokens"), "answers")
        todo = materialize(self.missing(answers, model_ids), "unscored")
        lacking = tuple(r["m"] for r in todo.select(F.explode("todo").alias("m")).distinct().orderBy("m").collect())
        self.added = 0
        if lacking:
            rows = todo.select(F.col("digest").alias("pair_id"), F.lit("").alias("side"), "context0", "answer_tokens")
            new = scorer(rows, lacking)
            long = F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"sum_{m}").alias("sum_logp")) for m in lacking]))
            new = new.select(F.col("pair_id").alias("digest"), F.col("n_tokens").cast("bigint").alias("n_tokens"), long)
            wanted = todo.select(F.col("digest").alias("_d"), F.explode("todo").alias("_m"))
            new = new.join(wanted, (new["digest"] == wanted["_d"]) & (new["model"] == wanted["_m"]), "left_semi")
            new.select("digest", "n_tokens", "sum_logp", "model").write.mode("append").partitionBy("model").parquet(self.path)
            self.added = wanted.count()
        kept = self.table().where(F.col("model").isin(list(model_ids))).groupBy("digest").agg(
            F.max("n_tokens").alias("n_tokens"), *[F.max(F.when(F.col("model") == m, F.col("sum_logp"))).alias(f"sum_{m}") for m in model_ids])
        out = answers.select("pair_id", "side", "digest").join(kept, "digest").drop("digest")
        return out.select("*", *[F.when(F.col("n_tokens") > 0, F.col(f"sum_{m}") / F.col("n_tokens")).alias(f"mean_{m}") for m in model_ids])
