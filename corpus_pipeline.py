"""A corpus from raw documents to training batches: the operators of ``duelframe.llm`` in order.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and reread as the next one's ``docs``.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.llm import langid, neardup, packing, secrets, toxicity
from duelframe.llm.common import prepare, table
from duelframe.session import materialize


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents without a recognised language go (no text, no letter, or a text
    that no learned language codes better than raw bytes).  If no language can be learned, as no
    document that may be learned from carries one, every text with a letter stays."""
    prepare(spark)
    model = langid.train(langid.training_rows(docs))
    if not model.langs:
        return docs.where(F.regexp_like(F.col("text"), F.lit(r"\p{L}")))
    result = langid.scorer(spark, model)(F.col("text"))
    return (docs.withColumn("_llm_result", result).where(langid.is_accepted(F.col("_llm_result")))
            .drop("_llm_result"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents scored 0.5 or more go."""
    prepare(spark)
    model = toxicity.train(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    result = toxicity.scorer(spark, model)(F.col("text"))
    return docs.withColumn("_llm_result", result).where("_llm_result.predicted = 0").drop("_llm_result")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: one document of each class of near duplicates stays."""
    prepare(spark)
    return neardup.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: secrets in the texts are masked (``n_chars`` follows the new text)."""
    prepare(spark)
    found = secrets.scanner(spark, secrets.fit(docs), with_text=True)(F.col("text"))
    changed = docs.withColumn("_llm_result", found)
    out = {"text": F.col("_llm_result.redacted"),
           "n_chars": F.when(F.col("_llm_result.spans") == "", F.col("n_chars"))
                       .otherwise(F.length("_llm_result.redacted").cast("long"))}
    return changed.select(*[out.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the place of every document in a length bucket and batch."""
    prepare(spark)
    rows = docs.select("doc_id", "lang", "source", packing.word_count(F.col("text")).alias("_llm_words"))
    return packing.pack(rows, F.col("_llm_words")).drop("_llm_words")


STAGES = [
    ("language", keep_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack_batches),
]

# Trained models, sketches and a dynamic program: not expressible in SQL; tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(prepare(spark), sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
