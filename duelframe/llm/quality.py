"""Quality rules by hashed n-gram likelihood ratios (operator 3); SQL functions only.

Every word and every pair of neighbouring words of a text is hashed into ``BUCKETS``
buckets.  Two multinomials over the buckets are estimated with add-one smoothing: the target
from trusted documents, the raw one from all documents.  A document's score is the sum of
``log(target / raw)`` over its n-grams, divided by their number; a document is kept if its
score is at least ``THRESHOLD``, a constant, so the verdict on a document depends on the two
estimates and on nothing else.

Before that come rules on the text itself (see ``measures``): documents of fewer than ten
words, or with more than a fifth of their words inside five-word windows that occur again,
are not kept.

The raw counts cover all documents.  The trusted ids are a hash sample of at most
``TRUSTED_DOCS``, by which bound they can be broadcast: no text is shuffled.

Defined results: null and empty texts have no word and fail the rules; score 0.  No trusted
document: every score is 0.  A null id is never trusted.  Repeated rows count as often as
they occur.  Empty table: no rows.  Input columns named as a result column are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import with_struct

BUCKETS = 1 << 14
TRUSTED_DOCS = 20_000
THRESHOLD = -0.15
MIN_WORDS = 10
WINDOW = 5
REPEAT_PERCENT = 20

_SPACE = r"[\x20\x09-\x0D]"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE + "+"), "")


def _repeated(h: Column) -> Column:
    """Number of words inside windows of ``WINDOW`` words that occur more than once."""
    n = F.size(h) - (WINDOW - 1)
    windows = F.transform(F.sequence(F.lit(0), n - 1),
                          lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def covered(at: Column) -> Column:
        # starts of repeated windows, ascending: each covers up to the next one's start
        return F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))),
                           F.lit(0), lambda a, x: a + x)

    def again(s: Column) -> Column:
        # s: (hash, start) in order of hash, so equal windows are neighbours
        hit = F.filter(s, lambda e, k: (F.get(s, k - 1)["h"].eqNullSafe(e["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(e["h"])))
        return _let(F.array_sort(F.transform(hit, lambda e: e["i"])), covered)

    def count(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(_let(pairs, again))

    return F.when(n < 2, 0).otherwise(_let(windows, count))


def _grams(h: Column, buckets: int) -> Column:
    """Buckets of the words and of the pairs of neighbours."""
    b = F.lit(buckets)
    pairs = F.when(F.size(h) < 2, F.array().cast("array<int>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(h) - 2),
                    lambda i: F.pmod(F.xxhash64(F.get(h, i), F.get(h, i + 1)), b).cast("int")))
    return F.concat(F.transform(h, lambda x: F.pmod(x, b).cast("int")), pairs)


def hashed_words(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def measures(text: Column, weights: Column | None = None, buckets: int = BUCKETS) -> Column:
    """Struct of the rules' counts and, with ``weights`` (log ratio by bucket), the score."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))

    def of_words(h: Column) -> Column:
        out = [F.size(h).cast("long").alias("n_words"), _repeated(h).cast("long").alias("n_repeat_words")]
        if weights is not None:
            score = _let(_grams(h, buckets), lambda g: F.when(F.size(g) == 0, 0.0).otherwise(
                F.aggregate(g, F.lit(0.0), lambda a, x: a + F.get(weights, x)) / F.size(g)))
            out.append(score.alias("score"))
        return F.struct(*out)

    w = _let(hashed_words(text), of_words)
    whole = F.length(text)
    fields = [F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
              (whole - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
              dup.cast("long").alias("n_dup_lines")]
    return F.struct(*fields, w.alias("w"))


def log_ratios(docs: DataFrame, trusted: DataFrame, text_col: str = "text", id_col: str = "doc_id",
               buckets: int = BUCKETS, trusted_docs: int = TRUSTED_DOCS) -> list[float]:
    """``log(target / raw)`` by bucket; ``trusted`` has the ids of trusted documents."""
    ids = (trusted.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct()
           .orderBy(F.xxhash64("_id"), "_id").limit(trusted_docs).withColumn("_trusted", F.lit(1)))
    grams = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
             .join(F.broadcast(ids), "_id", "left")
             .select("_trusted", F.explode(_let(hashed_words(F.col("_t")), lambda h: _grams(h, buckets))).alias("b")))
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.count("_trusted").alias("target")).collect()
    raw, target = [1] * buckets, [1] * buckets         # bounded by the number of buckets
    for r in counts:
        raw[r["b"]] += r["raw"]
        target[r["b"]] += r["target"]
    if sum(target) == buckets:
        return [0.0] * buckets
    shift = math.log(sum(raw)) - math.log(sum(target))
    return [math.log(t) - math.log(n) + shift for t, n in zip(target, raw)]


RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]


def judge(docs: DataFrame, ratios: list[float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``score`` and ``kept``."""
    # one constant array: parsed once when the query is planned
    weights = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    m = measures(F.col(text_col), weights, len(ratios))

    def verdict(x: Column) -> Column:
        w = x["w"]
        failed = (w["n_words"] < MIN_WORDS) | (100 * w["n_repeat_words"] > REPEAT_PERCENT * w["n_words"])
        return F.struct(w["n_words"].alias("n_words"), x["word_chars"].alias("word_chars"),
                        x["n_symbols"].alias("n_symbols"), x["n_dup_lines"].alias("n_dup_lines"),
                        w["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"),
                        w["score"].alias("score"), (~failed & (w["score"] >= threshold)).alias("kept"))

    return with_struct(docs, _let(m, verdict), RESULT)
