"""Scoring (L2-L8): token log-probabilities under a policy and a reference model.

Built-in scorer: an interpolated bigram model fitted by counting on Spark,

    p(w | v) = (c(v, w) + alpha * p_uni(w)) / (c(v) + alpha),
    p_uni(w) = (c(w) + 1) / (N + V + 1),

with c(v) the number of bigrams that start with v, N the model's token count and V the
vocabulary of the whole corpus.  Several models are fitted in one pass: every document
row carries one 0/1 membership flag per model and every count table has one column per
model, so scoring needs one join per count table whatever the number of models.

External models plug in through ``external_sequence_logps`` (Arrow-batched mapInPandas).
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.operators.bigram_counts import PREV_FACTOR, W_FACTOR, bigram_rows
from duelframe.session import materialize

# Fixed value of the built-in scorer (FIXTURES.md F5): interpolation weight.
DEFAULT_ALPHA = 100.0


def _safe(model_id: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", model_id):
        raise ValueError(f"model id {model_id!r} must be an identifier")
    return model_id


@dataclass
class BigramModel:
    """Count tables of one or more bigram models (columns ``c_<model_id>``)."""

    model_ids: tuple[str, ...]
    bigrams: DataFrame    # prev, w, c_<m>...
    unigrams: DataFrame   # w, c_<m>...
    contexts: DataFrame   # prev, c_<m>...
    totals: DataFrame     # one row: n_<m>..., vocab
    alpha: float = DEFAULT_ALPHA

    def persist(self, storage_level=None) -> "BigramModel":
        for df in (self.bigrams, self.unigrams, self.contexts):
            df.persist() if storage_level is None else df.persist(storage_level)
        return self

    def save(self, path: str, mode: str = "overwrite") -> None:
        """Frozen models (a reference model in particular) are fitted once and reused."""
        self.bigrams.write.mode(mode).parquet(f"{path}/bigrams")
        self.unigrams.write.mode(mode).parquet(f"{path}/unigrams")
        self.contexts.write.mode(mode).parquet(f"{path}/contexts")
        self.totals.write.mode(mode).parquet(f"{path}/totals")

    @classmethod
    def load(cls, spark, path: str, alpha: float = DEFAULT_ALPHA) -> "BigramModel":
        bg = spark.read.parquet(f"{path}/bigrams")
        ids = tuple(c[2:] for c in bg.columns if c.startswith("c_"))
        return cls(ids, bg, spark.read.parquet(f"{path}/unigrams"), spark.read.parquet(f"{path}/contexts"),
                   spark.read.parquet(f"{path}/totals"), alpha)


def predecessor_rows(token_col: Column) -> Column:
    """Every token with its predecessor (NULL for a text's first token) as an array of structs.

    Built with ``arrays_zip`` (generated code, no per-element lambda).
    """
    t = token_col
    prev = F.slice(F.concat(F.array(F.lit(None).cast("string")), t), F.lit(1), F.size(t))   # none for an empty text
    return F.arrays_zip(prev, t).cast("array<struct<prev:string,w:string>>")


def fit_bigram(docs: DataFrame, models: Mapping[str, Column], text_col: str = "text",
               alpha: float = DEFAULT_ALPHA, write_counts: bool = True) -> BigramModel:
    """L5 fit: count unigrams and bigrams of whole documents for every model at once.

    ``models`` maps a model id to a boolean Column saying whether a document belongs to
    that model's corpus (spread an input of few splits first, see ``sources.tables.spread``).
    One grouped sum over (prev, w) rows -- with a NULL prev for
    each document's first token -- yields everything: bigram counts are its non-NULL
    rows, unigram counts its sums by w, context counts the bigram sums by prev.  The
    token rows are shuffled once, counted before that inside a task (``bigram_rows``), so the
    frequent head of the word distribution collapses map-side.  ``write_counts=False`` leaves the
    tables lazy, for a caller that reads one of them once.
    """
    ids = tuple(_safe(m) for m in models)
    allp = (bigram_rows(docs, models, text_col, only_first=True)
            .groupBy("prev", "w").agg(*[F.sum(f"c_{m}").alias(f"c_{m}") for m in ids]))
    if write_counts:
        # The fitted counts feed four tables; write them once to the shared checkpoint
        # folder so the document corpus is tokenised and shuffled exactly once, and the
        # derived tables are aggregated once instead of in every scoring job.
        allp = materialize(allp, "bigram-counts")
    bi = allp.where(F.col("prev").isNotNull())
    uni = allp.groupBy("w").agg(*[F.sum(f"c_{m}").alias(f"c_{m}") for m in ids])
    ctx = bi.groupBy("prev").agg(*[F.sum(f"c_{m}").alias(f"c_{m}") for m in ids])
    if write_counts:
        uni = materialize(uni, "unigram-counts")
        ctx = materialize(ctx, "context-counts")
    totals = uni.agg(*[F.coalesce(F.sum(f"c_{m}"), F.lit(0)).alias(f"n_{m}") for m in ids], F.count(F.lit(1)).alias("vocab"))
    if write_counts:
        totals = materialize(totals, "model-totals")
    return BigramModel(ids, bi, uni, ctx, totals, alpha)


# The map of scored keys: BLOCKS rows of eight 64-bit words (8 MB broadcast, whatever the keys).
BLOCKS = 1 << 17
SLOTS = BLOCKS * 512


def _slot() -> Column:
    """A hash of (prev, w), of the CRC32 of both words, that the counting tasks compute too."""
    prev, w = (F.crc32(F.col(c).cast("binary")) for c in ("prev", "w"))
    return F.shiftright((prev * F.lit(PREV_FACTOR)).bitwiseXOR(w * F.lit(W_FACTOR)), 16)


def key_map(keys: DataFrame) -> DataFrame:
    """A bitmap of the hashes of ``keys`` (prev, w): at most ``BLOCKS`` rows _block, _b0 ... _b7."""
    h = keys.select(_slot().alias("h")).select(
        F.pmod("h", F.lit(BLOCKS)).alias("_block"), F.shiftright("h", 20).alias("r"))
    bit = F.expr("shiftleft(1L, int(r & 63))")
    return h.groupBy("_block").agg(*[
        F.bit_or(F.when(F.shiftright("r", 6).bitwiseAND(F.lit(7)) == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"_b{i}")
        for i in range(8)])


def may_be_key(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """``rows`` (prev, w, ...) without most of those that are no key: every key stays, and so do a few
    others whose hash shares a slot with a key's, and rows with a NULL prev."""
    cols = rows.columns
    j = rows.withColumn("_h", _slot()).withColumn("_at", F.pmod("_h", F.lit(BLOCKS)))
    j = j.join(F.broadcast(bits), F.col("_at") == F.col("_block"), "left")
    word = F.expr("CASE int(shiftright(_h, 26) & 7) " + " ".join(f"WHEN {i} THEN _b{i}" for i in range(8)) + " END")
    hit = F.expr("shiftleft(1L, int(shiftright(_h, 20) & 63))").bitwiseAND(word) != 0
    return j.where(F.col("prev").isNull() | hit).select(*cols)


def key_bits(keys: DataFrame) -> np.ndarray:
    """``key_map`` as an array of BLOCKS times eight words (8 MB, whatever the keys) for the counting tasks."""
    t = key_map(keys).where(F.col("_block").isNotNull()).toArrow()
    bits = np.zeros((BLOCKS, 8), dtype=np.int64)
    bits[t.column("_block").to_numpy()] = np.stack([t.column(f"_b{i}").to_numpy() for i in range(8)], axis=1)
    return bits


@dataclass
class CorpusModels:
    """Bigram models that are counted only where they are scored.

    A query that scores once needs c(v, w) for its own keys and no others.  ``counted`` sends the keys
    along with the corpus's bigrams into one grouped sum, so the corpus's bigrams are shuffled once and
    nothing but the keys' counts leaves that stage: no count table of all bigrams is written, read
    again and shuffled to the keys.  ``fit_bigram`` remains the way to fit once and score often."""

    model_ids: tuple[str, ...]
    docs: DataFrame                  # text and what the conditions read
    models: Mapping[str, Column]     # model id -> whether a document is in its corpus
    text_col: str = "text"
    alpha: float = DEFAULT_ALPHA

    def counted(self, keys: DataFrame, model_ids: Sequence[str], n_keys: int) -> BigramModel:
        """The models ``model_ids`` with the bigram counts of the distinct ``keys`` (prev, w).

        Texts give their bigrams, and their words under a NULL prev with how often they start a
        bigram (``bigram_rows``); so one grouped sum gives c(v, w) of the keys, c(w), c(v), N and V.
        Words collapse map-side to a task's vocabulary."""
        ids = tuple(_safe(m) for m in model_ids)
        cols = [*[f"c_{m}" for m in ids], *[f"x_{m}" for m in ids]]
        bits = key_bits(keys) if n_keys <= SLOTS else None
        rows = bigram_rows(self.docs, {m: self.models[m] for m in ids}, self.text_col, bits=bits).withColumn("_key", F.lit(False))
        asked = keys.select("prev", "w", *[F.lit(0).cast("long").alias(c) for c in cols], F.lit(True).alias("_key"))
        sums = rows.unionByName(asked).groupBy("prev", "w").agg(*[F.sum(c).alias(c) for c in cols], F.max("_key").alias("_key"))
        counts = materialize(sums.where(F.col("prev").isNull() | F.col("_key")), "scored-counts")
        uni = counts.where(F.col("prev").isNull())
        totals = materialize(uni.agg(*[F.coalesce(F.sum(f"c_{m}"), F.lit(0)).alias(f"n_{m}") for m in ids], F.count(F.lit(1)).alias("vocab")), "model-totals")
        return BigramModel(ids, counts.where(F.col("prev").isNotNull()).select("prev", "w", *[f"c_{m}" for m in ids]),
                           uni.select("w", *[f"c_{m}" for m in ids]),
                           uni.select(F.col("w").alias("prev"), *[F.col(f"x_{m}").alias(f"c_{m}") for m in ids]), totals, self.alpha)


# A text's first answer word with no prompt word before it gets this context.  Tokens are
# never empty strings, so the sentinel cannot collide with a real word, and plain
# equality joins work on it (no null-safe join keys).
NO_CONTEXT = ""


def token_rows(side_rows: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """L2/L3: one row per answer token with its predecessor (shift alignment).

    The first answer token is predicted from the last prompt word (``context0``).  Sides
    with an empty answer keep one row with a NULL token so that they survive aggregation.
    """
    return (side_rows
            .select("pair_id", "side", *carry, "context0", "answer_tokens",
                    F.posexplode_outer("answer_tokens").alias("pos", "w"))
            .withColumn("prev", F.coalesce(F.when(F.col("pos") == 0, F.col("context0"))
                                           .otherwise(F.get(F.col("answer_tokens"), F.col("pos") - F.lit(1))),
                                           F.lit(NO_CONTEXT)))
            .select("pair_id", "side", *carry, "pos", "prev", "w"))


def token_multiset(side_rows: DataFrame, carry: Sequence[str] = (), mask_token: str | None = None) -> DataFrame:
    """L2/L3 as a multiset: one row per distinct (prev, w) of a side's answer and ``n``, how often it
    occurs there.  ``mask_token`` drops positions that hold it (it still is a predecessor).

    Counted by a partial aggregate before the shuffle, so repeated tokens of a side meet in their
    task.  Sides without a scored token keep one row with a NULL word and ``n`` 0."""
    t = F.col("answer_tokens")
    prev = F.concat(F.array(F.coalesce("context0", F.lit(NO_CONTEXT))), F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))))
    scored = F.filter(F.arrays_zip(prev, t).cast("array<struct<prev:string,w:string>>"),
                      lambda x: x["w"].isNotNull() if mask_token is None else x["w"].isNotNull() & (x["w"] != F.lit(mask_token)))
    by = list(dict.fromkeys(["pair_id", "side", *carry, "prev", "w"]))
    return (side_rows.select("pair_id", "side", *carry, F.inline_outer(scored))
            .groupBy(*by).agg(F.count("w").alias("n")))


# A word with more than HEAVY_KEYS distinct successors (or predecessors) among the keys, and more than
# 1/HEAVY_WORDS of all keys, is split; so at most HEAVY_WORDS words are, on each side.
HEAVY_KEYS = 50_000
HEAVY_WORDS = 1024


def heavy_words(keys: DataFrame, by: str, n_keys: int) -> DataFrame:
    """(word, salts) of the words of column ``by`` that hold too many of the distinct keys, with the
    number of parts that each is split into; at most ``HEAVY_WORDS`` rows."""
    most = max(HEAVY_KEYS, n_keys // HEAVY_WORDS)
    return (keys.groupBy(F.col(by).alias("_word")).agg(F.count(F.lit(1)).alias("_deg")).where(F.col("_deg") > most)
            .select("_word", F.ceil(F.col("_deg") / most).cast("int").alias("_salts")))


def _join_word(keys: DataFrame, counts: DataFrame, by: str, other: str, heavy: list) -> DataFrame:
    """``keys`` with the counts of the word in column ``by``.  Keys of the words in ``heavy`` are dealt
    over the word's salts by a hash of the other word, and only those words' counts are repeated."""
    if not heavy:
        return keys.join(counts, on=by, how="left")
    parts = F.broadcast(keys.sparkSession.createDataFrame(heavy, "_word string, _salts int"))
    salted = (keys.join(parts, keys[by] == parts["_word"], "left")
              .withColumn("_salt", F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(other), F.col("_salts")).cast("int")).otherwise(F.lit(0)))
              .drop("_word", "_salts"))
    repeated = (counts.join(parts, counts[by] == parts["_word"], "left")
                .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_word", "_salts"))
    return salted.join(repeated, on=[by, "_salt"], how="left").drop("_salt")


def key_logps(keys: DataFrame, model: BigramModel | CorpusModels, model_ids: tuple[str, ...] | None = None) -> DataFrame:
    """log p(w | prev) for distinct (prev, w) keys, one ``lp_<m>`` column per model.

    The pairs are distinct, but one word can still have very many distinct successors (or
    predecessors), which all meet that word's row.  The keys are written once and the degrees of
    their words measured; only the words above the bound are split (``heavy_words``).
    Small count tables become broadcasts at run time (AQE measures them).
    """
    ids = model_ids or model.model_ids
    a = F.lit(float(model.alpha))
    keys = materialize(keys.select("prev", "w"), "scoring-keys")
    n_keys = keys.count()
    counted = isinstance(model, CorpusModels)
    if counted:
        model = model.counted(keys, ids, n_keys)
    heavy = {"w": [], "prev": []}
    if n_keys > HEAVY_KEYS:
        for by in heavy:                       # at most HEAVY_WORDS rows
            heavy[by] = [(r["_word"], r["_salts"]) for r in heavy_words(keys, by, n_keys).collect()]
    unigrams = model.unigrams.select("w", *[F.col(f"c_{m}").alias(f"uc_{m}") for m in ids])
    contexts = model.contexts.select("prev", *[F.col(f"c_{m}").alias(f"cc_{m}") for m in ids])
    k = model.bigrams.select("prev", "w", *[F.col(f"c_{m}").alias(f"bc_{m}") for m in ids])
    if not counted:                            # counted models hold a row for each key, and no other
        k = keys.join(k, on=["prev", "w"], how="left")
    k = _join_word(k, unigrams, "w", "prev", heavy["w"])
    k = _join_word(k, contexts, "prev", "w", heavy["prev"]).crossJoin(F.broadcast(model.totals))   # one row
    cols = []
    for m in ids:
        p_uni = (F.coalesce(F.col(f"uc_{m}"), F.lit(0)) + F.lit(1)).cast("double") / (
            F.col(f"n_{m}") + F.col("vocab") + F.lit(1)).cast("double")
        p = (F.coalesce(F.col(f"bc_{m}"), F.lit(0)).cast("double") + a * p_uni) / (
            F.coalesce(F.col(f"cc_{m}"), F.lit(0)).cast("double") + a)
        cols.append(F.log(p).alias(f"lp_{m}"))
    return k.select("prev", "w", *cols)


def sequence_logps_wide(side_rows: DataFrame, model: BigramModel | CorpusModels,
                        model_ids: tuple[str, ...] | None = None, mask_token: str | None = None,
                        carry: Sequence[str] = (), empty: str = "null") -> DataFrame:
    """L4: per (pair_id, side): n_tokens and sum_<m> / mean_<m> for every model.

    ``carry`` names columns of a side (lengths, a batch id) that go with its tokens through
    the same aggregate, so that no join has to bring them back.  Sums and means of empty
    answers are NULL, or NaN with ``empty='nan'`` (one NaN then shows in every mean).

    An answer is a multiset of (prev, w) with multiplicities (``token_multiset``).  Distinct
    keys are scored once (a partial aggregate, so hot keys collapse map-side), then joined back
    and weighted by multiplicity; the per-side sums are partial aggregates.
    Empty answers give n_tokens 0 and NULL sums/means.  ``mask_token`` (L3) drops a pad
    token from the scored positions.
    """
    ids = model_ids or model.model_ids
    # The join back is where the Zipf head of (prev, w) lands.  Its exchanges are left to
    # the planner (no explicit repartition): AQE's skew-join split only applies to
    # planner-inserted shuffles, so a key that most sides hold is split across
    # tasks while its single scored row is replicated.  Rows of empty answers (w NULL)
    # never match a key.
    if empty not in ("null", "nan"):
        raise ValueError("empty must be 'null' or 'nan'")
    # The texts behind the sides are grouped, cut and counted once: keys and join back read the table.
    toks = materialize(token_multiset(side_rows, carry, mask_token), "side-tokens")
    lp = key_logps(toks.where("w IS NOT NULL").select("prev", "w").distinct(), model, ids)
    joined = toks.join(lp, on=["prev", "w"], how="left").select("pair_id", "side", *carry, "n", *[f"lp_{m}" for m in ids])
    agg = joined.groupBy("pair_id", "side").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), *[F.max(c).alias(c) for c in carry],
        *[F.sum(F.col("n") * F.col(f"lp_{m}")).alias(f"sum_{m}") for m in ids])
    if empty == "nan":
        for m in ids:
            agg = agg.withColumn(f"sum_{m}", F.when(F.col("n_tokens") > 0, F.col(f"sum_{m}")).otherwise(F.lit(math.nan)))
        return agg.select("*", *[(F.col(f"sum_{m}") / F.greatest(F.col("n_tokens"), F.lit(1))).alias(f"mean_{m}") for m in ids])
    for m in ids:
        agg = agg.withColumn(f"mean_{m}", F.when(F.col("n_tokens") > 0, F.col(f"sum_{m}") / F.col("n_tokens")))
    return agg


def sequence_logps(side_rows: DataFrame, model: BigramModel | CorpusModels,
                   model_ids: tuple[str, ...] | None = None) -> DataFrame:
    """L4 long form: pair_id, side, model_id, n_tokens, sum_logp, mean_logp."""
    ids = model_ids or model.model_ids
    wide = sequence_logps_wide(side_rows, model, ids)
    longf = F.inline(F.array(*[F.struct(F.lit(m).alias("model_id"), F.col(f"sum_{m}").alias("sum_logp"),
                                        F.col(f"mean_{m}").alias("mean_logp")) for m in ids]))
    return wide.select("pair_id", "side", "n_tokens", longf)


def pair_logps(seq_wide: DataFrame, policy_id: str, ref_id: str | None,
               carry: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """Policy x reference per pair (pc, pr, rc, rr, n_chosen, n_rejected).

    ``carry`` adds columns: name -> (column of a side, which side).

    Sides are pivoted with explicit values.  ``ref_id=None`` copies the policy as its own
    reference, the library default the reference relied on.
    """
    ref = ref_id or policy_id

    def pick(col: str, side: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(col)))

    return seq_wide.groupBy("pair_id").agg(
        pick(f"sum_{policy_id}", "chosen").alias("pc"), pick(f"sum_{policy_id}", "rejected").alias("pr"),
        pick(f"sum_{ref}", "chosen").alias("rc"), pick(f"sum_{ref}", "rejected").alias("rr"),
        pick(f"mean_{policy_id}", "chosen").alias("mc_policy"), pick(f"mean_{policy_id}", "rejected").alias("mr_policy"),
        pick(f"mean_{ref}", "chosen").alias("mc_ref"), pick(f"mean_{ref}", "rejected").alias("mr_ref"),
        pick("n_tokens", "chosen").cast("bigint").alias("n_chosen"),
        pick("n_tokens", "rejected").cast("bigint").alias("n_rejected"),
        *[pick(c, side).alias(name) for name, (c, side) in (carry or {}).items()])


def external_sequence_logps(side_rows: DataFrame, predict: Callable, model_id: str) -> DataFrame:
    """L5 hook for an external model: ``predict(pandas.DataFrame) -> pandas.DataFrame``.

    ``predict`` receives Arrow batches with pair_id, side, prompt_tokens, answer_tokens and
    must return pair_id, side, n_tokens, sum_logp (per-token log-probs summed over the
    answer).  It runs inside executors, batch by batch; nothing is collected.
    """
    schema = "pair_id bigint, side string, n_tokens bigint, sum_logp double"

    def run(batches):
        for pdf in batches:
            yield predict(pdf)[["pair_id", "side", "n_tokens", "sum_logp"]]

    out = side_rows.select("pair_id", "side", "prompt_tokens", "answer_tokens").mapInPandas(run, schema)
    return out.select("pair_id", "side", "n_tokens",
                      F.col("sum_logp").alias(f"sum_{model_id}"),
                      F.when(F.col("n_tokens") > 0, F.col("sum_logp") / F.col("n_tokens")).alias(f"mean_{model_id}"))
