"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the given parquet tables (or tables Spark derives from them) in
full.  Double columns are rounded to 6 decimals at the end (summation order differs
between engines); integers and strings are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from duelframe.config import TRAINER_CAPS, ChatTemplate, PrefConfig
from duelframe.functions import chat as C
from duelframe.functions import text as T
from duelframe.functions.logits import array_mean, log_softmax_gather
from duelframe.functions.metrics import delta_columns, mean_logp_margin, summary_aggs, with_dpo_metrics
from duelframe.operators import batching as B
from duelframe.operators import external as X
from duelframe.operators import generation as G
from duelframe.operators import message_rows as MR
from duelframe.operators import reports as RP
from duelframe.operators import scoring as SC
from duelframe.operators import sides as S
from duelframe.operators import training as TR
from duelframe.session import scratch_path
from duelframe.sources import fixtures as fx
from duelframe.sources.tables import (PAIR_SCHEMA, bad_records, load_pairs, read_checkpoints, read_table, spread,
                                      write_checkpoint)

CFG = PrefConfig()          # whole texts
TRAINER = TRAINER_CAPS      # what the training run read: capped prompts and sequences
TIGHT = PrefConfig(max_length=256, max_prompt_length=128)

# Fixed values of the registered queries (parameters, stated once).
SELECT_K, SELECT_STRIDE, SELECT_OFFSET = 6, 7919, 13   # positions (stride*i + offset) mod n, the first one again at the end
HEAD_N = 50                              # head slice length
SAMPLE_K, SAMPLE_SEED = 80, 42           # seeded sample
SHUFFLE_SEED = 0                         # seeded shuffle used for batches
AUDIT_BATCH, AUDIT_N_BATCHES = 8, 10     # batch_metrics: the first 10 batches of 8 of the shuffled pairs
SHUFFLE_TAKE = 64                        # rows after the seeded shuffle
MEAN_BATCH = 4                           # batch size of the mean-of-batch-means audit
GREEDY_STEPS = 160
SMOOTH_WEIGHT, SMOOTH_WEIGHT_LIGHT = 0.8, 0.6
SMOOTH_FILES, SMOOTH_FILES_PER_TRIGGER = 6, 2   # files that overlap in event time, and micro-batches of them
LOG_EVERY = 10
SMOKE_STEPS = 60                         # step cap of a short run
SAVE_EVERY = 1000
PAD_TOKEN = None
EOS_TOKEN = "<|endoftext|>"
MASK_TOKEN = "the"                       # stands for a token whose positions are not scored
STREAM_WINDOW, STREAM_DELAY = "6 hours", "1 hour"
STRAGGLERS = 10                          # every tenth event comes with the second delivery
BROKEN_LINES = 7                         # every seventh pair's line is cut off
UNDERFLOW_EDGES = "32,64,96,128"
LINEAR_STEPS, LINEAR_LR = 60, 50.0
LINEAR_EPOCHS = 4                        # epochs of the linear fit in the step plan's mini-batches
TEMPLATE = ChatTemplate()

# Corpus membership of the bigram models (documents LEFT JOIN labels).
MODEL_FILTERS = {
    "ref": lambda: F.lit(True),
    "policy": lambda: F.col("quality") == 1,
    "nontoxic": lambda: F.col("toxic") == 0,
}

SCORES_CONF = "spark.duelframe.scores"   # a folder with kept scores of the models of one fit
MODELS_CONF = "spark.duelframe.models"   # a folder with a saved fit of all models over the same tables

# Checkpoints of a growing policy: its corpus after each step is the share of the quality=1
# documents whose id falls into the first residues modulo 4.
CHECKPOINTS = {f"step_{1000 * s}": s for s in (1, 2, 3, 4)}
MODEL_FILTERS |= {m: (lambda s=s: (F.col("quality") == 1) & (F.col("doc_id") % 4 < s)) for m, s in CHECKPOINTS.items()}


def round_doubles(df: DataFrame, n: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            # "+ 0.0" turns a rounded -0.0 into 0.0 so both engines print the same value
            cols.append((F.round(F.col(f.name).cast("double"), n) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# ----------------------------------------------------------------- shared building blocks

def _pairs(spark, d):
    return fx.pairs_raw(spark, d)


def _extracted(spark, d, mode="last_assistant"):
    return S.extract(_pairs(spark, d), mode)


def _sides(spark, d, cfg=CFG, mode="last_assistant", template=None):
    return S.sides(_extracted(spark, d, mode), cfg, template)


def _model(spark, d, ids=("ref", "policy"), whole=False):
    """The corpus's bigram models, counted for the words that the query scores, or fitted
    ``whole`` for one that walks them.  If the session names a folder in ``MODELS_CONF``,
    the fit that ``BigramModel.save`` left there is loaded instead."""
    unknown = set(ids) - set(MODEL_FILTERS)
    if unknown:
        raise ValueError(f"unknown model ids {sorted(unknown)}")
    saved = spark.conf.get(MODELS_CONF, None)
    if saved:
        return SC.BigramModel.load(spark, saved)
    models = {m: MODEL_FILTERS[m]() for m in ids}
    # a walk reads the bigram counts once: they are not written first
    return SC.fit_bigram(_labelled(spark, d), models, write_counts=False) if whole else SC.CorpusModels(tuple(ids), _labelled(spark, d), models)


def _labelled(spark, d, partitions=None):
    docs = read_table(spark, d, "documents")
    if partitions:
        docs = spread(docs, partitions)
    return docs.join(read_table(spark, d, "labels"), on="doc_id", how="left")


def fit_models(spark, d, ids=tuple(MODEL_FILTERS), partitions=None):
    """A fit over all documents.  ``partitions`` spreads a corpus of few splits first; by
    default the documents are read as they are split, without a shuffle."""
    return SC.fit_bigram(_labelled(spark, d, partitions), {m: MODEL_FILTERS[m]() for m in ids})


def _seq(spark, d, ids=("ref", "policy"), side_rows=None, carry=()):
    sd = side_rows if side_rows is not None else _sides(spark, d)
    return SC.sequence_logps_wide(sd, _model(spark, d, ids), ids, carry=carry)


def _pair_logps(spark, d, side_rows=None, carry=None):
    seq = _seq(spark, d, side_rows=side_rows, carry=tuple(dict.fromkeys(c for c, _ in (carry or {}).values())))
    return SC.pair_logps(seq, "policy", "ref", carry)


def _scored(spark, d, side_rows=None, carry=None, cfg=CFG):
    return with_dpo_metrics(_pair_logps(spark, d, side_rows, carry), cfg)


def _shuffled_index(spark, d):
    """(pair_id, row_idx): position in the seeded shuffle order."""
    keys = fx.pair_ids(spark, d).withColumn("_hk", B.hash_key("pair_id", SHUFFLE_SEED))
    return B.with_row_index(keys, ["_hk", "pair_id"]).select("pair_id", "row_idx")


# ----------------------------------------------------------------- pairs

def _last_assistant(pairs):
    e = S.check_prompt_same(S.extract(pairs, "last_assistant"), "flag")
    return e.select("pair_id", F.size("prompt_msgs_chosen").cast("bigint").alias("n_prompt_msgs"),
                    T.char_len("prompt_text").cast("bigint").alias("prompt_chars"),
                    T.char_len("chosen_text").cast("bigint").alias("chosen_chars"),
                    T.char_len("rejected_text").cast("bigint").alias("rejected_chars"),
                    "prompt_same", F.md5("prompt_text").alias("prompt_md5"))


def q_pairs_last_assistant(spark, d):
    return _last_assistant(_pairs(spark, d))


def q_pairs_last_assistant_cross(spark, d):
    return _last_assistant(fx.pairs_cross(spark, d))


def q_validate_pairs(spark, d):
    v = S.validate_pairs(fx.pairs_broken(spark, d))
    return v.select("pair_id", F.size("errors").cast("bigint").alias("n_errors"), F.array_join("errors", ",").alias("errors"))


def q_pairs_positional(spark, d):
    p = S.validate_pairs(_pairs(spark, d))
    prompt, a_c, a_r, valid = C.positional(F.col("chosen"), F.col("rejected"))
    return p.select("pair_id", T.char_len(prompt).cast("bigint").alias("prompt_chars"),
                    T.char_len(a_c).cast("bigint").alias("chosen_chars"),
                    T.char_len(a_r).cast("bigint").alias("rejected_chars"),
                    valid.alias("valid"), F.size("errors").cast("bigint").alias("n_errors"),
                    F.array_join("errors", ",").alias("errors"))


def _common_prefix(p):
    k = C.common_prefix_len(F.col("chosen"), F.col("rejected"))
    la_prompt, _, _ = C.split_last_assistant(F.col("chosen"))
    return p.select("pair_id", k.cast("bigint").alias("prefix_len"),
                    (F.size("chosen") - k).cast("bigint").alias("chosen_rest_msgs"),
                    (F.size("rejected") - k).cast("bigint").alias("rejected_rest_msgs"),
                    T.char_len(C.chat_text(C.tail(F.col("chosen"), k))).cast("bigint").alias("chosen_rest_chars"),
                    (k == F.size(la_prompt)).alias("agrees_with_last_assistant"))


def q_pairs_common_prefix(spark, d):
    return _common_prefix(_pairs(spark, d))


def q_pairs_common_prefix_cross(spark, d):
    return _common_prefix(fx.pairs_cross(spark, d))


def q_pairs_last_assistant_long(spark, d):
    """P2/P4 on message rows: no conversation is gathered."""
    return MR.split_last_assistant(fx.pair_messages(spark, d, cross=True))


def q_pairs_common_prefix_long(spark, d):
    return MR.common_prefix(fx.pair_messages(spark, d, cross=True))


def q_render_prompt(spark, d):
    e = _extracted(spark, d)
    rendered = C.render_chat(F.col("prompt_msgs_chosen"), TEMPLATE, add_generation_prompt=True)
    return e.select("pair_id", F.size("prompt_msgs_chosen").cast("bigint").alias("n_msgs"),
                    T.char_len(rendered).cast("bigint").alias("rendered_chars"),
                    F.md5(rendered).alias("rendered_md5"),
                    T.char_len(F.concat(rendered, F.col("chosen_text"))).cast("bigint").alias("full_chosen_chars"),
                    T.char_len(F.concat(rendered, F.col("rejected_text"))).cast("bigint").alias("full_rejected_chars"))


def q_render_user_prompt(spark, d):
    """The first turn of every conversation as a one-message user chat, rendered for generation."""
    rendered = C.render_chat(C.as_user_chat(F.col("text")), TEMPLATE, add_generation_prompt=True)
    return fx.conversations(spark, d).where("turn = 0").select(
        "conv_id", T.char_len(rendered).cast("bigint").alias("rendered_chars"), F.md5(rendered).alias("rendered_md5"))


def q_select_index(spark, d):
    index = fx.pair_index(spark, d)
    n = index.count()
    ids = [(SELECT_STRIDE * i + SELECT_OFFSET) % n for i in range(SELECT_K)] if n else []
    picked = B.select_by_index(index, ids + ids[:1])
    return picked.join(_pairs(spark, d), on="pair_id").select(
        F.col("sel_pos").cast("bigint").alias("sel_pos"), "row_idx", "pair_id",
        F.size("chosen").cast("bigint").alias("n_msgs"))


def q_head_slice(spark, d):
    head = B.head_slice(fx.pair_ids(spark, d), HEAD_N, ["pair_id"])
    return head.join(_pairs(spark, d), on="pair_id").select(
        "row_idx", "pair_id", F.size("chosen").cast("bigint").alias("n_msgs"))


def q_shuffle_take(spark, d):
    taken = B.shuffle_take(fx.pair_ids(spark, d), SHUFFLE_TAKE, SHUFFLE_SEED, "pair_id")
    return taken.join(_pairs(spark, d), on="pair_id").select(
        "row_idx", "pair_id", F.size("chosen").cast("bigint").alias("n_msgs"))


def q_sample_python_metrics(spark, d):
    """S4 (driver draw) -> S3 -> D1-D6 of the drawn pairs, keyed by pair_id."""
    drawn = B.sample_k(fx.pair_ids(spark, d), SAMPLE_K, SAMPLE_SEED, "pair_id", mode="python")
    chosen = _pairs(spark, d).join(drawn.select("pair_id", "sample_pos"), on="pair_id")
    m = _scored(spark, d, side_rows=S.sides(S.extract(chosen), CFG))
    return m.join(drawn.select("pair_id", "sample_pos"), on="pair_id").select(
        "pair_id", F.col("sample_pos").cast("bigint").alias("sample_pos"), "z", "loss", "reward_chosen",
        "reward_rejected", "reward_margin", "correct")


def q_sample_hash(spark, d):
    ids = fx.conversations(spark, d).select("conv_id").distinct()
    s = B.sample_k(ids, SAMPLE_K, SAMPLE_SEED, "conv_id", mode="hash")
    return s.join(fx.chats(spark, d), on="conv_id").select("conv_id", F.col("sample_pos").cast("bigint").alias("sample_pos"),
                    F.size("messages").cast("bigint").alias("n_msgs"))


def q_row_index_batches(spark, d):
    ch = (fx.conversations(spark, d).select("conv_id").distinct()
          .withColumn("_hk", B.hash_key("conv_id", SHUFFLE_SEED)))
    idx = B.with_row_index(ch, ["_hk", "conv_id"])
    return B.assign_batches(idx, AUDIT_BATCH).select("conv_id", "row_idx", "batch_id")


# ----------------------------------------------------------------- text and lengths

def _truncation(cfg, template=None):
    def q(spark, d):
        return S.truncation_report(_sides(spark, d, cfg, template=template), cfg).select(
            "pair_id", "side", *[F.col(c).cast("bigint").alias(c) for c in
                                 ("prompt_len_raw", "prompt_len", "answer_len_raw", "answer_len", "full_len_raw",
                                  "full_len")],
            "over_prompt_limit", "over_max_length", "over_after_prompt_cut", "truncated")
    return q


def q_nonpad_length(spark, d):
    """T5: answer and prompt tokens of the trainer's input that are not the pad token (which is
    the end token if no pad token is set), and the longest answer of their batch."""
    sd = S.sides(S.extract(fx.pairs_indexed(spark, d)), TRAINER)
    pad = F.coalesce(F.lit(PAD_TOKEN).cast("string"), F.lit(EOS_TOKEN))
    sd = sd.withColumn("batch_id", (F.col("row_idx") / F.lit(AUDIT_BATCH)).cast("bigint"))
    w = Window.partitionBy("batch_id", "side")   # a batch holds AUDIT_BATCH rows per side
    return sd.select("pair_id", "side", "batch_id", F.max("answer_len").over(w).cast("bigint").alias("padded_len"),
                     T.nonpad_len(F.col("answer_tokens"), pad).cast("bigint").alias("nonpad_len"),
                     T.nonpad_len(F.col("prompt_tokens"), pad).cast("bigint").alias("prompt_nonpad_len"))


def q_nonpad_length_padded(spark, d):
    """T5 on rows that hold pad tokens: answers closed by the end token and filled up with the
    pad token (P10: the end token) to the longest of their batch, as a batch stores them.  The
    end token counts as padding too, since one token is both."""
    sd = S.sides(S.extract(fx.pairs_indexed(spark, d)), TRAINER)
    pad = F.coalesce(F.lit(PAD_TOKEN).cast("string"), F.lit(EOS_TOKEN))
    sd = sd.withColumn("batch_id", (F.col("row_idx") / F.lit(AUDIT_BATCH)).cast("bigint"))
    w = Window.partitionBy("batch_id", "side")   # a batch holds AUDIT_BATCH rows per side
    sd = sd.withColumn("longest", F.max("answer_len").over(w))
    ids = F.concat("answer_tokens", F.array(F.lit(EOS_TOKEN)), F.array_repeat(pad, (F.col("longest") - F.col("answer_len")).cast("int")))
    return sd.select("pair_id", "side", "batch_id", ids.alias("ids")).select(
        "pair_id", "side", "batch_id", F.size("ids").cast("bigint").alias("stored_len"),
        T.nonpad_len(F.col("ids"), pad).cast("bigint").alias("nonpad_len"))


# Lengths that go with the scores: name -> (column of a side, side)
LENGTHS = {"len_prompt": ("prompt_len", "chosen"), "len_chosen": ("answer_len", "chosen"),
           "len_rejected": ("answer_len", "rejected")}


def _bucket_query(by, mode="reference"):
    def q(spark, d):
        scored = _scored(spark, d, side_rows=_sides(spark, d, TRAINER), carry=LENGTHS, cfg=TRAINER)
        key = (F.coalesce("len_chosen", F.lit(0)) + F.coalesce("len_rejected", F.lit(0)) if by == "pair_total"
               else F.col(f"len_{by}"))
        edges = CFG.bucket_edges if mode == "reference" else UNDERFLOW_EDGES
        return RP.bucket_report(scored.withColumn("length_key", key), edges, mode=mode).select(
            "bucket", F.col("bucket_id").cast("bigint").alias("bucket_id"), F.col("n").cast("bigint").alias("n"),
            F.col("n_scored").cast("bigint").alias("n_scored"), "mean_loss", "mean_margin", "mean_acc")
    q.__name__ = f"q_length_buckets_{by}"
    return q


# ----------------------------------------------------------------- scoring

def q_log_softmax_gather(spark, d):
    r = fx.logits_rows(spark, d)
    return r.select("vec_id", F.col("target").cast("bigint").alias("target"),
                    log_softmax_gather(F.col("logits"), F.col("target")).alias("logp"))


def q_mean_logits(spark, d):
    fp = fx.feature_pairs(spark, d)
    return fp.agg(F.count(F.lit(1)).alias("n"), F.avg(array_mean("phi_chosen")).alias("logits_chosen"),
                  F.avg(array_mean("phi_rejected")).alias("logits_rejected"))


def q_bigram_fit(spark, d):
    ids = ("ref", "policy")
    m = fit_models(spark, d, ids)
    longf = F.inline(F.array(*[F.struct(F.lit(i).alias("model_id"), F.col(f"c_{i}").alias("c")) for i in ids]))
    return m.bigrams.select("prev", "w", longf).where(F.col("c") > 0).select(
        "model_id", "prev", "w", F.col("c").cast("bigint").alias("c"))


def q_sequence_logps(spark, d):
    m = _model(spark, d)
    return SC.sequence_logps(_sides(spark, d), m, ("ref", "policy")).select(
        "pair_id", "side", "model_id", F.col("n_tokens").cast("bigint").alias("n_tokens"), "sum_logp", "mean_logp")


def q_sequence_logps_masked(spark, d):
    """L3: positions that hold ``MASK_TOKEN`` are not scored; they still are predecessors."""
    seq = SC.sequence_logps_wide(_sides(spark, d), _model(spark, d, ("ref",)), ("ref",), mask_token=MASK_TOKEN)
    return seq.select("pair_id", "side", F.col("n_tokens").cast("bigint").alias("n_tokens"), F.col("sum_ref").alias("sum_logp"))


def q_external_scores(spark, d):
    """L5 by a model outside Spark: bigrams of word classes, loaded once for each worker."""
    scorer = X.class_bigram(read_table(spark, d, "documents"))
    return X.external_scores(_sides(spark, d), scorer).select(
        "pair_id", "side", "n_tokens", F.col(f"sum_{scorer.model_id}").alias("sum_logp"),
        F.col(f"mean_{scorer.model_id}").alias("mean_logp"))


def _pair_logps_query(mode="last_assistant", template=None):
    def q(spark, d):
        return _pair_logps(spark, d, _sides(spark, d, CFG, mode, template)).select(
            "pair_id", "pc", "pr", "rc", "rr", "n_chosen", "n_rejected")
    return q


def q_self_reference(spark, d):
    pl = SC.pair_logps(_seq(spark, d), "policy", None)
    return with_dpo_metrics(pl, CFG).agg(
        F.count(F.lit(1)).alias("n"), F.count("loss").alias("n_scored"), F.avg("loss").alias("loss"), F.avg("reward_margin").alias("reward_margin"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"))


# ----------------------------------------------------------------- preference metrics

def q_dpo_metrics(spark, d):
    m = with_dpo_metrics(fx.lineitem_logps(spark, d), CFG)
    return m.select("z", "loss", "reward_chosen", "reward_rejected", "reward_margin", "correct")


def _summary(cfg):
    def q(spark, d):
        return with_dpo_metrics(fx.lineitem_logps(spark, d), cfg).agg(*summary_aggs())
    return q


def q_delta_margin(spark, d):
    return _pair_logps(spark, d).select("pair_id", *delta_columns())


def q_mean_logp_margin(spark, d):
    pl = _pair_logps(spark, d)
    return pl.select("pair_id",
                     mean_logp_margin("pc", "n_chosen", "pr", "n_rejected").alias("policy_mean_logp_margin"),
                     mean_logp_margin("rc", "n_chosen", "rr", "n_rejected").alias("ref_mean_logp_margin"))


def q_length_bias(spark, d):
    return RP.length_bias_report(_pair_logps(spark, d))


# ----------------------------------------------------------------- batches (A2, A4, A5)

def _batched_scores(spark, d, size, n_batches=None):
    """Scores of the trainer's input with the batch of each pair in the shuffled order."""
    index = _shuffled_index(spark, d)
    if n_batches is not None:
        index = index.where(F.col("row_idx") < F.lit(int(size * n_batches)))   # select before scoring
    p = _pairs(spark, d).join(B.assign_batches(index, size), on="pair_id")
    return _scored(spark, d, side_rows=S.sides(S.extract(p), TRAINER), carry={"batch_id": ("batch_id", "chosen")}, cfg=TRAINER)


def q_batch_metrics(spark, d):
    b = RP.batch_metrics(_batched_scores(spark, d, AUDIT_BATCH, AUDIT_N_BATCHES), AUDIT_N_BATCHES)
    return b.select("batch_id", F.col("n").cast("bigint").alias("n"), "loss", "reward_margin", "accuracy")


def q_batch_mean_summary(spark, d):
    b = RP.batch_metrics(_batched_scores(spark, d, MEAN_BATCH))
    return RP.summarise_batches(b).select(F.col("n_batches").cast("bigint").alias("n_batches"),
                                          F.col("n").cast("bigint").alias("n"), "mean_loss",
                                          "mean_reward_margin", "mean_reward_acc")


def q_batch_sign_rate(spark, d):
    b = RP.batch_metrics(_batched_scores(spark, d, AUDIT_BATCH))
    return RP.batch_sign_rate(b).select(F.col("n_batches").cast("bigint").alias("n_batches"), "mean_margin",
                                        "frac_batches_margin_pos", "mean_acc")


def q_compare_policies(spark, d):
    ids = ("ref", "policy", "nontoxic")
    seq = _seq(spark, d, ids)
    return RP.compare_policies(seq, ["ref", "policy", "nontoxic"], "ref", CFG).select(
        "policy_id", F.col("n").cast("bigint").alias("n"), F.col("n_scored").cast("bigint").alias("n_scored"),
        "loss", "reward_margin", "accuracy", "mean_logp_margin", "frac_mean_logp_pos")


def q_compare_checkpoints(spark, d):
    """A8 over a series: the base model against the policy's checkpoints, one row per step.  Scores of
    the frozen models are kept; those that the folder in ``SCORES_CONF`` holds are not computed again."""
    store = X.ScoreStore(spark, spark.conf.get(SCORES_CONF, None) or scratch_path(spark, "scores"))
    seq = store.score(_sides(spark, d), ("ref", *CHECKPOINTS),
                      lambda rows, ids: SC.sequence_logps_wide(rows, _model(spark, d, ids), ids))
    rows = RP.compare_policies(seq, list(CHECKPOINTS), "ref", CFG)
    return rows.select(F.substring_index("policy_id", "_", -1).cast("bigint").alias("step"),
                       F.col("n").cast("bigint").alias("n"), "loss", "reward_margin", "accuracy", "mean_logp_margin")


# ----------------------------------------------------------------- generation

def _turn0_seeds(spark, d):
    conv = fx.conversations(spark, d).where(F.col("turn") == 0)
    toks = T.tokens(F.col("text"))
    return conv.select(F.col("conv_id").alias("prompt_id"), F.col("text").alias("prompt"),
                       F.get(toks, F.size(toks) - F.lit(1)).alias("word")).where(F.col("word").isNotNull())


def q_greedy_extend(spark, d):
    m = _model(spark, d, ("ref",), whole=True)
    seeds = G.prompt_grid(_turn0_seeds(spark, d), ["ref"])
    walk = G.greedy_extend(seeds, G.next_word_table(m, ["ref"]), GREEDY_STEPS)
    return walk.select(F.col("prompt_id").alias("conv_id"), F.col("step").cast("bigint").alias("step"), "word")


def q_generation_report(spark, d):
    ids = ["ref", "policy"]
    m = _model(spark, d, tuple(ids), whole=True)
    prompts = _turn0_seeds(spark, d)
    seeds = G.prompt_grid(prompts, ids)
    cont = G.continuations(seeds, G.next_word_table(m, ids), GREEDY_STEPS)
    full = seeds.join(cont, on=["prompt_id", "model_id"], how="left").withColumn(
        "generated", F.concat_ws(" ", F.col("prompt"), F.col("continuation")))
    ans, _ = T.answer_after_prompt(F.col("generated"), F.col("prompt"))
    gen = full.select("prompt_id", "model_id", ans.alias("answer"))
    rep = RP.generation_report(gen, ids, preview_chars=900)
    return rep.select(F.col("prompt_id").alias("conv_id"),
                      *[F.col(f"chars_{m}").cast("bigint").alias(f"chars_{m}") for m in ids],
                      *[F.md5(f"preview_{m}").alias(f"preview_md5_{m}") for m in ids])


def q_extract_answer(spark, d):
    e = _extracted(spark, d)
    rendered = C.render_chat(F.col("prompt_msgs_chosen"), TEMPLATE, add_generation_prompt=True)
    decoded = C.strip_special(F.concat(rendered, F.col("chosen_text")), TEMPLATE)
    last_prompt = F.get(F.col("prompt_msgs_chosen"), F.size("prompt_msgs_chosen") - F.lit(1)).getField("content")
    ans_r, matched_r = T.answer_after_prompt(decoded, rendered)
    ans_p, matched_p = T.answer_after_prompt(decoded, last_prompt)
    return e.select("pair_id", matched_r.alias("matched_rendered"), matched_p.alias("matched_plain"),
                    T.char_len(ans_r).cast("bigint").alias("answer_chars_rendered"),
                    T.char_len(ans_p).cast("bigint").alias("answer_chars"), F.md5(ans_p).alias("answer_md5"))


# ----------------------------------------------------------------- training run as data

def _step_plan(max_steps=None):
    def q(spark, d):
        sp = B.step_plan(fx.pair_index(spark, d), CFG.batch_size, CFG.grad_accum, CFG.epochs, max_steps)
        return sp.groupBy("step").agg(F.count(F.lit(1)).alias("n_pairs"), F.min("row_idx").alias("first_row"),
                                      F.max("row_idx").alias("last_row"))
    return q


def q_lr_schedule(spark, d):
    """R2 read off the metric log: the rate at every logged step of every run, whose length is
    the run's last step."""
    log = TR.rollup_log(fx.metric_log(spark, d), LOG_EVERY).select("run_id", F.col("last_step").alias("step"))
    runs = log.groupBy("run_id").agg(F.max("step").alias("total_steps"))
    steps = log.join(runs, on="run_id").withColumn("step_idx", F.col("step") - 1)
    return TR.lr_schedule(steps, "total_steps", CFG.learning_rate, CFG.warmup_ratio).select(
        "run_id", "step", "warmup_steps", (F.col("lr") * F.lit(1e6)).alias("lr_e6"))


def q_checkpoint_steps(spark, d):
    return TR.checkpoint_steps(fx.metric_log(spark, d), SAVE_EVERY)


def q_linear_dpo_step0(spark, d):
    deltas = TR.feature_deltas(fx.feature_pairs(spark, d))
    dim = F.size(F.col("dphi"))
    theta = deltas.agg(F.max(dim).alias("_d")).select(F.array_repeat(F.lit(0.0), F.col("_d")).alias("theta"))
    g = TR.gradient(deltas, theta, CFG.beta)
    return g.select(F.posexplode("grad").alias("dim", "grad")).select(
        F.col("dim").cast("bigint").alias("dim"), (F.col("grad") * F.lit(1e6)).alias("grad_e6"))


def q_linear_dpo_fit(spark, d):
    return TR.fit_linear_dpo(fx.feature_pairs(spark, d), CFG.beta, LINEAR_STEPS, LINEAR_LR).select(
        F.col("step").cast("bigint").alias("step"), "loss", "accuracy", (F.col("grad_norm_sq") * 1e6).alias("grad_norm_sq_e6"))


def q_linear_dpo_epoch(spark, d):
    """R3 by R1's steps and R2's rates."""
    return TR.fit_linear_dpo_epochs(fx.feature_pairs(spark, d), CFG.beta, LINEAR_EPOCHS, LINEAR_LR, CFG.batch_size,
                                    CFG.grad_accum, CFG.warmup_ratio).select(
        "epoch", "step", "n_pairs", "loss", "accuracy", "rate", "grad_norm_sq", "theta_norm_sq")


def q_metric_rollup(spark, d):
    r = TR.rollup_log(fx.metric_log(spark, d), LOG_EVERY)
    return r.select("run_id", "tag", "bin", "value", F.col("n").cast("bigint").alias("n"), "log_step", "first_step", "last_step")


def q_metric_smooth(spark, d):
    r = TR.rollup_log(fx.metric_log(spark, d), LOG_EVERY).withColumn("k", F.col("bin") + 1)
    s = TR.smooth(r, SMOOTH_WEIGHT, ["run_id", "tag"], "k", "value", dense=True)
    return s.select("run_id", "tag", "bin", "smoothed")


def _smooth_last(weight):
    def q(spark, d):
        r = TR.rollup_log(fx.metric_log(spark, d), LOG_EVERY).withColumn("k", F.col("bin") + 1)
        return TR.last_smoothed(r, weight, ["run_id", "tag"], "k", "value").select(
            "run_id", "tag", F.col("n_points").cast("bigint").alias("n_points"), "last_smoothed")
    return q


def q_metric_tags(spark, d):
    scored = _batched_scores(spark, d, AUDIT_BATCH)
    per_batch = scored.groupBy("batch_id").agg(
        F.avg("loss").alias("loss"), F.avg("reward_chosen").alias("rewards/chosen"),
        F.avg("reward_rejected").alias("rewards/rejected"), F.avg("reward_margin").alias("rewards/margins"),
        F.avg(F.col("correct").cast("double")).alias("rewards/accuracies"),
        F.avg("pc").alias("logps/chosen"), F.avg("pr").alias("logps/rejected"))
    tags = ["loss", "rewards/chosen", "rewards/rejected", "rewards/margins", "rewards/accuracies",
            "logps/chosen", "logps/rejected"]
    long = per_batch.unpivot("batch_id", [F.col(f"`{t}`").alias(t) for t in tags], "tag", "value")
    return RP.select_tags(long, ("rewards/", "logps/", "logits/"))


# ----------------------------------------------------------------- streaming (ST1-ST3)

def q_stream_rollup(spark, d):
    from duelframe.streaming import live
    return live.run_stream_rollup(spark, d, STREAM_WINDOW, STREAM_DELAY)


def q_stream_rollup_append(spark, d):
    from duelframe.streaming import live
    return live.run_stream_rollup(spark, d, STREAM_WINDOW, STREAM_DELAY, "append")


def q_stream_metrics(spark, d):
    from duelframe.streaming import live
    return live.run_stream_metrics(spark, d, CFG)


def q_stream_smooth(spark, d):
    from duelframe.streaming import live
    dealt = scratch_path(spark, "events-dealt")     # every file holds points of the whole time range
    spread(read_table(spark, d, "events"), SMOOTH_FILES).write.parquet(dealt)
    return live.run_stream_smooth(spark, d, SMOOTH_WEIGHT, dealt, SMOOTH_FILES_PER_TRIGGER)


def q_stream_late_rows(spark, d):
    """ST1 with a second delivery of stragglers: what was emitted, is open, and came too late."""
    from duelframe.streaming import live
    ev = read_table(spark, d, "events")
    straggles = F.col("event_id") % STRAGGLERS == 0
    return live.run_stream_late_rows(spark, [ev.where(~straggles), ev.where(straggles)], STREAM_WINDOW, STREAM_DELAY)


def q_stream_metric_sink(spark, d):
    """The log streamed into a metric folder by two runs, the second resuming after the first."""
    from duelframe.streaming import live
    base = scratch_path(spark, "metric-log")
    log = fx.metric_log(spark, d).select("run_id", "step", "tag", "value")
    later = F.col("step") % 3 == 0                  # windows get rows from both runs
    for rows in (log.where(~later), log.where(later)):
        rows.write.mode("append").parquet(f"{base}/source")
        out = live.run_metric_sink(spark, f"{base}/source", LOG_EVERY, f"{base}/run")
    return out.select("run_id", "tag", "bin", "value", "n", "log_step", "first_step", "last_step")


# ----------------------------------------------------------------- loading and checkpoints

def q_load_pairs_split(spark, d):
    """The pairs as JSON lines by split, some lines broken, read back with a quarantine: pairs and
    messages of each split, and its broken lines."""
    path = scratch_path(spark, "pairs-json")
    p = _pairs(spark, d).withColumn("split", F.when(F.col("pair_id") % 5 == 0, "test").otherwise("train"))
    line = F.to_json(F.struct("pair_id", "chosen", "rejected"))
    broken = F.col("pair_id") % BROKEN_LINES == 0    # cut off in the middle
    lines = p.select("split", F.when(broken, F.substring(line, F.lit(1), F.floor(F.length(line) / 2).cast("int"))).otherwise(line).alias("value"))
    lines.write.partitionBy("split").text(path)
    out = None
    for split in ("train", "test"):
        good = load_pairs(spark, path, split, "json", PAIR_SCHEMA, quarantine=True).agg(
            F.count(F.lit(1)).alias("n_pairs"), F.sum(F.size("chosen") + F.size("rejected")).cast("bigint").alias("n_messages"))
        bad = bad_records(spark, f"{path}/split={split}").agg(F.count(F.lit(1)).alias("n_bad"))
        row = good.crossJoin(bad).select(F.lit(split).alias("split"), "n_pairs", "n_messages", "n_bad")     # one row each
        out = row if out is None else out.unionByName(row)
    return out


def q_checkpoint_roundtrip(spark, d):
    """Counts of the corpus after each step written as checkpoints, one of them twice, and read back."""
    path = scratch_path(spark, "checkpoints")
    docs = read_table(spark, d, "documents").select("doc_id", "source", F.length("text").cast("bigint").alias("chars"))
    for step, share in ((1000, 1), (2000, 2), (1000, 3)):
        write_checkpoint(docs.where(F.col("doc_id") % 4 < share), path, "run-a", step)
    return read_checkpoints(spark, path).groupBy("run_id", "step", "source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))


# ----------------------------------------------------------------- registry

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pairs_last_assistant": q_pairs_last_assistant,
    "pairs_positional": q_pairs_positional,
    "pairs_common_prefix": q_pairs_common_prefix,
    "render_prompt": q_render_prompt,
    "render_user_prompt": q_render_user_prompt,
    "select_index": q_select_index,
    "head_slice": q_head_slice,
    "sample_hash": q_sample_hash,
    "row_index_batches": q_row_index_batches,
    "pairs_last_assistant_cross": q_pairs_last_assistant_cross,
    "pairs_common_prefix_cross": q_pairs_common_prefix_cross,
    "pairs_last_assistant_long": q_pairs_last_assistant_long,
    "pairs_common_prefix_long": q_pairs_common_prefix_long,
    "validate_pairs": q_validate_pairs,
    "shuffle_take": q_shuffle_take,
    "sample_python_metrics": q_sample_python_metrics,
    "truncation_report": _truncation(TRAINER),
    "truncation_report_tight": _truncation(TIGHT),
    "truncation_report_rendered": _truncation(TRAINER, TEMPLATE),
    "nonpad_length": q_nonpad_length,
    "nonpad_length_padded": q_nonpad_length_padded,
    "length_buckets_prompt": _bucket_query("prompt"),
    "length_buckets_chosen": _bucket_query("chosen"),
    "length_buckets_rejected": _bucket_query("rejected"),
    "length_buckets_pair_total": _bucket_query("pair_total"),
    "length_buckets_underflow": _bucket_query("prompt", "underflow"),
    "log_softmax_gather": q_log_softmax_gather,
    "mean_logits": q_mean_logits,
    "bigram_fit": q_bigram_fit,
    "sequence_logps": q_sequence_logps,
    "sequence_logps_masked": q_sequence_logps_masked,
    "external_scores": q_external_scores,
    "pair_logps": _pair_logps_query(),
    "pair_logps_positional": _pair_logps_query("positional"),
    "pair_logps_rendered": _pair_logps_query(template=TEMPLATE),
    "self_reference": q_self_reference,
    "dpo_metrics": q_dpo_metrics,
    "dpo_summary": _summary(CFG),
    "dpo_smoothed": _summary(PrefConfig(label_smoothing=0.1)),
    "dpo_reference_free": _summary(PrefConfig(reference_free=True)),
    "delta_margin": q_delta_margin,
    "mean_logp_margin": q_mean_logp_margin,
    "length_bias": q_length_bias,
    "batch_metrics": q_batch_metrics,
    "batch_mean_summary": q_batch_mean_summary,
    "batch_sign_rate": q_batch_sign_rate,
    "compare_policies": q_compare_policies,
    "compare_checkpoints": q_compare_checkpoints,
    "greedy_extend": q_greedy_extend,
    "generation_report": q_generation_report,
    "extract_answer": q_extract_answer,
    "step_plan": _step_plan(),
    "step_plan_capped": _step_plan(SMOKE_STEPS),
    "lr_schedule": q_lr_schedule,
    "checkpoint_steps": q_checkpoint_steps,
    "linear_dpo_step0": q_linear_dpo_step0,
    "linear_dpo_fit": q_linear_dpo_fit,
    "linear_dpo_epoch": q_linear_dpo_epoch,
    "metric_rollup": q_metric_rollup,
    "metric_smooth": q_metric_smooth,
    "metric_smooth_last": _smooth_last(SMOOTH_WEIGHT),
    "metric_smooth_last_light": _smooth_last(SMOOTH_WEIGHT_LIGHT),
    "metric_tags": q_metric_tags,
    "stream_rollup": q_stream_rollup,
    "stream_rollup_append": q_stream_rollup_append,
    "stream_metrics": q_stream_metrics,
    "stream_smooth": q_stream_smooth,
    "stream_late_rows": q_stream_late_rows,
    "stream_metric_sink": q_stream_metric_sink,
    "load_pairs_split": q_load_pairs_split,
    "checkpoint_roundtrip": q_checkpoint_roundtrip,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        return run
    return {k: wrap(v) for k, v in _QUERIES.items()}
