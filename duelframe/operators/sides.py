"""Pair extraction (P1-P4, P8) and the per-side token table.

``sides`` has one row per (pair_id, side) with whole-text token arrays, raw and
truncated lengths and the bigram context of the first answer word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.config import TRAINER_CAPS, ChatTemplate, PrefConfig
from duelframe.functions import chat as C
from duelframe.functions import text as T

SIDES = ("chosen", "rejected")
CARRIED = ("row_idx", "batch_id")      # columns of a pair that stay with its sides


def extract(pairs: DataFrame, mode: str = "last_assistant", on_missing: str = "empty") -> DataFrame:
    """P1 / P2 / P3 as one operator with the mode as an explicit column.

    Output: pair_id, extract_mode, prompt_msgs_chosen, prompt_msgs_rejected, prompt_text,
    chosen_text, rejected_text, prompt_same, valid.
    """
    c, r = F.col("chosen"), F.col("rejected")
    if mode == "last_assistant":
        p_c, a_c, f_c = C.split_last_assistant(c, on_missing)
        p_r, a_r, f_r = C.split_last_assistant(r, on_missing)
        valid = f_c & f_r
    elif mode == "positional":
        prompt, a_c, a_r, valid = C.positional(c, r)
        p_c = F.slice(c, F.lit(1), F.least(F.size(c), F.lit(1)))
        p_r = F.slice(r, F.lit(1), F.least(F.size(r), F.lit(1)))
    elif mode == "common_prefix":
        k = C.common_prefix_len(c, r)
        p_c = F.slice(c, F.lit(1), k)
        p_r = F.slice(r, F.lit(1), k)
        a_c = C.chat_text(C.tail(c, k))
        a_r = C.chat_text(C.tail(r, k))
        valid = k > 0
    else:
        raise ValueError("mode must be 'last_assistant', 'positional' or 'common_prefix'")
    prompt_text = prompt if mode == "positional" else C.chat_text(p_c)
    return pairs.select(
        "pair_id", *[x for x in pairs.columns if x in CARRIED],
        F.lit(mode).alias("extract_mode"),
        p_c.alias("prompt_msgs_chosen"), p_r.alias("prompt_msgs_rejected"),
        prompt_text.alias("prompt_text"), a_c.alias("chosen_text"), a_r.alias("rejected_text"),
        p_c.eqNullSafe(p_r).alias("prompt_same"), valid.alias("valid"))


def check_prompt_same(extracted: DataFrame, on_fail: str = "flag") -> DataFrame:
    """P4: 'flag' keeps the column, 'drop' quarantines mismatches, 'raise' fails the job."""
    if on_fail == "flag":
        return extracted
    if on_fail == "drop":
        return extracted.where("prompt_same")
    if on_fail == "raise":
        return extracted.withColumn(
            "_chk", F.when(~F.col("prompt_same"), F.raise_error(F.lit("prompt mismatch between sides"))))\
            .drop("_chk")
    raise ValueError("on_fail must be 'flag', 'drop' or 'raise'")


def sides(extracted: DataFrame, cfg: PrefConfig = PrefConfig(), template: ChatTemplate | None = None) -> DataFrame:
    """unpivot to one row per side; tokenise; truncate (T1-T3) where ``cfg`` has caps.

    With a ``template`` the prompt is the rendered chat up to the generation marker (P5),
    so prompt lengths and the first answer word's context include the markers.

    Columns: pair_id, side, prompt_tokens, answer_tokens, prompt_len_raw, prompt_len,
    answer_len_raw, answer_len, prompt_truncated, truncated, context0 (last prompt word).
    """
    keep = ["pair_id"] + [x for x in extracted.columns if x in CARRIED]

    def prompt(s):
        msgs = F.col(f"prompt_msgs_{s}")
        return C.chat_text(msgs) if template is None else C.render_chat(msgs, template, add_generation_prompt=True)

    per_side = F.inline(F.array(*[
        F.struct(F.lit(s).alias("side"), prompt(s).alias("p_text"),
                 F.col(f"{s}_text").alias("a_text"))
        for s in SIDES]))
    base = extracted.select(*keep, per_side)
    raw_p = T.tokens(F.col("p_text"))
    raw_a = T.tokens(F.col("a_text"))
    out = (base
           .withColumn("_rp", raw_p)
           .withColumn("_ra", raw_a)
           .withColumn("prompt_tokens", T.truncate_prompt(F.col("_rp"), cfg.max_prompt_length, cfg.prompt_keep))
           .withColumn("prompt_len", F.size("prompt_tokens"))
           .withColumn("answer_tokens", T.truncate_answer(F.col("_ra"), F.col("prompt_len"), cfg.max_length,
                                                          cfg.answer_keep))
           .select(*keep, "side", "prompt_tokens", "answer_tokens",
                   F.size("_rp").alias("prompt_len_raw"), "prompt_len",
                   F.size("_ra").alias("answer_len_raw"), F.size("answer_tokens").alias("answer_len"),
                   (F.size("prompt_tokens") < F.size("_rp")).alias("prompt_truncated"),
                   (F.size("answer_tokens") < F.size("_ra")).alias("truncated"),
                   F.get(F.col("_rp"), F.size("_rp") - F.lit(1)).alias("context0"),
                   F.col("a_text").isNull().alias("answer_missing")))
    return out


def length_key(side_rows: DataFrame, by: str = "prompt") -> DataFrame:
    """One length per pair: prompt, chosen, rejected or pair_total (answers; missing -> 0).

    Sides are pivoted with explicit values (no extra distinct job); prompt length is the
    truncated one, as in the reference (B7); the raw length is kept beside it.
    """
    g = side_rows.groupBy("pair_id").agg(
        F.max(F.when(F.col("side") == "chosen", F.col("prompt_len"))).alias("prompt"),
        F.max(F.when(F.col("side") == "chosen", F.col("prompt_len_raw"))).alias("prompt_raw"),
        F.max(F.when(F.col("side") == "chosen", F.col("answer_len"))).alias("chosen"),
        F.max(F.when(F.col("side") == "rejected", F.col("answer_len"))).alias("rejected"))
    total = F.coalesce(F.col("chosen"), F.lit(0)) + F.coalesce(F.col("rejected"), F.lit(0))
    g = g.withColumn("pair_total", total)
    if by not in ("prompt", "chosen", "rejected", "pair_total"):
        raise ValueError("by must be prompt, chosen, rejected or pair_total")
    return g.withColumn("length_key", F.col(by))


def truncation_report(side_rows: DataFrame, cfg: PrefConfig = TRAINER_CAPS) -> DataFrame:
    """T4: strict '>' limit flags on untruncated lengths, next to the truncated lengths."""
    full_raw = F.col("prompt_len_raw") + F.col("answer_len_raw")
    return side_rows.select(
        "pair_id", "side", "prompt_len_raw", "prompt_len", "answer_len_raw", "answer_len",
        full_raw.alias("full_len_raw"),
        (F.col("prompt_len") + F.col("answer_len")).alias("full_len"),
        (F.col("prompt_len_raw") > F.lit(cfg.max_prompt_length)).alias("over_prompt_limit"),
        (full_raw > F.lit(cfg.max_length)).alias("over_max_length"),
        ((F.col("prompt_len") + F.col("answer_len_raw")) > F.lit(cfg.max_length)).alias("over_after_prompt_cut"),
        F.col("truncated"))


def validate_pairs(pairs: DataFrame) -> DataFrame:
    """Every pair with its list of structural errors."""
    return pairs.withColumn("errors", C.validation_errors(F.col("chosen"), F.col("rejected")))
