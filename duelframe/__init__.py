"""duelframe: preference-pair analytics as Spark DataFrame jobs.

Chat transcripts with a chosen and a rejected answer become pairs; pairs become
token rows; token rows are scored by a policy and a reference model; scores become
pairwise losses, rewards, margins and accuracies; those are summarised by batch,
length bucket, policy and training step, in batch and over live streams.

Typical use::

    from duelframe import extract, sides, fit_bigram, sequence_logps_wide, pair_logps
    from duelframe import with_dpo_metrics, bucket_report, length_key
"""

from duelframe.config import ChatTemplate, PrefConfig
from duelframe.functions.metrics import summary_aggs, with_dpo_metrics
from duelframe.operators.batching import assign_batches, sample_k, select_by_index, step_plan, with_row_index
from duelframe.operators.reports import (batch_metrics, batch_sign_rate, bucket_report, compare_policies,
                                         length_bias_report, policy_margins_by_pair, summarise_batches)
from duelframe.operators.scoring import (BigramModel, external_sequence_logps, fit_bigram, pair_logps,
                                         sequence_logps, sequence_logps_wide)
from duelframe.operators.sides import extract, length_key, sides, truncation_report, validate_pairs
from duelframe.operators.training import fit_linear_dpo, last_smoothed, lr_schedule, rollup_log, smooth

__all__ = [
    "ChatTemplate", "PrefConfig", "summary_aggs", "with_dpo_metrics",
    "assign_batches", "sample_k", "select_by_index", "step_plan", "with_row_index",
    "batch_metrics", "batch_sign_rate", "bucket_report", "compare_policies", "length_bias_report",
    "policy_margins_by_pair", "summarise_batches",
    "BigramModel", "external_sequence_logps", "fit_bigram", "pair_logps", "sequence_logps", "sequence_logps_wide",
    "extract", "length_key", "sides", "truncation_report", "validate_pairs",
    "fit_linear_dpo", "last_smoothed", "lr_schedule", "rollup_log", "smooth",
]
