"""The training run as data (R2-R6) and a distributed linear preference fit."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duelframe.functions.logits import dot
from duelframe.functions.metrics import log_sigmoid, sigmoid
from duelframe.operators.batching import step_plan, with_row_index
from duelframe.session import materialize


# ---------------------------------------------------------------- schedules and logs

def lr_schedule(steps: DataFrame, total_col: str = "total_steps", peak: float = 1e-6,
                warmup_ratio: float = 0.03, step_col: str = "step_idx") -> DataFrame:
    """R2: linear warm-up then cosine decay to 0.

    ``step_idx`` is the 0-based number of updates already taken; warm-up length is
    ceil(ratio * total).  Steps come from the data's own step plan.
    """
    s = F.col(step_col).cast("double")
    total = F.col(total_col).cast("double")
    warm = F.ceil(F.lit(float(warmup_ratio)) * total).cast("double")
    progress = (s - warm) / F.greatest(F.lit(1.0), total - warm)
    cosine = F.greatest(F.lit(0.0), F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi) * progress)))
    factor = F.when(s < warm, s / F.greatest(F.lit(1.0), warm)).otherwise(cosine)
    return steps.withColumn("warmup_steps", warm.cast("bigint")).withColumn("lr", F.lit(float(peak)) * factor)


def rollup_log(metric_log: DataFrame, every: int = 10) -> DataFrame:
    """Mean of each tag over windows of ``every`` steps.

    Steps are 1-based: bin b covers steps ``every*b + 1`` to ``every*(b+1)``, the step at
    which the window is logged (``log_step``)."""
    n = F.lit(int(every))
    return (metric_log.withColumn("bin", ((F.col("step") - 1) / n).cast("bigint"))
            .groupBy("run_id", "tag", "bin")
            .agg(((F.col("bin") + 1) * n).alias("log_step"), F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"),
                 F.min("step").alias("first_step"), F.max("step").alias("last_step")))


def checkpoint_steps(metric_log: DataFrame, every: int = 1000) -> DataFrame:
    """Steps that get a checkpoint: every ``every`` steps plus the run's last step.

    One maximum per run and one filter; only the kept steps are made distinct."""
    last = metric_log.groupBy("run_id").agg(F.max("step").alias("step")).withColumn("is_last", F.lit(True))
    kept = metric_log.where((F.col("step") % F.lit(int(every))) == 0).select("run_id", "step", F.lit(False).alias("is_last"))
    return kept.unionByName(last).groupBy("run_id", "step").agg(F.max("is_last").alias("is_last"))


def smooth(df: DataFrame, weight: float, group_cols: Sequence[str], index_col: str, value_col: str = "value",
           out_col: str = "smoothed", dense: bool = True) -> DataFrame:
    """Debiased exponential smoothing of a curve, as a distributed exact scan.

    For the k-th point (1-based) of a group: E_k = w E_{k-1} + (1-w) v_k, E_0 = 0, and the
    smoothed value is E_k / (1 - w^k).  Points are cut into blocks of B consecutive
    indices; a window inside each block (at most B rows) gives the block-local sums, a
    small block table carries the state across blocks, and each point adds its block's
    incoming state.  Block carries older than D blocks are multiplied by w^(D*B), which
    is exactly 0.0 in double precision, so the result equals the full sequential sum.
    No group, however large, is handled by one task.  ``index_col`` must be a dense
    1-based position; pass dense=False to derive it from the column's order.
    """
    w = float(weight)
    if not 0.0 <= w < 1.0:
        raise ValueError("weight must be in [0, 1)")
    grp = list(group_cols)
    if not dense:
        df = (with_row_index(df, [index_col], partition_by=grp, name="_k0")
              .withColumn("_k", F.col("_k0") + 1).drop("_k0"))
    else:
        df = df.withColumn("_k", F.col(index_col).cast("bigint"))
    if w == 0.0:
        return df.withColumn(out_col, F.col(value_col).cast("double")).drop("_k")
    lam = -math.log(w)
    block = max(1, min(1024, int(600.0 / lam)))
    depth = int(745.2 / (block * lam)) + 2
    wl = F.lit(w)
    d = (df.withColumn("_b", F.floor((F.col("_k") - 1) / F.lit(block)).cast("bigint"))
         .withColumn("_o", (F.col("_k") - 1 - F.col("_b") * F.lit(block)).cast("double"))
         .withColumn("_x", F.pow(wl, -F.col("_o")) * F.col(value_col).cast("double")))
    win = Window.partitionBy(*grp, "_b").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_local", F.lit(1.0 - w) * F.pow(wl, F.col("_o")) * F.sum("_x").over(win))
    blocks = d.groupBy(*grp, "_b").agg(F.sum("_x").alias("_sx"), F.count(F.lit(1)).alias("_len"))
    blocks = blocks.withColumn("_s", F.lit(1.0 - w) * F.pow(wl, (F.col("_len") - 1).cast("double")) * F.col("_sx"))
    carry = (blocks.select(*grp, "_b", "_s", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("_d"))
             .withColumn("_t", F.col("_b") + F.lit(1) + F.col("_d"))
             .groupBy(*grp, "_t")
             .agg(F.sum(F.col("_s") * F.pow(wl, (F.col("_d") * F.lit(block)).cast("double"))).alias("_carry"))
             .select(*[F.col(g).alias(f"_g_{g}") for g in grp], "_t", "_carry"))
    cond = d["_b"] == carry["_t"]
    for g in grp:
        cond = cond & d[g].eqNullSafe(carry[f"_g_{g}"])
    out = d.join(carry, cond, "left").drop("_t", *[f"_g_{g}" for g in grp])
    e = F.coalesce(F.col("_carry"), F.lit(0.0)) * F.pow(wl, F.col("_o") + F.lit(1.0)) + F.col("_local")
    debias = F.lit(1.0) - F.pow(wl, F.col("_k").cast("double"))
    return out.withColumn(out_col, e / debias).drop("_b", "_o", "_x", "_local", "_carry", "_k")


def last_smoothed(df: DataFrame, weight: float, group_cols: Sequence[str], index_col: str,
                  value_col: str = "value") -> DataFrame:
    """Final smoothed value per group in closed form: one aggregate, no scan.

    E_n = sum_i (1-w) w^(n-i) v_i with n the group's last index; w^(n-i) underflows to 0
    for old points exactly as it would in a sequential loop.
    """
    w = float(weight)
    grp = list(group_cols)
    parts = smooth_part(df, w, grp, index_col, value_col)
    return parts.select(*grp, "n_points", debiased(F.col("e"), F.col("n_points"), w).alias("last_smoothed"))


def smooth_part(df: DataFrame, weight: float, group_cols: Sequence[str], index_col: str,
                value_col: str = "value") -> DataFrame:
    """(group, n_points, e): number of points and the undebiased average E_n of each group.

    Two consecutive parts combine as ``E = w^n2 * E1 + E2``, ``n = n1 + n2``."""
    w, grp = float(weight), list(group_cols)
    n = df.groupBy(*grp).agg(F.max(index_col).alias("_n"))
    n = n.select(*[F.col(g).alias(f"_g_{g}") for g in grp], "_n")
    cond = F.lit(True)
    for g in grp:
        cond = cond & df[g].eqNullSafe(n[f"_g_{g}"])
    term = F.lit(1.0 - w) * F.pow(F.lit(w), (F.col("_n") - F.col(index_col)).cast("double")) * F.col(value_col)
    return df.join(n, cond).groupBy(*grp).agg(F.max("_n").alias("n_points"), F.sum(term).alias("e"))


def debiased(e, n, weight: float):
    """E_n / (1 - w^n)."""
    return e / (F.lit(1.0) - F.pow(F.lit(float(weight)), n.cast("double")))


# ---------------------------------------------------------------- linear preference model

def feature_deltas(pairs: DataFrame) -> DataFrame:
    """Delta phi = phi_chosen - phi_rejected per pair."""
    return pairs.select("pair_id", F.zip_with("phi_chosen", "phi_rejected", lambda a, b: a - b).alias("dphi"))


def gradient(deltas: DataFrame, theta, beta: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    """Mean gradient of the DPO loss of a linear reward beta * theta . phi, over all pairs or
    for each group ``by``.

    ``theta`` is a one-row table with an array column ``theta`` (lazy, e.g. derived from
    the data) or a list of floats.  A list becomes one array constant: the generated code
    does not change between steps (the constant is passed by reference), and no
    per-step broadcast job is needed.  The gradient is one vector mean (JVM Summarizer,
    partial per partition then merged), so a step is one job whatever the dimension.
    Returns one row (a group): n, loss, accuracy, grad (array<double>).
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    b = F.lit(float(beta))
    if isinstance(theta, DataFrame):
        j = deltas.crossJoin(F.broadcast(theta))   # one row
        th = F.col("theta")
    else:
        j = deltas
        vals = [float(x) for x in theta]
        if all(math.isfinite(v) for v in vals):
            # one SQL array literal: a single call to build; repr() round-trips doubles exactly
            th = F.expr("array(" + ", ".join(repr(v) + "D" for v in vals) + ")").cast("array<double>")
        else:
            th = F.array(*[F.lit(v) for v in vals]).cast("array<double>")
    scored = j.select(*by, "dphi", dot(th, F.col("dphi")).alias("s"))
    s = F.col("s")
    coef = -b * sigmoid(-b * s)
    rows = scored.select(
        *by, (-log_sigmoid(b * s)).alias("loss"),
        (s > 0).cast("double").alias("acc"),
        array_to_vector(F.transform("dphi", lambda x: coef * x)).alias("g"))
    agg = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("loss").alias("loss"), F.avg("acc").alias("accuracy"),
                                Summarizer.mean(F.col("g")).alias("g"))
    return agg.select(*by, "n", "loss", "accuracy", vector_to_array("g").alias("grad"))


def fit_linear_dpo(pairs: DataFrame, beta: float = 0.1, steps: int = 60, lr: float = 50.0) -> DataFrame:
    """Plain full-batch gradient descent on the linear preference model.

    The deltas are cached once, partitioned as they arrive, so the data are read once and
    each step is one aggregation job returning one row (the mean gradient, O(dimension));
    theta is updated on the driver.  Returns the step log: step, loss,
    accuracy, grad_norm_sq, with step 0 at theta = 0 and step s after s updates.
    """
    spark = pairs.sparkSession
    deltas = feature_deltas(pairs).persist()
    dim = int(deltas.agg(F.max(F.size("dphi")).alias("d")).first()["d"] or 0)
    theta = [0.0] * dim
    log = []
    for step in range(int(steps) + 1):
        row = gradient(deltas, theta, beta).first()
        g = list(row["grad"])
        log.append((step, float(row["loss"]), float(row["accuracy"]), float(sum(x * x for x in g))))
        if step < steps:
            theta = [t - lr * gi for t, gi in zip(theta, g)]
    deltas.unpersist()
    return spark.createDataFrame(log, "step int, loss double, accuracy double, grad_norm_sq double")


def prefix_sums(rows: DataFrame, index_col: str, dim_col: str, value_col: str, out_col: str,
                block: int = 1024) -> DataFrame:
    """``rows`` with the running sum of ``value_col`` over the 1-based ``index_col``, for each
    dimension.  A window runs inside a block of ``block`` positions, another over one total per
    (block, dimension); the two are added, so no dimension's whole curve is one task's."""
    rows = rows.withColumn("_b", F.floor((F.col(index_col) - 1) / F.lit(int(block))).cast("bigint"))
    inside = Window.partitionBy(dim_col, "_b").orderBy(index_col).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(F.col(dim_col).alias("_dim"), F.col("_b").alias("_blk")).agg(F.sum(value_col).alias("_t"))
    earlier = Window.partitionBy("_dim").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("_dim", "_blk", F.coalesce(F.sum("_t").over(earlier), F.lit(0.0)).alias("_c"))
    return (rows.withColumn("_w", F.sum(value_col).over(inside))
            .join(carry, (F.col(dim_col) == F.col("_dim")) & (F.col("_b") == F.col("_blk")))
            .withColumn(out_col, F.col("_w") + F.col("_c")).drop("_b", "_w", "_dim", "_blk", "_c"))


def fit_linear_dpo_epochs(pairs: DataFrame, beta: float = 0.1, epochs: int = 1, lr: float = 50.0,
                          batch_size: int = 1, grad_accum: int = 8, warmup_ratio: float = 0.03,
                          block: int = 1024) -> DataFrame:
    """R3 in the optimiser steps of R1's plan, with R2's rates: a few jobs an epoch, whatever
    the number of steps.

    Pairs in ``pair_id`` order form steps of ``batch_size * grad_accum`` rows (the last, partial
    one is dropped).  One pass an epoch sums the gradient of every step; all of them are taken
    at the parameters with which the epoch began, as each step waiting for the one before it
    would be a chain of one job (or one task) over the whole corpus.  The steps then move theta
    in their order.  ``lr`` is the rate of a whole epoch: a step moves by its mean gradient
    times ``lr / steps_per_epoch`` and its place in the warm-up and cosine schedule, so an epoch
    goes as far at any size of the data.  ``pair_id`` must identify a row, else an error.

    Returns one row a step: epoch (from 0), step (1-based over all epochs), n_pairs, loss and
    accuracy of its pairs at the epoch's first parameters, rate, grad_norm_sq, and theta_norm_sq
    after the step.  No full step: no rows.

    Only theta (O(dimension)) and sums of moves come to the driver.  The deltas are written once
    by range of steps, so a step's rows meet before the shuffle; an epoch's steps are written
    too, and the next epoch reads none of the earlier ones' lineage.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    epochs = int(epochs)
    deltas = feature_deltas(pairs)
    plan = step_plan(with_row_index(deltas, ["pair_id"]), batch_size, grad_accum)
    rows = materialize(plan.select("dphi", F.col("step").alias("_s"), F.col("steps_per_epoch").alias("_spe"))
                       .repartitionByRange("_s"), "linear-steps")
    theta = [0.0] * int(rows.agg(F.max(F.size("dphi")).alias("d")).first()["d"] or 0)
    log = None
    for e in range(epochs):
        steps = gradient(rows, theta, beta, by=["_s", "_spe"]).select(
            F.lit(e).cast("bigint").alias("epoch"), (F.lit(e) * F.col("_spe") + F.col("_s")).alias("step"),
            (F.col("_spe") * F.lit(epochs)).alias("_total"), "_spe", F.col("n").alias("n_pairs"), "loss", "accuracy", "grad")
        steps = lr_schedule(steps.withColumn("_idx", F.col("step") - 1), "_total", lr, warmup_ratio, "_idx")
        steps = steps.withColumn("rate", F.col("lr") / F.col("_spe"))
        steps = materialize(steps.select("epoch", "step", "n_pairs", "loss", "accuracy", "rate", "grad",
                                         F.transform("grad", lambda g: -F.col("rate") * g).alias("move")), "linear-epoch")
        log = steps if log is None else log.unionByName(steps)
        if e < epochs - 1 and theta:
            moved = steps.agg(Summarizer.sum(array_to_vector("move")).alias("m")).select(vector_to_array("m").alias("m"))
            theta = [t + m for t, m in zip(theta, moved.first()["m"] or [])]
    at = prefix_sums(log.select("step", F.posexplode("move").alias("dim", "move")), "step", "dim", "move", "theta", block)
    norms = at.groupBy("step").agg(F.sum(F.col("theta") * F.col("theta")).alias("theta_norm_sq"))
    grad_norm = F.aggregate("grad", F.lit(0.0), lambda a, g: a + g * g)
    return log.select("epoch", "step", "n_pairs", "loss", "accuracy", "rate", grad_norm.alias("grad_norm_sq")).join(norms, "step")
