"""Row positions, slices, samples and batches.

Spark has no row order, so position-based reference behaviour becomes an explicit
``row_idx`` column computed once over a declared order.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.session import materialize


def _same(a: DataFrame, b: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Null-safe equality of column pairs: rows with a null key keep their place."""
    cond = F.lit(True)
    for x, y in pairs:
        cond = cond & a[x].eqNullSafe(b[y])
    return cond


def with_row_index(df: DataFrame, order: Sequence[str], partition_by: Sequence[str] = (),
                   name: str = "row_idx", num_partitions: int | None = None,
                   key: Sequence[str] | None = None) -> DataFrame:
    """Dense 0-based index over ``order`` (within each ``partition_by`` group, nulls being
    a group of their own).

    Equivalent to ``row_number() - 1`` over the same window, without funnelling a whole
    table or a whole hot group into one task.  Only the group, order and ``key`` columns are
    range-partitioned, sorted and written to the shared checkpoint folder, each row with its
    position inside its partition (so the positions stay fixed after an executor loss); the
    index of a row is its partition's offset plus that position.  The offset table has one
    row per (partition, group) and is the only thing a window runs over.  All other columns
    are joined back by ``key``, which must identify a row (default: group and order columns,
    which must then form a total order), else an error; a table of key columns only is not joined.
    """
    spark = df.sparkSession
    grp, by = list(partition_by), [*partition_by, *order]
    key = list(key or by)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = df.select(*dict.fromkeys([*by, *key]))
    tagged = materialize(slim.repartitionByRange(n, *by).sortWithinPartitions(*by)
                         .withColumn("_mid", F.monotonically_increasing_id()), "row-index")
    tagged = tagged.withColumn("_pid", F.shiftright(F.col("_mid"), 33))
    counts = tagged.groupBy("_pid", *grp).agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_first"))
    w = Window.partitionBy(*grp).orderBy("_pid") if grp else Window.orderBy("_pid")
    before = F.coalesce(F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("_pid").alias("_p"), *[F.col(g).alias(f"_g_{g}") for g in grp],
                            (before - F.col("_first")).alias("_shift"))
    cond = _same(tagged, offsets, [("_pid", "_p"), *[(g, f"_g_{g}") for g in grp]])
    index = tagged.join(offsets, cond).select(*key, (F.col("_mid") + F.col("_shift")).cast("bigint").alias(name))
    if set(df.columns) <= set(key):
        return index
    if tagged.groupBy(*key).count().where("count > 1").first() is not None:
        raise ValueError(f"key {key} does not identify a row")
    index = index.select(*[F.col(k).alias(f"_k_{k}") for k in key], name)
    return df.join(index, _same(df, index, [(k, f"_k_{k}") for k in key])).drop(*[f"_k_{k}" for k in key])


def head_slice(df: DataFrame, n: int, order: Sequence[str] = ("row_idx",)) -> DataFrame:
    """The first n rows by an order (``train[:n]``); never a bare limit.

    A top-k (every partition keeps n rows); ``row_idx`` is the place among them."""
    if "row_idx" in df.columns:
        return df.where(F.col("row_idx") < F.lit(int(n)))
    top = df.orderBy(*order).limit(int(n))
    return top.withColumn("row_idx", (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint"))


def select_by_index(df: DataFrame, ids: Sequence[int], idx_col: str = "row_idx") -> DataFrame:
    """S3: rows at the given positions, in list order, duplicates kept (column ``sel_pos``).

    A position that the table does not have is an error.
    """
    spark = df.sparkSession
    sel = spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], f"sel_pos int, {idx_col} bigint")
    lost = sel.join(df.select(idx_col), on=idx_col, how="left_anti").first()
    if lost is not None:
        raise IndexError(f"no row at position {lost[idx_col]}")
    return df.join(sel, on=idx_col, how="inner")


def hash_key(id_col, seed: int) -> Column:
    """Seed-dependent pseudo-random order key, identical in DuckDB (md5 of 'seed:id')."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{int(seed)}:"), c.cast("string")))


def sample_k(df: DataFrame, k: int, seed: int, id_col: str, mode: str = "hash") -> DataFrame:
    """K rows without replacement (k = min(k, n)) chosen by seed.

    mode='hash': distributed top-k over md5('seed:id'); each partition keeps k rows and
    a final merge keeps k, so nothing larger than k rows meets in one place.
    mode='python': draws positions like ``random.Random(seed).sample(range(n), k)`` on the
    driver (n is one count; k ints travel), then selects them with S3 on the ids' index.
    """
    if mode == "hash":
        key = hash_key(id_col, seed)
        top = df.withColumn("sample_key", key).orderBy("sample_key", id_col).limit(int(k))
        return top.withColumn("sample_pos", (F.row_number().over(Window.orderBy("sample_key", id_col)) - 1)
                              .cast("int"))
    if mode != "python":
        raise ValueError("mode must be 'hash' or 'python'")
    index = df.select(id_col, "row_idx") if "row_idx" in df.columns else with_row_index(df.select(id_col), [id_col])
    n = index.count()
    ids = random.Random(seed).sample(range(n), min(int(k), n))
    drawn = select_by_index(index, ids).withColumnRenamed("sel_pos", "sample_pos")
    return df.drop("row_idx").join(drawn, on=id_col)


def shuffle_take(df: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """Seeded shuffle, then the first n rows; ``row_idx`` is the shuffled position.  A
    top-k over the hash order: rows past the first n of each partition never move."""
    return head_slice(df.drop("row_idx").withColumn("_hk", hash_key(id_col, seed)), n, ["_hk", id_col]).drop("_hk")


def assign_batches(df: DataFrame, size: int, drop_last: bool = False, idx_col: str = "row_idx") -> DataFrame:
    """A1: batch_id = row_idx div size; optionally drop the short last batch."""
    out = df.withColumn("batch_id", (F.col(idx_col) / F.lit(int(size))).cast("bigint"))
    if drop_last:
        total = df.agg(F.count(F.lit(1)).alias("_n"))
        full = F.broadcast(total.select((F.col("_n") / F.lit(int(size))).cast("bigint").alias("_full")))
        out = out.crossJoin(full).where(F.col("batch_id") < F.col("_full")).drop("_full")
    return out


def step_plan(df: DataFrame, batch_size: int = 1, grad_accum: int = 8, epochs: int = 1,
              max_steps: int | None = None, idx_col: str = "row_idx") -> DataFrame:
    """Rows -> micro-batches -> optimiser steps (1-based), partial last step dropped.

    With several epochs every row appears once per epoch.  The per-epoch step count is a
    one-row aggregate joined back (a one-row broadcast).
    """
    per_step = int(batch_size) * int(grad_accum)
    n = df.agg(F.count(F.lit(1)).alias("_n")).select(
        (F.col("_n") / F.lit(per_step)).cast("bigint").alias("steps_per_epoch"))
    ep = df.sparkSession.range(int(epochs)).withColumnRenamed("id", "epoch")
    out = (df.crossJoin(F.broadcast(ep)).crossJoin(F.broadcast(n))
           .withColumn("micro_batch", (F.col(idx_col) / F.lit(int(batch_size))).cast("bigint"))
           .withColumn("_s", (F.col(idx_col) / F.lit(per_step)).cast("bigint"))
           .where(F.col("_s") < F.col("steps_per_epoch"))
           .withColumn("step", F.col("epoch") * F.col("steps_per_epoch") + F.col("_s") + F.lit(1))
           .drop("_s"))
    if max_steps is not None:
        out = out.where(F.col("step") <= F.lit(int(max_steps)))
    return out
