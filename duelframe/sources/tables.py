"""Scans (S1) and sinks.

Readers return lazy DataFrames; column pruning and filter pushdown reach the parquet
scan because nothing here materialises or selects more than the caller asks for.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.operators.training import rollup_log

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(table_path(sf_dir, name))


def spread(df: DataFrame, partitions: int) -> DataFrame:
    """Round-robin over ``partitions``: for an input of few splits and heavy work per row
    (one large row group is one scan task).  An explicit choice of the caller."""
    return df.repartition(int(partitions))


# Input shape of a preference dataset: two chat arrays per row (JSON lines or parquet).
PAIR_SCHEMA = ("pair_id bigint, chosen array<struct<role:string,content:string>>, "
               "rejected array<struct<role:string,content:string>>, split string")


CORRUPT = "_corrupt_record"


def _parsed_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON files (blank ones apart) as ``value``, parsed as ``_p`` with the line in its field
    ``CORRUPT`` if it is no object of the schema, and the folders' partition columns."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.withColumn("_p", F.from_json("value", f"{schema}, {CORRUPT} string", options))


def load_pairs(spark: SparkSession, path: str, split: str | None = None, fmt: str = "parquet",
               schema: str | None = None, quarantine: bool = False) -> DataFrame:
    """A named split of a pair dataset (parquet or json lines with chosen/rejected chat arrays).

    The ``split`` column is filtered on so the predicate reaches the scan (a folder partitioned by
    ``split=`` is pruned, of any format); asking for a split of a table without that column is an error.
    Pass ``schema`` (e.g. ``PAIR_SCHEMA``) for JSON to skip schema inference over the data.
    A JSON line that is no object, or does not fit the schema, fails the job; with ``quarantine`` (JSON with
    a schema) such lines are left out, and ``bad_records`` gives them.
    """
    if quarantine:
        if fmt != "json" or schema is None:
            raise ValueError("a quarantine needs JSON lines and a schema")
        p = _parsed_lines(spark, path, schema)
        folders = [c for c in p.columns if c not in ("value", "_p")]
        fields = [f for f in p.schema["_p"].dataType.names if f != CORRUPT and f not in folders]
        df = p.where(F.col("_p").isNotNull() & F.col(f"_p.{CORRUPT}").isNull()).select(*[F.col("_p")[f].alias(f) for f in fields], *folders)
    else:
        reader = spark.read.format(fmt)
        if fmt == "json":
            reader = reader.option("mode", "FAILFAST")
        if schema is not None:
            reader = reader.schema(schema)
        df = reader.load(path)
    if split is not None:
        if "split" not in df.columns:
            raise ValueError(f"no column 'split' in {path}")
        df = df.where(F.col("split") == F.lit(split))
    return df


def bad_records(spark: SparkSession, path: str, schema: str = PAIR_SCHEMA) -> DataFrame:
    """The lines that ``load_pairs(..., quarantine=True)`` leaves out: file and line text."""
    p = _parsed_lines(spark, path, schema)
    return p.where(F.col("_p").isNull() | F.col(f"_p.{CORRUPT}").isNotNull()).select(F.input_file_name().alias("file"), F.col("value").alias("line"))


def _name(value: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", value) or value.startswith("."):
        raise ValueError(f"{value!r} cannot be the name of a folder")
    return value


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_checkpoint(df: DataFrame, out_dir: str, run_id: str, step: int) -> None:
    """The table of a step in its own folder, ``run_id=<run>/step=<step>``.

    Writing a step again replaces it.  The step counts as written when its marker is there, which goes
    before the old rows do and comes back after the last new row: a reader never takes a broken
    write for a checkpoint."""
    spark = df.sparkSession
    name = f"run_id={_name(run_id)}/step={int(step)}"
    fs, marker = _fs(spark, f"{out_dir}/_committed/{name}")
    fs.delete(marker, True)
    df.write.mode("overwrite").parquet(f"{out_dir}/{name}")
    fs.mkdirs(marker)


def checkpoint_names(spark: SparkSession, out_dir: str) -> list[tuple[str, int]]:
    """(run_id, step) of the checkpoints that were written whole (two folder listings a run)."""
    fs, top = _fs(spark, f"{out_dir}/_committed")
    if not fs.exists(top):
        return []
    runs = [r.getPath() for r in fs.listStatus(top)]
    return sorted((r.getName()[len("run_id="):], int(s.getPath().getName()[len("step="):])) for r in runs for s in fs.listStatus(r))


def read_checkpoints(spark: SparkSession, out_dir: str, run_id: str | None = None, step: int | None = None) -> DataFrame:
    """The rows of the checkpoints that were written whole, with run_id and step; only the folders
    asked for are read."""
    names = [(r, s) for r, s in checkpoint_names(spark, out_dir) if run_id in (None, r) and step in (None, s)]
    if not names:
        raise FileNotFoundError(f"no checkpoint of run {run_id!r}, step {step!r} in {out_dir}")
    df = spark.read.option("basePath", out_dir).parquet(*[f"{out_dir}/run_id={r}/step={s}" for r, s in names])
    return df.withColumn("run_id", F.col("run_id").cast("string")).withColumn("step", F.col("step").cast("bigint"))


def write_metrics(metric_log: DataFrame, out_dir: str, every: int = 10) -> None:
    """The log's window means (R4: one row for every ``every`` steps, each the mean of its window)
    partitioned by run; every value of the log counts.  A run in the log replaces what the folder
    holds of it (dynamic partition overwrite), so a repeated write leaves its rows once; other runs stay.
    For a log that grows see ``streaming.live.run_metric_sink``."""
    (rollup_log(metric_log, every).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id").parquet(out_dir))


def read_metrics(spark: SparkSession, out_dir: str, run_id: str | None = None) -> DataFrame:
    """Read back a metric log; a run filter prunes partitions."""
    df = spark.read.parquet(out_dir)
    if run_id is not None:
        df = df.where(F.col("run_id") == F.lit(run_id))
    return df
