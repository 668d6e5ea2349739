"""Live metric streams (ST1-ST3) with Structured Streaming.

Sources are file streams over parquet; sinks write to the shared checkpoint folder
(``spark.checkpoint.dir``) through foreachBatch or the file sink, so results survive the
driver and executors.  The ``run_*`` helpers drive a stream over everything available
(``availableNow``) and return the sink as a batch DataFrame.  Given ``state`` (a folder on
shared storage) a run resumes there: its offsets, state and results continue those of the
run before; otherwise it starts in a folder of its own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelframe.config import PrefConfig
from duelframe.functions.metrics import summary_aggs, with_dpo_metrics
from duelframe.operators.training import debiased
from duelframe.session import scratch_path
from duelframe.sources.tables import table_path


# Micro-batch size bound of the file streams (whole files are taken, at least one).
MAX_BYTES_PER_TRIGGER = 256 * 1024 * 1024


def _path_status(spark: SparkSession, path: str):
    """The Hadoop file status of a path on any storage, or None if it does not exist."""
    fs, p = _filesystem(spark, path)
    return fs.getFileStatus(p) if fs.exists(p) else None


def file_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
                max_bytes_per_trigger: int | None = MAX_BYTES_PER_TRIGGER) -> DataFrame:
    """A parquet file stream whose schema is read once from the existing files.

    ``path`` is a folder of parquet files, or one parquet file: then its folder is
    watched with a file-name filter (a stream source must be a folder).  Which of the two
    it is the file system says, whatever the storage.  Micro-batches are bounded by a file
    count or, by default, by bytes.
    """
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", int(max_files_per_trigger))
    elif max_bytes_per_trigger:
        r = r.option("maxBytesPerTrigger", int(max_bytes_per_trigger))
    if _path_status(spark, path).isDirectory():
        return r.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    return r.option("pathGlobFilter", name).parquet(folder)


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _epochs(spark: SparkSession, out: str) -> list[int]:
    """The epochs with a folder under ``out``, ascending.  An epoch starts when those before it are
    complete, so only the last one can be a broken attempt, and the stream repeats it."""
    fs, p = _filesystem(spark, out)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(x[len("epoch="):]) for x in names if x.startswith("epoch="))


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _filesystem(spark, path)
    fs.delete(p, True)


def _folders(spark: SparkSession, state: str | None, name: str) -> tuple[str, str]:
    """(results, checkpoint) of a run."""
    base = state or scratch_path(spark, name)
    return f"{base}/out", f"{base}/checkpoint"


# ---------------------------------------------------------------- ST1

def stream_rollup(events: DataFrame, window: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """ST1: event-time tumbling windows per event type with bounded lateness.

    ``withWatermark`` needs TIMESTAMP, so TIMESTAMP_NTZ event time is read as UTC.
    """
    ev = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    g = (ev.withWatermark("ts", delay)
         .groupBy(F.window("ts", window).alias("w"), "event_type")
         .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("avg_value"), F.sum("value").alias("sum_value")))
    return g.select(F.col("w.start").cast("long").alias("window_start"), "event_type", "n", "avg_value",
                    "sum_value")


def _complete_to(path: str):
    def sink(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)
    return sink


ROLLUP_OUT = "window_start bigint, event_type string, n bigint, avg_value double, sum_value double"


def run_stream_rollup(spark: SparkSession, sf_dir: str, window: str = "6 hours", delay: str = "1 hour",
                      output_mode: str = "complete", max_files_per_trigger: int | None = None,
                      source_path: str | None = None, state: str | None = None,
                      max_bytes_per_trigger: int | None = MAX_BYTES_PER_TRIGGER) -> DataFrame:
    """ST1 over everything available.  ``append`` emits a window once, when the watermark has
    passed its end, and then frees its state; ``complete`` keeps every window."""
    if output_mode not in ("complete", "append"):
        raise ValueError("output_mode must be 'complete' or 'append'")
    src = file_stream(spark, source_path or table_path(sf_dir, "events"), max_files_per_trigger, max_bytes_per_trigger)
    agg = stream_rollup(src, window, delay)
    out, ckpt = _folders(spark, state, "stream-rollup")
    w = agg.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True)
    if output_mode == "complete":
        q = w.outputMode("complete").foreachBatch(_complete_to(out)).start()
    else:
        q = w.outputMode("append").format("parquet").option("path", out).start()
    q.awaitTermination()
    if _path_status(spark, out) is None:       # no batch was run: the source has no file
        return spark.createDataFrame([], ROLLUP_OUT)
    return spark.read.schema(ROLLUP_OUT).parquet(out)


def late_rows(spark: SparkSession, source_path: str, state: str) -> DataFrame:
    """What became of the rows of an append-mode roll-up that ran with ``state``: per event type the
    rows read, those in emitted windows, those in windows still open, and the late ones, which the
    watermark dropped because their window had been emitted.

    Emitted rows are counted in the sink and open ones in the stream's state store; the rest of
    what the stream read is late."""
    out, ckpt = _folders(spark, state, "")
    n = F.col("value").cast("struct<n:bigint,value_sum:double,value_n:bigint,total:double>")["n"]     # the aggregate's buffers
    opened = spark.read.format("statestore").load(ckpt).select(F.col("key.event_type").alias("event_type"), F.lit("open").alias("as"), n.alias("n"))
    closed = spark.read.schema(ROLLUP_OUT).parquet(out).select("event_type", F.lit("emitted").alias("as"), "n")
    read = spark.read.parquet(source_path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select("event_type", F.lit("read").alias("as"), "n")

    def total(name):
        return F.coalesce(F.sum(F.when(F.col("as") == name, F.col("n"))), F.lit(0))

    rows = read.unionByName(closed).unionByName(opened).groupBy("event_type").agg(
        total("read").alias("n_read"), total("emitted").alias("n_emitted"), total("open").alias("n_open"))
    return rows.withColumn("n_late", F.col("n_read") - F.col("n_emitted") - F.col("n_open"))


def run_stream_late_rows(spark: SparkSession, deliveries: Sequence[DataFrame], window: str = "6 hours",
                         delay: str = "1 hour", state: str | None = None) -> DataFrame:
    """ST1 with late rows: the deliveries arrive one after the other, the append-mode roll-up takes each as
    one micro-batch and resumes from its state, and ``late_rows`` tells what was dropped."""
    base = state or scratch_path(spark, "stream-late")
    for rows in deliveries:
        rows.write.mode("append").parquet(f"{base}/source")
        run_stream_rollup(spark, "", window, delay, "append", source_path=f"{base}/source", state=f"{base}/run", max_bytes_per_trigger=None)
    return late_rows(spark, f"{base}/source", f"{base}/run")


# ---------------------------------------------------------------- S8

SINK_OUT = ("run_id string, tag string, bin bigint, total double, n_values bigint, n bigint, first_step bigint, "
            "last_step bigint, epoch bigint")


def run_metric_sink(spark: SparkSession, source_path: str, every: int = 10, state: str | None = None,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """A log of (run_id, step, tag, value) rows streamed into a metric folder, exactly once.

    A micro-batch writes the sums of the windows of ``every`` steps that it touches under its epoch; a
    repeated epoch replaces what its first attempt wrote.  The sums of a window add up over epochs,
    whatever rows each holds.  Returns the windows of all epochs (the rows of R4)."""
    out, ckpt = _folders(spark, state, "metric-sink")
    every_ = F.lit(int(every))
    src = file_stream(spark, source_path, max_files_per_trigger).select("run_id", F.col("step").cast("bigint").alias("step"), "tag", F.col("value").cast("double").alias("value"))

    def sink(batch: DataFrame, epoch_id: int) -> None:
        (batch.withColumn("bin", ((F.col("step") - 1) / every_).cast("bigint")).groupBy("run_id", "tag", "bin")
         .agg(F.sum("value").alias("total"), F.count("value").alias("n_values"), F.count(F.lit(1)).alias("n"),
              F.min("step").alias("first_step"), F.max("step").alias("last_step"))
         .write.mode("overwrite").parquet(f"{out}/epoch={int(epoch_id)}"))

    q = (src.writeStream.option("checkpointLocation", ckpt)
         .trigger(availableNow=True).outputMode("append").foreachBatch(sink).start())
    q.awaitTermination()
    return read_metric_sink(spark, out, every)


def read_metric_sink(spark: SparkSession, out: str, every: int = 10) -> DataFrame:
    """The windows of a metric folder: run_id, tag, bin, value (the window's mean), n, log_step and
    the first and last step."""
    if _path_status(spark, out) is None:
        parts = spark.createDataFrame([], SINK_OUT)
    else:
        parts = spark.read.schema(SINK_OUT).parquet(out)
    return (parts.groupBy("run_id", "tag", "bin")
            .agg(F.try_divide(F.sum("total"), F.sum("n_values")).alias("value"), F.sum("n").alias("n"),
                 F.min("first_step").alias("first_step"), F.max("last_step").alias("last_step"))
            .withColumn("log_step", (F.col("bin") + 1) * F.lit(int(every))))


# ---------------------------------------------------------------- ST3

def stream_metrics(pair_logps: DataFrame, cfg: PrefConfig = PrefConfig()) -> DataFrame:
    """ST3: running D1-D6 means over a stream of (pc, pr, rc, rr); the batch expressions reused."""
    return with_dpo_metrics(pair_logps, cfg).agg(*summary_aggs())


def run_stream_metrics(spark: SparkSession, sf_dir: str, cfg: PrefConfig = PrefConfig(),
                       source_path: str | None = None, max_files_per_trigger: int | None = None,
                       state: str | None = None) -> DataFrame:
    """The lineitem-derived log-probs (F4) replayed as a stream; complete mode."""
    li = file_stream(spark, source_path or table_path(sf_dir, "lineitem"), max_files_per_trigger)
    q_, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    logps = li.select((-q_).alias("pc"), (-q_ * (F.lit(1.0) + d)).alias("pr"),
                      (-q_ * (F.lit(1.0) + t)).alias("rc"), (-q_ * (F.lit(1.0) + t / F.lit(2.0))).alias("rr"))
    agg = stream_metrics(logps, cfg)
    out, ckpt = _folders(spark, state, "stream-metrics")
    q = (agg.writeStream.option("checkpointLocation", ckpt)
         .trigger(availableNow=True).outputMode("complete").foreachBatch(_complete_to(out)).start())
    q.awaitTermination()
    return spark.read.parquet(out)


# ---------------------------------------------------------------- ST2

LATEST_OUT = "run_id string, n_points bigint, points array<struct<ts:timestamp,event_id:bigint,value:double>>"
RUN_SALTS = 32               # parts of a run whose latest points are found by tasks of their own


def points_that_count(weight: float) -> int:
    """The number of a curve's latest points with any effect on its last smoothed value: the
    weight of an older one, ``weight ** k``, is exactly 0 in double precision."""
    w = float(weight)
    if not 0.0 <= w < 1.0:
        raise ValueError("weight must be in [0, 1)")
    return 1 if w == 0.0 else max(1, math.ceil(745.2 / -math.log(w)))


def latest_points(points: DataFrame, keep: int) -> DataFrame:
    """(run_id, n_points, points): the number of points of each run and its ``keep`` latest ones in
    (ts, event_id) order.  ``points`` has run_id, ts, event_id and value.

    A run of any size is cut down by the tasks that read it and by ``RUN_SALTS`` tasks before its
    points meet, which are then at most ``RUN_SALTS * keep``."""
    by_time = [F.col(c).desc_nulls_last() for c in ("ts", "event_id", "value")]
    salted = points.withColumn("_salt", F.pmod(F.xxhash64("ts", "event_id"), F.lit(RUN_SALTS)))
    part = Window.partitionBy("run_id", "_salt").orderBy(*by_time)
    last = (salted.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= keep)
            .withColumn("_r", F.row_number().over(Window.partitionBy("run_id").orderBy(*by_time))).where(F.col("_r") <= keep)
            .groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value")), asc=False).alias("points")))
    n = points.groupBy(F.col("run_id").alias("_run")).agg(F.count(F.lit(1)).alias("n_points"))
    return last.join(n, last["run_id"].eqNullSafe(n["_run"])).select("run_id", "n_points", "points")


def merge_latest(states: DataFrame, keep: int) -> DataFrame:
    """States of the same runs, in any order and over any time ranges, as one for each run: counts
    add up, and of all their points the latest ``keep`` stay."""
    return (states.groupBy("run_id").agg(F.sum("n_points").alias("n_points"), F.flatten(F.collect_list("points")).alias("points"))
            .select("run_id", "n_points", F.slice(F.sort_array("points", asc=False), 1, keep).alias("points")))


def smoothed_state(states: DataFrame, weight: float) -> DataFrame:
    """(run_id, n_points, last_smoothed) of merged states."""
    w = float(weight)
    each = states.select("run_id", "n_points", F.posexplode("points").alias("k", "p"))
    e = F.sum(F.lit(1.0 - w) * F.pow(F.lit(w), F.col("k").cast("double")) * F.col("p.value"))
    return (each.groupBy("run_id", "n_points").agg(e.alias("e"))
            .select("run_id", "n_points", debiased(F.col("e"), F.col("n_points"), w).alias("last_smoothed")))


def run_stream_smooth(spark: SparkSession, sf_dir: str, weight: float = 0.8, source_path: str | None = None,
                      max_files_per_trigger: int | None = None, state: str | None = None) -> DataFrame:
    """ST2: per-run debiased exponential smoothing over a stream of points.

    The state of a run is its number of points and its latest points in event-time order, as
    many as can have an effect (see ``points_that_count``).  States merge in any order, so points
    may come in any order: the answer is the same however files fall into micro-batches and
    however their time ranges overlap.  Every micro-batch writes the merged state under its
    epoch; a repeated epoch starts from the state before it and replaces what its first attempt
    wrote."""
    keep = points_that_count(weight)
    src = file_stream(spark, source_path or table_path(sf_dir, "events"), max_files_per_trigger)
    points = src.select(F.col("event_type").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
                        F.col("value").cast("double").alias("value"))
    out, ckpt = _folders(spark, state, "stream-smooth")

    def saved(epoch: int) -> str:
        return f"{out}/epoch={epoch}"

    def sink(batch: DataFrame, epoch_id: int) -> None:
        here = batch.sparkSession
        new = latest_points(batch, keep)
        before = [k for k in _epochs(here, out) if k < epoch_id]
        if before:
            new = merge_latest(here.read.schema(LATEST_OUT).parquet(saved(before[-1])).unionByName(new), keep)
        new.write.mode("overwrite").parquet(saved(epoch_id))
        for k in before[:-1]:                      # the state before the last is not read again
            _delete(here, saved(k))

    q = (points.writeStream.option("checkpointLocation", ckpt)
         .trigger(availableNow=True).outputMode("append").foreachBatch(sink).start())
    q.awaitTermination()
    epochs = _epochs(spark, out)
    if not epochs:
        return spark.createDataFrame([], "run_id string, n_points bigint, last_smoothed double")
    return smoothed_state(spark.read.schema(LATEST_OUT).parquet(saved(epochs[-1])), weight)
