"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.session import apply_runtime_conf

# Rows and bytes of one Arrow batch handed to a Python worker: bounds the worker's memory
# however long the texts are.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options that the operators here rely on, and ship this package to
    the executors (once for each application), whose Python workers run its functions."""
    apply_runtime_conf(spark)
    for k, v in ARROW_CONF.items():
        spark.conf.set(k, v)
    _ship(spark)
    return spark


_SHIPPED: set[str] = set()


def _ship(spark: SparkSession) -> None:
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    archive = os.path.join(tempfile.mkdtemp(prefix="duelframe-py-"), "duelframe_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), root))
    spark.sparkContext.addPyFile(archive)      # Spark's own file server hands it to executors
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (null for a null id)."""
    return F.crc32(doc_id.cast("string")) % F.lit(modulus)


def with_struct(df: DataFrame, result: Column, names: list[str]) -> DataFrame:
    """``df`` plus the fields ``names`` of a struct column; input columns of the same names
    (compared as Spark compares them, without case) are replaced."""
    taken = {n.lower() for n in names}
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return (df.select(*keep, result.alias("_llm_result"))
              .select(*keep, *[F.col("_llm_result")[n].alias(n) for n in names]))


def utf8_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, valid) of an Arrow string array, without making Python strings.

    ``offsets`` has one entry more than rows and starts at 0; null rows have length 0.
    """
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        valid = arr.is_valid().to_numpy(zero_copy_only=False)
        arr = arr.fill_null("")
    else:
        valid = np.ones(len(arr), dtype=bool)
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), valid
    large = pa.types.is_large_string(arr.type)
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64 if large else np.int32)
    off = off[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0], valid


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each [offsets[i], offsets[i+1]); empty segments give 0."""
    out = np.zeros(len(offsets) - 1, dtype=np.float64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], dtype=np.float64)
    return out
