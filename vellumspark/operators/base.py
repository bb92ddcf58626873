"""Tables in the shared folder, which cut lineage between rounds of iterative operators, and what keeps Python workers small and busy."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that Spark sends to a worker at once; its own limits are 64 MB and 10,000 rows.
BATCH_BYTES = 4 << 20
#: Parts that costly rows are dealt into: for each core, and of the shuffle's own number at most.
PARTS_A_CORE, PARTS_AT_MOST = 3, 64


def small_batches(spark: SparkSession) -> None:
    """From now on Spark sends workers at most BATCH_BYTES at once, so that what a worker holds doesn't grow with the table."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def release() -> None:
    """Gives a worker's unused memory back to the system: workers live on, and what one step leaves lies beside the next one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt out to all cores, for steps that take long over each: a table of few row groups would be worked on by as few tasks."""
    spark = rows.sparkSession
    n = min(PARTS_AT_MOST, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(max(n, PARTS_A_CORE * spark.sparkContext.defaultParallelism))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; in local mode, where it is unset, in a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "round") -> DataFrame:
    """Writes df to the shared folder once and reads it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
