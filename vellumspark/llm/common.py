"""Shared pieces: shared-folder tables, bounded Arrow slices, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step inside a Python worker handles at once.
SLICE_BYTES = 4 << 20
#: Bytes of rows that Spark sends to a worker at once; its own limit is 64 MB.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on Spark sends workers at most BATCH_BYTES at once: for every running task, the JVM and the worker each hold a batch, and twice while it grows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode, where it is unset, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def whole_uri(path: str) -> str:
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path in the shared folder, and the path there."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Shuffle files that no plan needs any more go from the executors' disks now: Spark's cleaner finds them when the driver's garbage is collected, which may be half an hour later. What ended just now is found by the second round."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def release() -> None:
    """Gives a worker's unused memory back to the system: workers live on, and what one step leaves lies beside the next one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each slice has at most `most` bytes in `column`, or one row."""
    for batch in batches:
        at, held = 0, 0
        for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            n = n or 0
            if held and held + n > most:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < batch.num_rows:
            yield batch.slice(at)


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Smallest reachable id of each vertex of an undirected graph.

    edges: columns a, b (long). Nulls and loops are ignored. Returns id, component; vertices without
    an edge don't occur. Each round takes the least label among neighbours, then jumps twice to the
    label's label, so the number of rounds grows with the logarithm of the longest chain. Every round
    is written to the shared folder.
    """
    spark = edges.sparkSession
    e = edges.where("a is not null and b is not null and a <> b")
    both = stored(e.selectExpr("a", "b").union(e.selectExpr("b", "a")).distinct(), f"{name}-edges")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), name)
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        new = labels.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        new = new.join(jump, "label").select("id", "was", F.least("label", "up").alias("label"))
        new = stored(new, name)
        changed = new.where("label <> was").limit(1).count()
        drop_stored(labels)
        labels = new.select("id", "label")
        if not changed:
            break
    drop_stored(both)
    return labels.select("id", F.col("label").alias("component"))
