"""Files as they arrive: Structured Streaming over a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.documents import frames

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, glob: str = "*.pdf", files_per_trigger: int = 1000) -> DataFrame:
    """A stream of doc_id, content, arrived: new files of a folder, each once."""
    r = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger)
    return r.load(path).select(F.col("path").alias("doc_id"), "content", F.col("modificationTime").alias("arrived"))


def objects_arriving(spark: SparkSession, path: str, out: str, checkpoint: str, **options):
    """Starts a query that writes the objects of new files as Parquet, each file exactly once; values as JSON text."""
    objs = frames.objects(arriving(spark, path, **options)).withColumn("value", F.to_json("value"))
    return objs.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
