"""Text up to a delimiter, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def delimited(spark: SparkSession, path: str, delimiter: str = "\n") -> DataFrame:
    """A column `value`: the text up to each delimiter (one or more characters), which isn't part of it. Files are split between tasks."""
    return spark.read.option("lineSep", delimiter).text(path)


def write_delimited(rows: DataFrame, path: str, delimiter: str = "\n") -> None:
    """Writes the one string column of rows, each value followed by the delimiter. Values mustn't hold it."""
    rows.write.option("lineSep", delimiter).text(path)
