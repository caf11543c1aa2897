"""Result tables as CSV: read by a glob of files, written as a folder of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_csv(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """All files of a glob, or of several, as one table of a known schema; a header in each names the columns.

    Rows that don't fit the schema are an error, not nulls.
    """
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(paths)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).csv(path)
