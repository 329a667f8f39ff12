"""Parquet tables by name: `<dir>/<name>.parquet`, a file or a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jdbc_table(spark: SparkSession, url: str, name: str, column: str | None = None, bounds: tuple | None = None, partitions: int = 1, **options: str) -> DataFrame:
    """A database table through JDBC, read in parallel by ranges of a numeric column; the database's driver must be on the class path."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return reader.load()
