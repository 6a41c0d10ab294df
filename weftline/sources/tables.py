"""Parquet tables in a folder. Filters and columns asked of them reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.sources.storage import Storage


def read_table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_tables(spark: SparkSession, folder: str, names: list[str], into: Storage) -> None:
    """Registers tables by name."""
    for name in names:
        into.set(name, read_table(spark, folder, name))


def write_table(df: DataFrame, path: str, *, mode: str = "error", partition_by: list[str] | None = None) -> None:
    df.write.mode(mode).parquet(path, partitionBy=partition_by)
