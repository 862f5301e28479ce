"""Metadata files, caches and archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellforge.operators.metadata import metadata_tables


def write_metadata(rows: DataFrame, path: str) -> None:
    """The three metadata tables as tab-separated text with headings."""
    for kind, df in metadata_tables(rows).items():
        df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{path}/{kind}")


def write_cache(df: DataFrame, path: str, codec: str = "zstd") -> None:
    """A mesh, grid or cloud table as compressed Parquet: the binary cache and the zipped archive in one."""
    df.write.mode("overwrite").option("compression", codec).parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
