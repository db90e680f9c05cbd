"""Readers for the parquet tables a job starts from (SRC-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Plain parquet scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(table_path(sf_dir, name))


def register_parquet_view(spark: SparkSession, path_glob: str, view_name: str) -> DataFrame:
    """SRC-3: expose a parquet glob as a named view so any SQL can run over it."""
    df = spark.read.parquet(path_glob)
    df.createOrReplaceTempView(view_name)
    return df
