"""Parquet tables of a dataset folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the folder `sf_dir`; any path that Spark can open will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
