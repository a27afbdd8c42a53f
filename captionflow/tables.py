"""Access to the input tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from captionflow.session import ship_package


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
