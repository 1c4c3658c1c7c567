"""Landed Parquet tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

SMALL_SPLIT = 4 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a landed table over the cores when it is too small to be read in more than a few splits.

    The decision uses the file size Spark plans with; a table of real size stays as its splits are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, key) if size <= cores * SMALL_SPLIT else df
