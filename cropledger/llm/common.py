"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropledger.session import release  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string")


def schema_of(df: DataFrame, keep: list[str], more: str) -> T.StructType:
    """The kept columns of a frame as they are, and further columns given as DDL."""
    return T.StructType([df.schema[c] for c in keep] + T.StructType.fromDDL(more).fields)
