"""Filters, de-duplication, order and union."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import contains_ci, finite, is_placeholder, name_key
from ..plans.series import first_per_group
from .standardize import project_panel, rename_common

ESSENTIAL = ["state", "district", "crop", "price", "date"]
SERIES_DAY = ["state", "district", "crop", "date"]
OBSERVATION = ["state", "district", "date", "crop", "price"]


def drop_missing_essentials(df: DataFrame, columns: Sequence[str] = ESSENTIAL) -> DataFrame:
    return df.na.drop(subset=list(columns))


def filter_valid_price(df: DataFrame, price: str = "price") -> DataFrame:
    return df.filter(F.col(price) > 0)


def filter_unknown(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        df = df.filter(~is_placeholder(c))
    return df


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key by ingest order. Each map task keeps one row per key before the shuffle."""
    return first_per_group(df, keys, order).drop("rn")


def dedupe_series_day(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return dedupe_first(df, SERIES_DAY, order)


def dedupe_observation(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return dedupe_first(df, OBSERVATION, order)


def dedupe_full_row(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def dedupe_audit(df: DataFrame, stages: dict[str, Sequence[str]]) -> DataFrame:
    """Rows before, after and removed per stage."""
    audits = []
    for stage, keys in stages.items():
        # Counting groups of pre-grouped keys spreads a hot key over all map tasks.
        sizes = df.groupBy(*keys).agg(F.count("*").alias("n"))
        audits.append(sizes.agg(F.sum("n").alias("rows_before"), F.count("*").alias("rows_after"))
                      .select(F.lit(stage).alias("stage"), "rows_before", "rows_after",
                              (F.col("rows_before") - F.col("rows_after")).alias("removed")))
    out = audits[0]
    for a in audits[1:]:
        out = out.unionByName(a)
    return out


def with_match_keys(df: DataFrame, columns: Sequence[str] = ("crop", "state", "district")) -> DataFrame:
    return df.withColumns({f"{c}_key": name_key(c) for c in columns})


def match_key_ci(df: DataFrame, **wanted: str) -> DataFrame:
    for c, value in wanted.items():
        df = df.filter(name_key(c) == name_key(F.lit(value)))
    return df


def match_contains_ci(df: DataFrame, **wanted: str) -> DataFrame:
    for c, value in wanted.items():
        df = df.filter(contains_ci(F.col(c), value))
    return df


def filter_previous_week(df: DataFrame, as_of: str) -> DataFrame:
    day = F.lit(as_of).cast("date")
    return df.filter(F.col("date").between(F.date_sub(day, 14), F.date_sub(day, 7)))


def sanitize_nonfinite(df: DataFrame, columns: Sequence[str], default: float | None = None) -> DataFrame:
    """NaN and infinities to NULL, then to the default or to the column's mean of finite values (else 0)."""
    clean = df.withColumns({c: finite(F.col(c)) for c in columns})
    if default is not None:
        return clean.na.fill(default, list(columns))
    means = clean.agg(F.struct(*[F.avg(c).alias(c) for c in columns])).scalar()
    return clean.withColumns({c: F.coalesce(F.col(c), means[c], F.lit(0.0)) for c in columns})


def sort_panel(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    return df.orderBy(*order)


def limit_rows(df: DataFrame, n: int, order: Sequence[Column | str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def merge_sources(frames: Sequence[DataFrame], order: Sequence[str]) -> DataFrame:
    """Rename, union, one row per observation, panel columns."""
    merged = union_sources([rename_common(f) for f in frames])
    return project_panel(dedupe_observation(merged, order))
