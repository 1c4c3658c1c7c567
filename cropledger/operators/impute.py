"""Imputation and defaults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.columns import name_key, one_row
from ..functions.fixed_values import CROP_DEFAULT_PRICES, FALLBACK_PRICES
from ..functions.quantiles import column_quantile


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in skip]


def impute_by_name_rule(df: DataFrame, target: str = "price", skip: Sequence[str] = ()) -> DataFrame:
    """NULLs of numeric columns: the median where the name contains ``price``, else the mean."""
    cols = numeric_columns(df, (target, *skip))
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    gaps = [c for c in cols if counts[c]]
    fill = column_quantile(df, [c for c in gaps if "price" in c.lower()], 0.5)
    mean_cols = [c for c in gaps if "price" not in c.lower()]
    if mean_cols:
        means = df.agg(F.struct(*[F.avg(c).alias(c) for c in mean_cols])).scalar()
        fill |= {c: means[c] for c in mean_cols}
    return df.withColumns({c: F.coalesce(F.col(c), fill[c]) for c in gaps})


def fill_weather_defaults(df: DataFrame) -> DataFrame:
    mean = df.agg(F.avg("temperature")).scalar()
    return df.withColumns({"temperature": F.coalesce("temperature", mean), "rainfall": F.coalesce("rainfall", F.lit(0.0))})


def impute_train_means(df: DataFrame, columns: Sequence[str], split: str = "split") -> DataFrame:
    """Fill every split with the means of the train rows."""
    if not columns:
        return df
    means = one_row(df.agg(*[F.avg(F.when(F.col(split) == "train", F.col(c))).alias(c) for c in columns]))
    return df.withColumns({c: F.coalesce(F.col(c), means[c]) for c in columns})


def season_weather(start: Column) -> Column:
    """Default (max, min, rain) by the month of ``start``."""

    def day(hi: float, lo: float, rain: float) -> Column:
        return F.struct(F.lit(hi).alias("hi"), F.lit(lo).alias("lo"), F.lit(rain).alias("rain"))

    m = F.month(start)
    return (
        F.when(start.isNull(), day(30.0, 20.0, 0.0))
        .when(m.isin(12, 1, 2), day(28.0, 15.0, 0.0))
        .when(m.between(3, 5), day(38.0, 25.0, 0.0))
        .when(m.between(6, 9), day(32.0, 24.0, 5.0))
        .otherwise(day(30.0, 20.0, 2.0))
    )


def default_weather_calendar(chunks: DataFrame, start: str = "chunk_start", end: str = "chunk_end") -> DataFrame:
    """One row per day of each chunk; the season of the chunk's first month counts for all its days.

    A chunk without a valid range gives a single undated row.
    """
    keys = [c for c in chunks.columns if c not in (start, end)]
    valid = F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end))
    days = F.when(valid, F.sequence(F.col(start), F.col(end))).otherwise(F.array(F.lit(None).cast("date")))
    first = F.when(valid, F.col(start))
    return chunks.select(*keys, season_weather(first).alias("w"), F.explode(days).alias("date")).select(
        *keys, "date", F.col("w.hi").alias("temperature_2m_max"), F.col("w.lo").alias("temperature_2m_min"),
        F.col("w.rain").alias("precipitation_sum"))


def default_price_table(spark: SparkSession) -> DataFrame:
    rows = [(c, lo, hi, avg, i) for i, (c, lo, hi, avg) in enumerate(CROP_DEFAULT_PRICES)]
    return spark.createDataFrame(rows, "crop string, min_price double, max_price double, avg_price double, ord int")


def commodity_default_price(names: DataFrame, crop: str = "crop") -> DataFrame:
    """Default (min, max, avg) price per crop name.

    Exact, then case-blind, then partial either way, in the order of the fixed list (26 entries held
    as one literal), else the general fallback.
    """
    entries = F.array(*[
        F.struct(F.lit(c).alias("k"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(avg).alias("avg"))
        for c, lo, hi, avg in CROP_DEFAULT_PRICES
    ])
    c, low = F.col(crop), F.lower(crop)

    def firsts(test):
        return F.get(F.filter(entries, test), F.lit(0))

    exact = firsts(lambda e: e["k"] == c)
    blind = firsts(lambda e: F.lower(e["k"]) == low)
    part = firsts(lambda e: F.contains(F.lower(e["k"]), low) | F.contains(low, F.lower(e["k"])))
    fallback = F.struct(F.lit("").alias("k"), *[F.lit(x).alias(a) for x, a in zip(FALLBACK_PRICES, ("lo", "hi", "avg"))])
    tier = F.when(exact.isNotNull(), 1).when(blind.isNotNull(), 2).when(part.isNotNull(), 3).otherwise(4)
    return names.withColumn("_e", F.coalesce(exact, blind, part, fallback)).withColumns({
        "default_min": F.col("_e.lo"), "default_max": F.col("_e.hi"), "default_avg": F.col("_e.avg"),
        "default_tier": tier,
    }).drop("_e")


def default_missing_features(df: DataFrame, features: Sequence[str], crop_mean: DataFrame) -> DataFrame:
    """Add the model inputs ``df`` lacks: crop mean price (2000 if unknown) for price-like names, else 0."""
    out = df.join(crop_mean.select("crop", F.col("mean_price").alias("_mean")), "crop", "left")
    base = F.coalesce("_mean", F.lit(2000.0))
    return out.withColumns({
        f: base if "price" in f.lower() else F.lit(0.0) for f in features if f not in df.columns
    }).drop("_mean")


def market_default(feature: str) -> Column:
    """Default of one missing model input from market columns, then crop defaults."""
    f = feature.lower()
    if "temperature" in f:
        return F.lit(25.0)
    if "precipitation" in f or "rain" in f:
        return F.lit(0.0)
    if "price" in f and "change" in f:
        return F.lit(0.0)
    if "price" in f and "ma" in f:
        return F.coalesce("avg_price_7d", "default_avg")
    if "price" in f and ("std" in f or "volatility" in f):
        return F.coalesce(F.expr("nullif(volatility, 0.0)"), F.col("default_avg") * 0.1)
    if "seasonal" in f:
        return F.coalesce("avg_price_30d", "default_avg")
    if "lat" in f or "lon" in f:
        return F.lit(20.0 if "lat" in f else 77.0)
    if "min_price" in f:
        return F.coalesce("market_min", "default_min")
    if "max_price" in f:
        return F.coalesce("market_max", "default_max")
    return F.lit(0.0)


def default_features_by_market(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({f: market_default(f) for f in features if f not in df.columns})
