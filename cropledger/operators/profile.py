"""Profiling and aggregation (A1-A25). Every aggregate combines on the map side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import contains_ci
from ..functions.quantiles import quantiles
from .weather import location_extent as location_extent  # noqa: F401


def combinations(*columns: str) -> Column:
    return F.count_distinct(F.struct(*columns))


def dataset_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("total_records"), F.min("date").alias("min_date"), F.max("date").alias("max_date"),
        F.datediff(F.max("date"), F.min("date")).cast("bigint").alias("span_days"),
        F.count_distinct("state").alias("states"), F.count_distinct("district").alias("districts"),
        F.count_distinct("crop").alias("crops"),
    )


def missing_profile(df: DataFrame) -> DataFrame:
    """Columns with NULLs, their count and percentage, most first: one pass over the data."""
    one = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing_count")) for c in df.columns])
    return (
        one.select("n", F.inline(entries)).filter("missing_count > 0")
        .select("column_name", "missing_count", F.round(F.col("missing_count") * 100 / F.col("n"), 2).alias("missing_pct"))
        .orderBy(F.desc("missing_count"), "column_name")
    )


def price_describe(df: DataFrame, price: str = "price") -> DataFrame:
    q = quantiles(df, [], price, [0.25, 0.5, 0.75]).select("q").scalar()
    return df.agg(
        F.count(price).alias("count"), F.avg(price).alias("mean"), F.stddev_samp(price).alias("std"), F.min(price).alias("min"),
        F.max(price).alias("max"),
    ).select("count", "mean", "std", "min", q[0].alias("p25"), q[1].alias("p50"), q[2].alias("p75"), "max")


def outliers_iqr(df: DataFrame, price: str = "price", fence: float = 1.5) -> DataFrame:
    q = quantiles(df, [], price, [0.25, 0.75]).select("q").scalar()
    width = (q[1] - q[0]) * fence
    return df.select(F.col(price), (q[0] - width).alias("lower_bound"), (q[1] + width).alias("upper_bound")).groupBy(
        "lower_bound", "upper_bound"
    ).agg(
        F.count_if((F.col(price) < F.col("lower_bound")) | (F.col(price) > F.col("upper_bound"))).alias("outliers"),
        F.count(price).alias("n"),
    ).select("lower_bound", "upper_bound", "outliers", F.round(F.col("outliers") * 100 / F.col("n"), 2).alias("outlier_pct"))


def count_by(df: DataFrame, name: str, key: Column | str, n: int | None = None) -> DataFrame:
    """Rows per key; with ``n`` the most frequent keys, ties by name."""
    key = F.col(key) if isinstance(key, str) else key
    out = df.groupBy(key.alias(name)).agg(F.count("*").alias("records"))
    return out.orderBy(name) if n is None else out.orderBy(F.desc("records"), name).limit(n)


def records_by_year(df: DataFrame) -> DataFrame:
    return count_by(df, "year", F.year("date"))


def records_by_month(df: DataFrame) -> DataFrame:
    return count_by(df, "month", F.month("date"))


def top_states(df: DataFrame, n: int = 10) -> DataFrame:
    return count_by(df, "state", "state", n)


def top_districts(df: DataFrame, n: int = 10) -> DataFrame:
    return count_by(df, "district", "district", n)


def top_crops(df: DataFrame, n: int = 20) -> DataFrame:
    return count_by(df, "crop", "crop", n)


def price_by_top_crops(df: DataFrame, n: int = 10) -> DataFrame:
    kept = df.join(top_crops(df, n).select("crop"), "crop", "left_semi")
    med = quantiles(kept, ["crop"], "price", [0.5]).select("crop", F.col("q")[0].alias("median_price"))
    return kept.groupBy("crop").agg(
        F.avg("price").alias("mean_price"), F.stddev_samp("price").alias("std_price"), F.count("*").alias("records"),
    ).join(med, "crop").select("crop", "mean_price", "median_price", "std_price", "records")


def mean_price_by(df: DataFrame, name: str, key: Column | str) -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    return df.groupBy(key.alias(name)).agg(F.avg("price").alias("mean_price"))


def seasonal_month_price(df: DataFrame) -> DataFrame:
    return mean_price_by(df, "month", F.month("date"))


def weekday_price(df: DataFrame) -> DataFrame:
    return mean_price_by(df, "weekday", F.weekday("date"))


def state_price_rank(df: DataFrame, n: int = 10) -> DataFrame:
    return mean_price_by(df, "state", "state").orderBy(F.desc("mean_price"), "state").limit(n)


def price_histogram(df: DataFrame, bins: int = 100, price: str = "price") -> DataFrame:
    """Equal-width bins from min to max; the last bin is closed. Bins without rows count 0."""
    ends = df.agg(F.struct(F.min(price).alias("lo"), F.max(price).alias("hi"))).scalar()
    # A single price gets half a unit on either side.
    half = F.when(ends["lo"] == ends["hi"], 0.5).otherwise(0.0)
    lo, hi = ends["lo"] - half, ends["hi"] + half
    width = (hi - lo) / bins
    spot = F.least(F.floor((F.col(price) - lo) / width), F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col(price).isNotNull()).groupBy(spot.alias("bin")).agg(F.count("*").alias("records"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin", (lo + F.col("bin") * width).alias("lower"), (lo + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("records", F.lit(0)).alias("records"))


def monthly_price_trend(df: DataFrame) -> DataFrame:
    return df.groupBy(F.trunc("date", "month").alias("month_start")).agg(
        F.avg("price").alias("mean_price")).select(F.year("month_start").alias("year"), F.month("month_start").alias("month"),
                                                   "month_start", "mean_price")


def top_counts_chart_data(df: DataFrame, n: int = 15) -> DataFrame:
    crops = top_crops(df, n).select(F.lit("crop").alias("kind"), F.col("crop").alias("name"), "records")
    states = top_states(df, n).select(F.lit("state").alias("kind"), F.col("state").alias("name"), "records")
    return crops.unionByName(states)


def coverage_overview(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("records"), F.count_distinct("state").alias("states"), F.count_distinct("district").alias("districts"),
        F.count_distinct("crop").alias("crops"), combinations("state", "district").alias("locations"),
        combinations("state", "district", "crop").alias("series"))


def expected_vs_observed(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every expected key with a flag whether it was observed."""
    seen = observed.select(*keys).distinct().withColumn("seen", F.lit(1))
    return expected.select(*keys).distinct().join(seen, list(keys), "left").select(
        *keys, F.coalesce("seen", F.lit(0)).alias("observed"))


def state_coverage(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Expected and observed states, the missing ones by name, percent covered."""
    return expected_vs_observed(expected, observed, ["state"]).agg(
        F.count("*").alias("expected"), F.sum("observed").alias("covered"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("observed") == 0, F.col("state")))), ", ").alias("missing"),
    ).select("expected", "covered", "missing", F.round(F.try_divide(F.col("covered") * 100, F.col("expected")), 2).alias("coverage_pct"))


def district_coverage(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Per observed or expected state: districts expected, of those observed, percent (0 if none expected)."""
    hits = expected_vs_observed(expected, observed, ["state", "district"]).groupBy("state").agg(
        F.count("*").alias("expected"), F.sum("observed").alias("covered"))
    states = observed.select("state").union(expected.select("state")).distinct()
    return states.join(hits, "state", "left").na.fill(0, ["expected", "covered"]).withColumn(
        "coverage_pct", F.when(F.col("expected") > 0, F.round(F.col("covered") * 100 / F.col("expected"), 2)).otherwise(0.0))


def crops_per_state(df: DataFrame) -> DataFrame:
    """Distinct crops per state next to the mean, least and most over states."""
    per = df.groupBy("state").agg(F.count_distinct("crop").alias("crops"))
    over = per.agg(F.struct(F.avg("crops").alias("m"), F.min("crops").alias("lo"), F.max("crops").alias("hi"))).scalar()
    return per.select("state", "crops", over["m"].alias("mean_crops"), over["lo"].alias("min_crops"), over["hi"].alias("max_crops")) \
        .orderBy(F.desc("crops"), "state")


def state_detail(df: DataFrame) -> DataFrame:
    return df.groupBy("state").agg(
        F.count_distinct("district").alias("districts"), F.count_distinct("crop").alias("crops"),
        combinations("district", "crop").alias("combinations"))


def commodity_price_stats(df: DataFrame, crop: str) -> DataFrame:
    return df.filter(contains_ci(F.col("crop"), crop)).agg(
        F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.avg("price").alias("avg_price"),
        F.stddev_samp("price").alias("std_price"))


def source_contribution(df: DataFrame) -> DataFrame:
    return df.rollup("data_source").agg(F.count("*").alias("records")).select(
        F.coalesce("data_source", F.lit("combined")).alias("data_source"), "records")
