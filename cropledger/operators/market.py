"""Market state per series, grain fallback and source priority (K1-K4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import TICK, name_key, ticks
from ..plans.series import first_per_group
from ..session import materialize
from ..sources.views import ORDER
from .clean import filter_previous_week

GRAINS = [("location_specific", ["crop", "state", "district"]), ("state_level", ["crop", "state"]), ("commodity_level", ["crop"])]
MARKET = ["current_price", "market_min", "market_max", "avg_price_7d", "avg_price_30d", "price_trend", "volatility",
          "recent_prices", "records_count"]


def _mean(price: Column) -> Column:
    return F.avg(ticks(price)) / TICK


def market_conditions(df: DataFrame, keys: Sequence[str] = ("crop", "state", "district"), order: Sequence[str] = ORDER, rows: int = 30) -> DataFrame:
    """Current price, bounds, short and long mean, trend and volatility from the latest ``rows`` rows per key.

    Only the latest rows of each key leave the map tasks, so the lists below hold at most ``rows`` entries.
    """
    recent = first_per_group(df, keys, [F.desc(c) for c in order], rows).filter("price IS NOT NULL")
    at_first = F.min("rn")
    newest, oldest = F.min_by("price", "rn"), F.max_by("price", "rn")
    week = F.when(F.col("rn") <= 7, F.col("price"))
    entry = F.struct("rn", "date", "price")
    return recent.groupBy(*keys).agg(
        newest.alias("current_price"), F.min_by("min_price", "rn").alias("market_min"), F.min_by("max_price", "rn").alias("market_max"),
        _mean(week).alias("avg_price_7d"), _mean(F.col("price")).alias("avg_price_30d"),
        F.when(newest > oldest, "increasing").when(newest < oldest, "decreasing").otherwise("stable").alias("price_trend"),
        F.coalesce(F.stddev_samp("price"), F.lit(0.0)).alias("volatility"),
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["date"].alias("date"), e["price"].alias("price"))).alias("recent_prices"),
        F.count("*").alias("records_count"), at_first.alias("_first"),
    ).drop("_first")


def with_keys(df: DataFrame) -> DataFrame:
    """Match names without case and outer blanks."""
    return df.withColumns({c: name_key(c) for c in ("crop", "state", "district")})


def primary_keys(df: DataFrame, keys: Sequence[str], primary: str = "enam") -> DataFrame:
    return df.groupBy(*keys).agg(F.bool_or(F.col("data_source") == primary).alias("has_primary"))


def source_priority(df: DataFrame, primary: str = "enam") -> DataFrame:
    """Per series: label of the primary source when it has rows, else the grain; sources are always unioned."""
    keys = GRAINS[0][1]
    return df.groupBy(*keys).agg(
        F.bool_or(F.col("data_source") == primary).alias("p"), F.count("*").alias("records"),
        F.count_distinct("data_source").alias("sources"),
    ).select(*keys, "records", "sources", F.when(F.col("p"), f"{primary}_primary").otherwise(GRAINS[0][0]).alias("data_source"))


def _by_grain(requests: DataFrame, grains: dict[str, DataFrame]) -> DataFrame:
    """First grain with an answer per request."""
    asked = requests
    for c in ("crop", "state", "district"):
        asked = asked.withColumn(f"{c}_key", name_key(c))
    out = asked
    for i, (label, keys) in enumerate(GRAINS):
        g = grains[label].select(*[F.col(k).alias(f"{k}_key") for k in keys], F.struct(*[c for c in grains[label].columns if c not in keys]).alias(f"g{i}"))
        out = out.join(g, [f"{k}_key" for k in keys], "left")
    hit = F.coalesce("g0", "g1", "g2")
    grain = F.when(F.col("g0").isNotNull(), GRAINS[0][0]).when(F.col("g1").isNotNull(), GRAINS[1][0]).when(F.col("g2").isNotNull(), GRAINS[2][0])
    return out.select(*requests.columns, hit.alias("m"), grain.alias("grain"))


def latest_by_series(df: DataFrame, order: Sequence[str], rows: int, primary: str = "enam") -> DataFrame:
    """The latest rows of each series, of the primary source and of the others, from one pass over the facts, written once.

    The latest rows of a state or crop are among those of its series, and whether it has primary rows shows in them too.
    """
    own = df.withColumn("_primary", F.coalesce(F.col("data_source") == primary, F.lit(False)))
    latest = first_per_group(own, [*GRAINS[0][1], "_primary"], [F.desc(c) for c in order], rows)
    return materialize(latest.drop("rn", "_primary"), "latest")


def market_conditions_fallback(requests: DataFrame, df: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Market state per request at the finest grain with rows; the commodity grain has no trend."""
    panel = latest_by_series(with_keys(df), order, 30)
    grains = {}
    for label, keys in GRAINS:
        g = market_conditions(panel, keys, order).join(primary_keys(panel, keys), keys)
        grains[label] = g.withColumn("price_trend", F.lit("stable")) if label == "commodity_level" else g
    out = _by_grain(requests, grains)
    label = F.when(F.col("m.has_primary"), "enam_primary").otherwise(F.col("grain"))
    return out.select(*requests.columns, *[F.col(f"m.{c}").alias(c) for c in MARKET], "grain", label.alias("data_source"),
                      F.lit(False).alias("is_fallback"))


def previous_week_conditions(requests: DataFrame, df: DataFrame, as_of: str, order: Sequence[str] = ORDER) -> DataFrame:
    """Market state of the week before last at the finest grain with rows; both means are the week's."""
    panel = latest_by_series(with_keys(filter_previous_week(df, as_of)), order, 7)
    grains = {label: market_conditions(panel, keys, order, 7).withColumn("avg_price_30d", F.col("avg_price_7d")) for label, keys in GRAINS}
    day = F.lit(as_of).cast("date")
    span = F.concat_ws(" to ", F.date_sub(day, 14), F.date_sub(day, 7))
    return _by_grain(requests, grains).filter("m IS NOT NULL").select(
        *requests.columns, *[F.col(f"m.{c}").alias(c) for c in MARKET], "grain", F.lit("previous_week_fallback").alias("data_source"),
        F.lit(True).alias("is_fallback"), span.alias("fallback_date_range"))
