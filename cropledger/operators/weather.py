"""Weather plan, join, coverage and gap filling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .impute import default_weather_calendar
from .series_features import PLACE, fill_weather_gaps

WEATHER = ["temperature_2m_max", "temperature_2m_min", "precipitation_sum"]


def location_extent(df: DataFrame) -> DataFrame:
    return df.groupBy(*PLACE).agg(
        F.count("*").alias("rows"), F.min("date").alias("min_date"), F.max("date").alias("max_date"))


def weather_fetch_plan(df: DataFrame, days: int = 90) -> DataFrame:
    """Chunks of ``days`` days that cover each place's date extent."""
    starts = F.sequence("min_date", "max_date", F.expr(f"interval {days} days"))
    return location_extent(df).select(*PLACE, "max_date", F.explode(starts).alias("chunk_start")).select(
        *PLACE, "chunk_start", F.least(F.date_add("chunk_start", days - 1), F.col("max_date")).alias("chunk_end"))


def weather(panel: DataFrame) -> DataFrame:
    """Daily weather per place: seasonal defaults varied by day, with missing days and missing values."""
    doy, dom = F.dayofyear("date"), F.dayofmonth("date")
    return (
        default_weather_calendar(weather_fetch_plan(panel))
        .filter(doy % 17 != 0)
        .withColumns({
            "temperature_2m_max": F.when(doy % 11 != 0, F.col("temperature_2m_max") + dom % 7),
            "temperature_2m_min": F.when(doy % 11 != 0, F.col("temperature_2m_min") + dom % 5),
            "precipitation_sum": F.when(doy % 13 != 0, F.col("precipitation_sum") + dom % 3),
        })
    )


def mean_temperature(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "temperature": (F.col("temperature_2m_max") + F.col("temperature_2m_min")) / 2,
        "rainfall": F.col("precipitation_sum"),
    })


def join_weather(panel: DataFrame, daily: DataFrame) -> DataFrame:
    """Left join by place and day. AQE broadcasts the daily table while it is small, else merges and splits skew."""
    return mean_temperature(panel.join(daily, [*PLACE, "date"], "left"))


def weather_coverage(joined: DataFrame) -> DataFrame:
    every = F.col(WEATHER[0]).isNotNull() & F.col(WEATHER[1]).isNotNull() & F.col(WEATHER[2]).isNotNull()
    some = F.coalesce(*WEATHER).isNotNull()
    return joined.agg(
        F.count("*").alias("total"), F.count_if(every).alias("rows_all"), F.count_if(some).alias("rows_any"),
    ).select("total", "rows_all", "rows_any", F.round(F.col("rows_all") * 100 / F.col("total"), 2).alias("pct_all"),
             F.round(F.col("rows_any") * 100 / F.col("total"), 2).alias("pct_any"))


def panel_weather_filled(panel: DataFrame, daily: DataFrame) -> DataFrame:
    """Weather joined and gaps filled on one row per place and day, then attached to the panel rows.

    All rows of a day share its weather, so filling the days equals filling the rows, and a place's
    window holds its days instead of its observations.
    """
    days = panel.select(*PLACE, "date").distinct().join(daily, [*PLACE, "date"], "left")
    return mean_temperature(panel.join(fill_weather_gaps(days), [*PLACE, "date"]))
