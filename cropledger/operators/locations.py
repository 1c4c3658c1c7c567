"""Catalogue queries and request validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import name_key
from .clean import filter_unknown

KEYS = ["state", "district", "crop"]


def list_states(df: DataFrame) -> DataFrame:
    return filter_unknown(df.select("state").distinct(), ["state"]).orderBy("state")


def list_districts(df: DataFrame) -> DataFrame:
    return filter_unknown(df.select("state", "district").distinct(), ["state", "district"]).orderBy("state", "district")


def list_crops(df: DataFrame) -> DataFrame:
    """Sorted crops per place. Distinct first, so a place's list is built from its few crop names."""
    series = filter_unknown(df.select(*KEYS).distinct(), KEYS)
    return series.groupBy("state", "district").agg(F.array_sort(F.collect_set("crop")).alias("crops"))


def location_info(places: DataFrame, df: DataFrame) -> DataFrame:
    return places.join(list_crops(df), ["state", "district"], "left").select(
        "state", "district", F.coalesce(F.array_size("crops"), F.lit(0)).alias("crop_count"), "crops",
        F.col("crops").isNotNull().cast("int").alias("has_data"))


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{c}_key": name_key(c) for c in KEYS})


def _known(panel: DataFrame) -> DataFrame:
    return panel.select(*[name_key(c).alias(f"{c}_key") for c in KEYS]).distinct()


def semi_valid_combinations(requests: DataFrame, panel: DataFrame) -> DataFrame:
    on = [f"{c}_key" for c in KEYS]
    return _keyed(requests).join(_known(panel), on, "left_semi").drop(*on)


def anti_invalid_combinations(requests: DataFrame, panel: DataFrame) -> DataFrame:
    on = [f"{c}_key" for c in KEYS]
    message = F.format_string("No data for %s in %s, %s", "crop", "district", "state")
    return _keyed(requests).join(_known(panel), on, "left_anti").drop(*on).withColumn("error", message)


def dates_between(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(start, end))


def cross_location_dates(panel: DataFrame, crop: str, start: str, end: str) -> DataFrame:
    """Places of a crop for each day of a range, as an explode of the day sequence."""
    places = panel.filter(name_key("crop") == name_key(F.lit(crop))).select(*KEYS).distinct()
    return places.select(*KEYS, dates_between(F.lit(start).cast("date"), F.lit(end).cast("date")).alias("date"))


def cross_crop_dates(panel: DataFrame, state: str, district: str, start: str, end: str, crops: list[str] | None = None) -> DataFrame:
    """Crops of a place for each day; with a list, those of it that are available."""
    found = panel.filter((F.col("state") == state) & (F.col("district") == district)).select(*KEYS).distinct()
    if crops is not None:
        found = found.filter(F.col("crop").isin(*crops))
    return found.select(*KEYS, dates_between(F.lit(start).cast("date"), F.lit(end).cast("date")).alias("date"))
