"""Calendar features of a date column (T1-T7): plain columns, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flag(c: Column) -> Column:
    return c.cast("int")


def calendar_parts(df: DataFrame, date: str = "date") -> DataFrame:
    d = F.col(date)
    return df.withColumns({
        "year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d), "day_of_week": F.weekday(d),
        "day_of_year": F.dayofyear(d), "week_of_year": F.weekofyear(d), "quarter": F.quarter(d),
    })


def cyclical_encoding(df: DataFrame) -> DataFrame:
    turn = 2 * F.pi()
    return df.withColumns({
        f"{name}_{fn}": wave(turn * F.col(col) / n)
        for name, col, n in (("month", "month", 12), ("day", "day_of_year", 365), ("weekday", "day_of_week", 7))
        for fn, wave in (("sin", F.sin), ("cos", F.cos))
    })


def season_flags(df: DataFrame) -> DataFrame:
    m = F.col("month")
    return df.withColumns({
        "is_spring": flag(m.between(3, 5)), "is_summer": flag(m.between(6, 8)),
        "is_monsoon": flag(m.between(6, 9)), "is_winter": flag(m.isin(12, 1, 2)),
        "is_harvest": flag(m.isin(10, 11, 12, 1, 2)),
    })


def crop_season_flags(df: DataFrame) -> DataFrame:
    m = F.col("month")
    return df.withColumns({
        "is_kharif": flag(m.between(6, 10)), "is_rabi": flag(m.isin(11, 12, 1, 2, 3)),
        "is_zaid": flag(m.between(4, 5)),
    })


def weekend_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("is_weekend", flag(F.col("day_of_week") >= 5))


def all_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    return weekend_flag(crop_season_flags(season_flags(cyclical_encoding(calendar_parts(df, date)))))


def basic_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumns({"weekday": F.weekday(date), "month": F.month(date)})


def scoring_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    return season_flags(calendar_parts(df, date)).drop("day", "day_of_week", "is_harvest")
