"""Forecast grid, weather, features, calibration and scoring of request tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp
from .calendar import scoring_calendar
from .impute import commodity_default_price
from .locations import anti_invalid_combinations, semi_valid_combinations

MAX_HORIZON = 7


def calibrate_prediction(df: DataFrame, raw: str = "raw_prediction") -> DataFrame:
    """Pull a prediction towards the market: current price first, the averages second."""
    p, now = F.col(raw), F.col("current_price")
    ratio = F.when(now > 0, now / p)
    avg = F.coalesce(F.expr("nullif(avg_price_7d, 0.0)"), F.col("avg_price_30d"))
    soft = F.when(avg > 0, avg / p)
    adjusted = (
        F.when(p.isNull() | (p <= 0), p)
        .when(ratio > 1.3, p * (1 + (F.least(ratio, F.lit(2.5)) - 1) * 0.7))
        .when(ratio < 0.7, p * (1 + (F.greatest(ratio, F.lit(0.4)) - 1) * 0.7))
        .when((soft > 1.3) | (soft < 0.7), p * (1 + (clamp(soft, 0.5, 2.0) - 1) * 0.5))
        .otherwise(p)
    )
    return df.withColumn("calibrated", adjusted)


def forecast_grid(requests: DataFrame, horizon: Column | int, cap: int | None = MAX_HORIZON) -> DataFrame:
    """One row per request and day from the target date on."""
    n = F.lit(horizon) if isinstance(horizon, int) else horizon
    n = F.least(n, F.lit(cap)) if cap else n
    steps = F.sequence(F.lit(0), n.cast("int") - 1)
    return requests.filter(n >= 1).select("*", F.explode(steps).alias("step")).withColumn("date", F.date_add("target_date", F.col("step")))


def project_moving_averages(df: DataFrame, model: Callable[[Column, Column], Column], steps: int = MAX_HORIZON, offset: Column | int = 0) -> DataFrame:
    """Blend actual averages with the last prediction along the forecast, at most seven steps.

    Each step needs the prediction of the step before, so the steps fold through one array per row.
    """
    first = F.lit(offset) if isinstance(offset, int) else offset
    shape = "struct<step:int,ma_7:double,ma_30:double,price:double>"

    def step(done: Column, i: Column) -> Column:
        ahead = (first + i).cast("double")
        last = F.element_at(done, -1)["price"]
        fresh = (ahead <= 0) | (i == 0)
        w7, w30 = F.greatest(F.lit(0.3), 1 - ahead * 0.1), F.greatest(F.lit(0.5), 1 - ahead * 0.05)
        ma7 = F.when(fresh, F.col("avg_price_7d")).otherwise(w7 * F.col("avg_price_7d") + (1 - w7) * last)
        ma30 = F.when(fresh, F.col("avg_price_30d")).otherwise(w30 * F.col("avg_price_30d") + (1 - w30) * last)
        entry = F.struct(i.cast("int").alias("step"), ma7.alias("ma_7"), ma30.alias("ma_30"), model(ma7, ma30).alias("price")).cast(shape)
        return F.concat(done, F.array(entry))

    # element_at on the empty start is never read: step 0 is always fresh.
    start = F.array(F.lit(None).cast(shape))
    path = F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), start, step)
    keep = [c for c in df.columns]
    return df.select(*keep, F.inline(F.slice(path, 2, steps)))


def weather_for_forecast(grid: DataFrame, daily: DataFrame, as_of: str) -> DataFrame:
    """Weather by day offset from the as-of day; the latest known day where the offset is out of range, else defaults."""
    day = F.lit(as_of).cast("date")
    known = daily.withColumn("offset", F.datediff("date", day))
    ahead = known.filter("offset > 0").select("state", "district", "offset", F.struct(
        "temperature_2m_max", "temperature_2m_min", "precipitation_sum").alias("w"))
    latest = daily.groupBy("state", "district").agg(F.max_by(F.struct(
        "temperature_2m_max", "temperature_2m_min", "precipitation_sum"), "date").alias("l"))
    out = grid.withColumn("offset", F.datediff("date", day)).join(ahead, ["state", "district", "offset"], "left").join(
        latest, ["state", "district"], "left")
    used = F.coalesce("w", "l")
    return out.withColumn("_u", used).select(
        *grid.columns, F.coalesce("_u.temperature_2m_max", F.lit(25.0)).alias("temperature_2m_max"),
        F.coalesce("_u.temperature_2m_min", F.lit(20.0)).alias("temperature_2m_min"),
        F.coalesce("_u.precipitation_sum", F.lit(0.0)).alias("precipitation_sum"))


def scoring_features(df: DataFrame) -> DataFrame:
    """Scoring row from market columns with the crop's default prices behind them; needs crop, date and market columns."""
    d = commodity_default_price(df)
    now = F.expr("nullif(current_price, 0.0)")
    has = now.isNotNull()
    pick = lambda market, default: F.when(has, F.coalesce(market, default)).otherwise(default)
    low, high = pick(F.col("market_min"), F.col("default_min")), pick(F.col("market_max"), F.col("default_max"))
    week = F.when(has, F.coalesce(F.col("avg_price_7d"), now)).otherwise(F.col("default_avg"))
    month = F.when(has, F.coalesce(F.col("avg_price_30d"), now)).otherwise(F.col("default_avg"))
    spread = F.when(has, F.coalesce(F.col("volatility"), now * 0.1)).otherwise(F.col("default_avg") * 0.1)
    price = F.coalesce(now, F.col("default_avg"))
    change = lambda base: F.when(base > 0, (price - base) / base * 100).otherwise(0.0)
    out = d.withColumns({
        "min_price": low, "max_price": high, "price_ma_7": week, "price_ma_30": month, "price_std_7": spread,
        "price_std_30": spread, "price_volatility": spread, "price_range": high - low,
        "price_range_ratio": F.when(high > 0, (high - low) / high).otherwise(0.0), "seasonal_avg_price": month,
        "price_change": change(week), "price_change_7d": change(week), "price_change_30d": change(month),
        "lat": F.lit(20.0), "lon": F.lit(77.0),
    })
    return scoring_calendar(out)


def score_batch(requests: DataFrame, panel: DataFrame, score: Callable[[DataFrame], DataFrame], model: str) -> DataFrame:
    """Predictions for valid requests, an error text for the others. ``score`` adds ``prediction``."""
    valid = score(semi_valid_combinations(requests, panel))
    good = valid.select(*requests.columns, "prediction", F.lit(model).alias("model"), F.lit(None).cast("string").alias("error"),
                        F.when(F.col("prediction").isNotNull(), "high").otherwise("low").alias("confidence"))
    bad = anti_invalid_combinations(requests, panel).select(
        *requests.columns, F.lit(None).cast("double").alias("prediction"), F.lit(model).alias("model"), "error",
        F.lit(None).cast("string").alias("confidence"))
    return good.unionByName(bad)


def forecast_vs_current(forecast: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Change against the current price per forecast row, with the current price itself as the first row."""
    now = current.select(*keys, "current_price")
    rows = forecast.select(*keys, "date", "price").join(now, keys, "left").select(
        *keys, F.date_format("date", "yyyy-MM-dd").alias("label"), "price", (F.col("price") - F.col("current_price")).alias("change"),
        (F.try_divide(F.col("price") - F.col("current_price"), F.col("current_price")) * 100).alias("change_pct"))
    first = now.select(*keys, F.lit("current").alias("label"), F.col("current_price").alias("price"), F.lit(0.0).alias("change"),
                       F.lit(0.0).alias("change_pct"))
    return first.unionByName(rows)


LEVELS = [("weather_global", []), ("commodity", ["crop"]), ("commodity_location", ["crop", "state", "district"]),
          ("commodity_all", ["crop"]), ("legacy", ["crop", "state", "district"])]


def resolve_model_level(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """First level of the registry that holds a model for the request."""
    out = requests
    for i, (level, keys) in enumerate(LEVELS):
        have = registry.filter(F.col("level") == level)
        if keys:
            out = out.join(have.select(*keys).distinct().withColumn(f"l{i}", F.lit(True)), keys, "left")
        else:
            out = out.withColumn(f"l{i}", have.agg(F.count("*") > 0).scalar())
    chosen = F.coalesce(*[F.when(F.col(f"l{i}"), F.lit(level)) for i, (level, _) in enumerate(LEVELS)])
    return out.select(*requests.columns, chosen.alias("model_level"))


def forecast_quality_checks(forecast: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """Per request: has rows, all prices positive, all dates valid."""
    per = forecast.groupBy(*keys).agg(
        F.count("*").alias("n"), F.bool_and(F.coalesce(F.col("price") > 0, F.lit(False))).alias("positive"),
        F.bool_and(F.col("date").isNotNull()).alias("dated"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return requests.select(*keys).distinct().join(per, keys, "left").select(
        *keys, flag(F.col("n") > 0).alias("has_predictions"), flag(F.col("positive")).alias("prices_positive"),
        flag(F.col("dated")).alias("dates_valid"), flag((F.col("n") > 0) & F.col("positive") & F.col("dated")).alias("all_passed"))
