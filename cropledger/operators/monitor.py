"""Prediction monitoring over the log table (R1-R6). The same columns serve batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def log_predictions(log: DataFrame) -> DataFrame:
    """Errors of rows with both prices; percent is 0 where the actual price is not positive."""
    err = F.abs(F.col("predicted") - F.col("actual"))
    return log.withColumns({
        "absolute_error": err,
        "percentage_error": F.when(err.isNull(), None).when(F.col("actual") > 0, err / F.col("actual") * 100).otherwise(0.0),
    })


def usage_stats() -> dict[str, Column]:
    """Totals, error rate, mean error and rows with an actual price."""
    return {
        "total_predictions": F.count("*"), "error_rate": F.count("error") * 100 / F.count("*"),
        "average_error": F.avg("absolute_error"), "predictions_with_actual": F.count("absolute_error"),
    }


def monitor_window_stats(logged: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    now = F.lit(as_of).cast("timestamp")
    recent = logged.filter((F.col("ts") >= now - F.expr(f"interval {days} days")) & (F.col("ts") <= now))
    stats = usage_stats() | {"error_rate": F.coalesce(F.try_divide(F.count("error") * 100, F.count("*")), F.lit(0.0))}
    return recent.agg(*[c.alias(n) for n, c in stats.items()])


def monitor_usage(logged: DataFrame) -> DataFrame:
    """Lifetime uses per model and occurrences per error text."""
    per = lambda kind, c: logged.filter(F.col(c).isNotNull()).groupBy(F.lit(kind).alias("kind"), F.col(c).alias("name")).agg(
        F.count("*").alias("uses"))
    return per("model", "model").unionByName(per("error", "error"))


def model_performance(logged: DataFrame) -> DataFrame:
    """Error metrics per model and for all models together."""
    e = F.col("absolute_error")
    return logged.filter(e.isNotNull()).rollup("model").agg(
        F.count("*").alias("total_predictions"), F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg("percentage_error").alias("mape"), F.max(e).alias("max_error"), F.min(e).alias("min_error"),
    ).filter("total_predictions > 0").withColumn("model", F.coalesce("model", F.lit("all")))


def daily_report(logged: DataFrame) -> DataFrame:
    """Per day: its stats and the running total. Days are few, so only they are accumulated in order."""
    days = logged.groupBy(F.to_date("ts").alias("day")).agg(*[c.alias(n) for n, c in usage_stats().items()])
    return days.withColumn("total_all_time", F.sum("total_predictions").over(Window.orderBy("day")))


def export_history(logged: DataFrame, path: str) -> None:
    logged.write.option("header", True).csv(path)
