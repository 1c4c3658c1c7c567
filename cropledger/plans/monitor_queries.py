"""Registered queries: prediction monitoring in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import market as mk
from ..operators import monitor as mo
from ..session import new_path
from ..sources.views import obs, pred_log
from ..streaming import monitor as st
from .catalog import query
from .market_queries import _round_market, market_sql
from .sqltext import R, with_obs

LOG = """log AS (SELECT *, abs(predicted - actual) AS absolute_error, CASE WHEN abs(predicted - actual) IS NULL THEN NULL
     WHEN actual > 0 THEN abs(predicted - actual) / actual * 100 ELSE 0 END AS percentage_error FROM (
     SELECT event_id, ts, event_type AS model, CASE WHEN user_id % 7 <> 0 THEN value END AS actual,
       CASE WHEN user_id % 11 <> 0 THEN value * (1 + (CAST(json_extract_string(props, '$.k') AS DOUBLE) - 50) / 1000) END AS predicted,
       CASE WHEN event_type = 'error' THEN 'failure ' || (user_id % 3) END AS error FROM events))"""
STATS = f"""count(*) AS total_predictions, {R('count(error) * 100.0 / count(*)')}::DOUBLE AS error_rate, {R('avg(absolute_error)')} AS average_error,
   count(absolute_error) AS predictions_with_actual"""


def logged(spark, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return mo.log_predictions(pred_log(spark, sf_dir))


def r_stats(df):
    return rounded(df, error_rate=4, average_error=4)


@query("log_predictions", f"WITH {LOG} SELECT event_id, model, {R('absolute_error', 6)} AS absolute_error, {R('percentage_error', 6)} AS percentage_error FROM log")
def log_predictions(spark, sf_dir):
    out = logged(spark, sf_dir).select("event_id", "model", "absolute_error", "percentage_error")
    return rounded(out, absolute_error=6, percentage_error=6)


@query("monitor_window_stats", f"WITH {LOG} SELECT {STATS} FROM log WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AND ts <= TIMESTAMP '2024-01-20'")
def monitor_window_stats(spark, sf_dir):
    return r_stats(mo.monitor_window_stats(logged(spark, sf_dir), "2024-01-20", 7))


@query("monitor_usage", f"""WITH {LOG} SELECT 'model' AS kind, model AS name, count(*) AS uses FROM log GROUP BY model
   UNION ALL SELECT 'error', error, count(*) FROM log WHERE error IS NOT NULL GROUP BY error""")
def monitor_usage(spark, sf_dir):
    return mo.monitor_usage(logged(spark, sf_dir))


@query("model_performance", f"""WITH {LOG}, a AS (SELECT model, absolute_error AS e, percentage_error AS p FROM log UNION ALL SELECT 'all', absolute_error, percentage_error FROM log)
   SELECT model, count(*) AS total_predictions, {R('avg(e)')} AS mae, {R('sqrt(avg(e * e))')} AS rmse, {R('avg(p)')} AS mape, {R('max(e)', 6)} AS max_error,
   {R('min(e)', 6)} AS min_error FROM a WHERE e IS NOT NULL GROUP BY model""")
def model_performance(spark, sf_dir):
    return rounded(mo.model_performance(logged(spark, sf_dir)), mae=4, rmse=4, mape=4, max_error=6, min_error=6)


@query("daily_report", f"""WITH {LOG}, d AS (SELECT CAST(ts AS DATE) AS day, {STATS} FROM log GROUP BY 1)
   SELECT *, (sum(total_predictions) OVER (ORDER BY day))::BIGINT AS total_all_time FROM d""")
def daily_report(spark, sf_dir):
    return r_stats(mo.daily_report(logged(spark, sf_dir)))


@query("export_history", f"WITH {LOG} SELECT event_id, model, {R('absolute_error', 6)} AS absolute_error, error FROM log")
def export_history(spark, sf_dir):
    path = new_path(spark, "history")
    rows = logged(spark, sf_dir).select("event_id", "model", F.round("absolute_error", 6).alias("absolute_error"), "error")
    mo.export_history(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query("stream_monitor_daily", f"""WITH {LOG}, d AS (SELECT CAST(ts AS DATE) AS window_start, model, {STATS} FROM log GROUP BY 1, 2)
   SELECT window_start, (window_start + 1)::DATE AS window_end, model, total_predictions, error_rate, average_error, predictions_with_actual
   FROM d""")
def stream_monitor_daily(spark, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return r_stats(st.stream_monitor_daily(spark, sf_dir))


@query("stream_monitor_sliding", f"""WITH {LOG}, s AS (SELECT *, unnest(range(0, 30)) AS back FROM log),
   d AS (SELECT (CAST(ts AS DATE) - back::INT)::DATE AS window_start, model, {STATS} FROM s GROUP BY 1, 2)
   SELECT window_start, (window_start + 30)::DATE AS window_end, model, total_predictions, error_rate, average_error, predictions_with_actual
   FROM d""")
def stream_monitor_sliding(spark, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return r_stats(st.stream_monitor_sliding(spark, sf_dir))


@query("stream_dedupe_observations", "SELECT event_id, event_type, user_id, value FROM events")
def stream_dedupe_observations(spark, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = st.table_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    # Every third event is reported three times.
    copies = F.when(F.col("event_id") % 3 == 0, F.sequence(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(1)))
    repeated = events.withColumn("copy", F.explode(copies))
    out = st.run_to_table(st.dedupe_stream(repeated, ["event_id"]), "dedupe")
    return out.select("event_id", "event_type", "user_id", "value")


@query("stream_latest_conditions", with_obs(", " + market_sql("obs", "crop, state, district") + " SELECT * FROM m"))
def stream_latest_conditions(spark, sf_dir):
    latest = st.latest_conditions(obs(spark, sf_dir, st.table_stream(spark, sf_dir, "lineitem")))
    return _round_market(mk.market_conditions(latest))
