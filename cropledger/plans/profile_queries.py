"""Registered queries: profiling and aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded, to_date_any, to_number
from ..operators import profile as pr
from ..sources.views import named, obs, raw_obs
from .catalog import query
from .sqltext import R, any_date, num, with_named, with_obs, with_raw


@query("dataset_summary", with_obs("""SELECT count(*) AS total_records, min(date) AS min_date, max(date) AS max_date,
   (max(date) - min(date))::BIGINT AS span_days, count(DISTINCT state) AS states, count(DISTINCT district) AS districts,
   count(DISTINCT crop) AS crops FROM obs"""))
def dataset_summary(spark, sf_dir):
    return pr.dataset_summary(obs(spark, sf_dir))


@query("missing_profile", with_raw(f""", t AS (SELECT {any_date('date_raw')} AS date, state_raw AS state, crop_raw AS crop, {num('price_raw')} AS price FROM raw_obs),
   c AS (SELECT 'date' AS column_name, count(*) - count(date) AS missing_count, count(*) AS n FROM t
     UNION ALL SELECT 'state', count(*) - count(state), count(*) FROM t UNION ALL SELECT 'crop', count(*) - count(crop), count(*) FROM t
     UNION ALL SELECT 'price', count(*) - count(price), count(*) FROM t)
   SELECT column_name, missing_count, round(missing_count * 100.0 / n, 2)::DOUBLE AS missing_pct FROM c WHERE missing_count > 0"""))
def missing_profile(spark, sf_dir):
    return pr.missing_profile(raw_obs(spark, sf_dir).select(
        to_date_any("date_raw").alias("date"), F.col("state_raw").alias("state"), F.col("crop_raw").alias("crop"),
        to_number("price_raw").alias("price")))


@query("price_describe", with_obs(f"""SELECT count(price) AS count, {R('avg(price)')} AS mean, {R('stddev_samp(price)')} AS std, min(price) AS min,
   {R('quantile_cont(price, 0.25)')} AS p25, {R('quantile_cont(price, 0.5)')} AS p50, {R('quantile_cont(price, 0.75)')} AS p75, max(price) AS max FROM obs"""))
def price_describe(spark, sf_dir):
    return rounded(pr.price_describe(obs(spark, sf_dir)), mean=4, std=4, p25=4, p50=4, p75=4)


@query("outliers_iqr", with_named(f""", b AS (SELECT price * (CASE WHEN orderkey % 50 = 0 THEN 5 ELSE 1 END) AS price FROM named),
   q AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS c FROM b)
   SELECT {R('a - 1.5 * (c - a)')} AS lower_bound, {R('c + 1.5 * (c - a)')} AS upper_bound,
   count(*) FILTER (price < a - 1.5 * (c - a) OR price > c + 1.5 * (c - a)) AS outliers,
   round(count(*) FILTER (price < a - 1.5 * (c - a) OR price > c + 1.5 * (c - a)) * 100.0 / count(*), 2)::DOUBLE AS outlier_pct FROM b, q GROUP BY a, c"""))
def outliers_iqr(spark, sf_dir):
    b = named(spark, sf_dir).withColumn("price", F.col("price") * F.when(F.col("orderkey") % 50 == 0, 5).otherwise(1))
    return rounded(pr.outliers_iqr(b), lower_bound=4, upper_bound=4)


@query("records_by_year", with_obs("SELECT year(date)::INT AS year, count(*) AS records FROM obs GROUP BY 1"))
def records_by_year(spark, sf_dir):
    return pr.records_by_year(obs(spark, sf_dir))


@query("records_by_month", with_obs("SELECT month(date)::INT AS month, count(*) AS records FROM obs GROUP BY 1"))
def records_by_month(spark, sf_dir):
    return pr.records_by_month(obs(spark, sf_dir))


def _top(c, n):
    return f"SELECT {c}, count(*) AS records FROM obs GROUP BY 1 ORDER BY records DESC, {c} LIMIT {n}"


@query("top_states", with_obs(_top("state", 10)))
def top_states(spark, sf_dir):
    return pr.top_states(obs(spark, sf_dir))


@query("top_districts", with_obs(_top("district", 10)))
def top_districts(spark, sf_dir):
    return pr.top_districts(obs(spark, sf_dir))


@query("top_crops", with_obs(_top("crop", 20)))
def top_crops(spark, sf_dir):
    return pr.top_crops(obs(spark, sf_dir))


@query("price_by_top_crops", with_obs(f""", t AS ({_top('crop', 10)}) SELECT crop, {R('avg(price)')} AS mean_price,
   {R('quantile_cont(price, 0.5)')} AS median_price, {R('stddev_samp(price)')} AS std_price, count(*) AS records
   FROM obs WHERE crop IN (SELECT crop FROM t) GROUP BY crop"""))
def price_by_top_crops(spark, sf_dir):
    return rounded(pr.price_by_top_crops(obs(spark, sf_dir)), mean_price=4, median_price=4, std_price=4)


@query("seasonal_month_price", with_obs(f"SELECT month(date)::INT AS month, {R('avg(price)')} AS mean_price FROM obs GROUP BY 1"))
def seasonal_month_price(spark, sf_dir):
    return rounded(pr.seasonal_month_price(obs(spark, sf_dir)), mean_price=4)


@query("weekday_price", with_obs(f"SELECT (isodow(date) - 1)::INT AS weekday, {R('avg(price)')} AS mean_price FROM obs GROUP BY 1"))
def weekday_price(spark, sf_dir):
    return rounded(pr.weekday_price(obs(spark, sf_dir)), mean_price=4)


@query("state_price_rank", with_obs(f"SELECT state, {R('avg(price)')} AS mean_price FROM obs GROUP BY 1 ORDER BY avg(price) DESC, state LIMIT 10"))
def state_price_rank(spark, sf_dir):
    return rounded(pr.state_price_rank(obs(spark, sf_dir)), mean_price=4)


@query("price_histogram", with_obs(f""", e AS (SELECT min(price) AS lo, max(price) AS hi, (max(price) - min(price)) / 100 AS w FROM obs),
   h AS (SELECT least(floor((price - lo) / w), 99)::INT AS bin, count(*) AS records FROM obs, e GROUP BY 1)
   SELECT b::INT AS bin, {R('lo + b * w')} AS lower, {R('lo + (b + 1) * w')} AS upper, coalesce(records, 0) AS records
   FROM e, range(100) r(b) LEFT JOIN h ON h.bin = b"""))
def price_histogram(spark, sf_dir):
    return rounded(pr.price_histogram(obs(spark, sf_dir)), lower=4, upper=4)


@query("monthly_price_trend", with_obs(f"""SELECT year(date)::INT AS year, month(date)::INT AS month, date_trunc('month', date)::DATE AS month_start,
   {R('avg(price)')} AS mean_price FROM obs GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY 1, 2, 3")))
def monthly_price_trend(spark, sf_dir):
    return rounded(pr.monthly_price_trend(obs(spark, sf_dir)), mean_price=4)


@query("top_counts_chart_data", with_obs("""(SELECT 'crop' AS kind, crop AS name, count(*) AS records FROM obs GROUP BY crop ORDER BY records DESC, crop LIMIT 15)
   UNION ALL (SELECT 'state', state, count(*) AS records FROM obs GROUP BY state ORDER BY records DESC, state LIMIT 15)"""))
def top_counts_chart_data(spark, sf_dir):
    return pr.top_counts_chart_data(obs(spark, sf_dir))


@query("coverage_overview", with_obs("""SELECT count(*) AS records, count(DISTINCT state) AS states, count(DISTINCT district) AS districts,
   count(DISTINCT crop) AS crops, count(DISTINCT (state, district)) AS locations, count(DISTINCT (state, district, crop)) AS series FROM obs"""))
def coverage_overview(spark, sf_dir):
    return pr.coverage_overview(obs(spark, sf_dir))


@query("crops_per_state", with_obs(f""", p AS (SELECT state, count(DISTINCT CASE WHEN crop = 'PROMO' AND state = 'ASIA' THEN 'SMALL' ELSE crop END) AS crops FROM obs GROUP BY 1)
   SELECT state, crops, (SELECT {R('avg(crops)')} FROM p) AS mean_crops, (SELECT min(crops) FROM p) AS min_crops, (SELECT max(crops) FROM p) AS max_crops FROM p"""))
def crops_per_state(spark, sf_dir):
    o = obs(spark, sf_dir)
    renamed = F.when((F.col("crop") == "PROMO") & (F.col("state") == "ASIA"), F.lit("SMALL")).otherwise(F.col("crop"))  # one state with a crop less
    return rounded(pr.crops_per_state(o.withColumn("crop", renamed)), mean_crops=4)


@query("state_detail", with_obs("""SELECT state, count(DISTINCT district) AS districts, count(DISTINCT crop) AS crops,
   count(DISTINCT (district, crop)) AS combinations FROM obs GROUP BY 1"""))
def state_detail(spark, sf_dir):
    return pr.state_detail(obs(spark, sf_dir))


@query("commodity_price_stats", with_named(f"""SELECT min(price) AS min_price, max(price) AS max_price, {R('avg(price)')} AS avg_price,
   {R('stddev_samp(price)')} AS std_price FROM named WHERE contains(lower(crop), 'otato')"""))
def commodity_price_stats(spark, sf_dir):
    return rounded(pr.commodity_price_stats(named(spark, sf_dir), "OTATO"), avg_price=4, std_price=4)


@query("source_contribution", with_obs("""SELECT data_source, count(*) AS records FROM obs GROUP BY 1 UNION ALL SELECT 'combined', count(*) FROM obs"""))
def source_contribution(spark, sf_dir):
    return pr.source_contribution(obs(spark, sf_dir))


@query("location_extent", with_obs("SELECT state, district, count(*) AS rows, min(date) AS min_date, max(date) AS max_date FROM obs GROUP BY 1, 2"))
def location_extent(spark, sf_dir):
    return pr.location_extent(obs(spark, sf_dir))
