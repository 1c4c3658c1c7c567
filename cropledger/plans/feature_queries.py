"""Registered queries: calendar, series, weather, location, commodity and imputation features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..functions.fixed_values import FRAMES, LAGS
from ..operators import calendar as cal
from ..operators import group_features as gf
from ..operators import impute as imp
from ..operators import series_features as sf
from ..operators import weather as wx
from ..operators.panel_features import engineer_all_features
from ..sources.views import SERIES, TIE, named, obs
from .catalog import query
from .sqltext import OBS, ORDER, R, TIE as TIE_SQL, rows, with_named, with_obs
from ..functions import fixed_values as fv

KEY = [*SERIES, "date", *TIE]
K = f"{', '.join(SERIES)}, date, {TIE_SQL}"
WIN = f"PARTITION BY crop, state, district ORDER BY {ORDER}"


def rounds(df, digits, *cols):
    return rounded(df, **{c: digits for c in cols})


# ---- series

@query("price_lags", with_obs(
    f"SELECT {K}, " + ", ".join(f"lag(price, {k}) OVER ({WIN}) AS price_lag_{k}" for k in LAGS) + " FROM obs"))
def price_lags(spark, sf_dir):
    return sf.price_lags(obs(spark, sf_dir)).select(*KEY, *[f"price_lag_{k}" for k in LAGS])


@query("price_changes", with_obs(
    f"SELECT {K}, " + ", ".join(R(f"price - lag(price, {k}) OVER ({WIN})") + f" AS price_change_{k}" for k in LAGS)
    + " FROM obs"))
def price_changes(spark, sf_dir):
    cols = [f"price_change_{k}" for k in LAGS]
    return rounds(sf.price_changes(sf.price_lags(obs(spark, sf_dir))).select(*KEY, *cols), 4, *cols)


def _pct(k):
    lag = f"lag(price, {k}) OVER ({WIN})"
    return R(f"CASE WHEN {lag} > 0 THEN (price - {lag}) / {lag} * 100 ELSE 0 END") + f" AS price_change_pct_{k}"


@query("price_change_pct", with_obs(f"SELECT {K}, " + ", ".join(map(_pct, LAGS)) + " FROM obs"))
def price_change_pct(spark, sf_dir):
    cols = [f"price_change_pct_{k}" for k in LAGS]
    return rounds(sf.price_change_pct(sf.price_lags(obs(spark, sf_dir))).select(*KEY, *cols), 4, *cols)


def _frames(n, mean="sum(CAST(round(price * 10000) AS BIGINT))"):
    f = f"OVER ({WIN} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return (f"round({mean} {f} / count(*) {f}) / 10000.0 AS price_ma_{n}, "
            f"{R(f'stddev_samp(price) {f}', 2)} AS price_std_{n}, "
            f"min(price) {f} AS price_min_{n}, max(price) {f} AS price_max_{n}")


@query("rolling_price_stats", with_obs(f"SELECT {K}, " + ", ".join(map(_frames, FRAMES)) + " FROM obs"))
def rolling_price_stats(spark, sf_dir):
    out = sf.rolling_price_stats(obs(spark, sf_dir))
    cols = [f"price_{s}_{n}" for n in FRAMES for s in ("ma", "std", "min", "max")]
    out = rounds(out.select(*KEY, *cols), 4, *[f"price_ma_{n}" for n in FRAMES])
    return rounds(out, 2, *[f"price_std_{n}" for n in FRAMES])


def _vs(n):
    f = f"OVER ({WIN} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    ma = f"sum(CAST(round(price * 10000) AS BIGINT)) {f} / count(*) {f} / 10000.0"
    return R(f"(price - {ma}) / ({ma} + 1e-6)") + f" AS price_vs_ma_{n}"


@query("price_vs_ma", with_obs(f"SELECT {K}, " + ", ".join(map(_vs, FRAMES)) + " FROM obs"))
def price_vs_ma(spark, sf_dir):
    cols = [f"price_vs_ma_{n}" for n in FRAMES]
    return rounds(sf.price_vs_ma(sf.rolling_price_stats(obs(spark, sf_dir))).select(*KEY, *cols), 4, *cols)


@query("price_yoy", with_obs(f"""SELECT {K},
  {R("CASE WHEN count(*) OVER g = 1 THEN 0 ELSE price - lag(price) OVER (g ORDER BY " + ORDER + ") END")} AS price_yoy_change
  FROM obs WINDOW g AS (PARTITION BY crop, state, district, month(date), day(date))"""))
def price_yoy(spark, sf_dir):
    return rounds(sf.price_yoy(obs(spark, sf_dir)).select(*KEY, "price_yoy_change"), 4, "price_yoy_change")


@query("price_spread", with_obs(f"""SELECT {K}, {R('max_price - min_price')} AS price_range,
  {R('CASE WHEN min_price > 0 THEN (max_price - min_price) / min_price ELSE 0 END', 6)} AS price_range_pct,
  {R('(max_price - min_price) / (price + 1e-6)', 6)} AS price_volatility FROM obs"""))
def price_spread(spark, sf_dir):
    out = sf.price_spread(obs(spark, sf_dir)).select(*KEY, "price_range", "price_range_pct", "price_volatility")
    return rounded(out, price_range=4, price_range_pct=6, price_volatility=6)


@query("latest_n_per_series", with_obs(f"""SELECT {K},
  CAST(row_number() OVER (PARTITION BY crop, state, district ORDER BY date DESC, orderkey DESC, linenumber DESC,
    partkey DESC, suppkey DESC, price DESC) AS INTEGER) AS rn FROM obs QUALIFY rn <= 30"""))
def latest_n_per_series(spark, sf_dir):
    return sf.latest_n_per_series(obs(spark, sf_dir), 30).select(*KEY, "rn")


_DIR = """WITH {obs}, scored AS (SELECT *, price AS y, lag(price) OVER ({win}) AS y_hat FROM obs)
  SELECT {k}, CAST(sign(y - lag(y) OVER ({win})) AS INTEGER) AS actual_sign,
  CAST(sign(y_hat - lag(y_hat) OVER ({win})) AS INTEGER) AS predicted_sign FROM scored"""


@query("direction_of_change", _DIR.format(obs=OBS, win=WIN, k=K))
def direction_of_change(spark, sf_dir):
    scored = sf.price_lags(obs(spark, sf_dir), lags=(1,)).withColumns({"y": F.col("price"), "y_hat": F.col("price_lag_1")})
    return sf.direction_of_change(scored).select(*KEY, "actual_sign", "predicted_sign")


# ---- calendar

CAL = {
    "calendar_parts": """year(date)::INT AS year, month(date)::INT AS month, day(date)::INT AS day,
        (isodow(date) - 1)::INT AS day_of_week, dayofyear(date)::INT AS day_of_year, week(date)::INT AS week_of_year,
        quarter(date)::INT AS quarter""",
    "cyclical_encoding": ", ".join(
        R(f"{fn}(2 * pi() * {c} / {n})", 6) + f" AS {name}_{fn}"
        for name, c, n in (("month", "month(date)", 12), ("day", "dayofyear(date)", 365), ("weekday", "(isodow(date) - 1)", 7))
        for fn in ("sin", "cos")),
    "season_flags": """(month(date) BETWEEN 3 AND 5)::INT AS is_spring, (month(date) BETWEEN 6 AND 8)::INT AS is_summer,
        (month(date) BETWEEN 6 AND 9)::INT AS is_monsoon, (month(date) IN (12, 1, 2))::INT AS is_winter,
        (month(date) IN (10, 11, 12, 1, 2))::INT AS is_harvest""",
    "crop_season_flags": """(month(date) BETWEEN 6 AND 10)::INT AS is_kharif,
        (month(date) IN (11, 12, 1, 2, 3))::INT AS is_rabi, (month(date) BETWEEN 4 AND 5)::INT AS is_zaid""",
    "weekend_flag": "(isodow(date) >= 6)::INT AS is_weekend",
    "basic_calendar": "(isodow(date) - 1)::INT AS weekday, month(date)::INT AS month",
    "scoring_calendar": """year(date)::INT AS year, month(date)::INT AS month, dayofyear(date)::INT AS day_of_year,
        week(date)::INT AS week_of_year, quarter(date)::INT AS quarter,
        (month(date) BETWEEN 3 AND 5)::INT AS is_spring, (month(date) BETWEEN 6 AND 8)::INT AS is_summer,
        (month(date) BETWEEN 6 AND 9)::INT AS is_monsoon, (month(date) IN (12, 1, 2))::INT AS is_winter""",
}
_CAL_STEPS = {
    "calendar_parts": cal.calendar_parts,
    "cyclical_encoding": lambda d: cal.cyclical_encoding(cal.calendar_parts(d)),
    "season_flags": lambda d: cal.season_flags(cal.calendar_parts(d)),
    "crop_season_flags": lambda d: cal.crop_season_flags(cal.calendar_parts(d)),
    "weekend_flag": lambda d: cal.weekend_flag(cal.calendar_parts(d)),
    "basic_calendar": cal.basic_calendar,
    "scoring_calendar": cal.scoring_calendar,
}
_CAL_COLS = {
    "calendar_parts": ["year", "month", "day", "day_of_week", "day_of_year", "week_of_year", "quarter"],
    "cyclical_encoding": ["month_sin", "month_cos", "day_sin", "day_cos", "weekday_sin", "weekday_cos"],
    "season_flags": ["is_spring", "is_summer", "is_monsoon", "is_winter", "is_harvest"],
    "crop_season_flags": ["is_kharif", "is_rabi", "is_zaid"],
    "weekend_flag": ["is_weekend"],
    "basic_calendar": ["weekday", "month"],
    "scoring_calendar": ["year", "month", "day_of_year", "week_of_year", "quarter", "is_spring", "is_summer",
                         "is_monsoon", "is_winter"],
}


def _calendar(name):
    def run(spark, sf_dir):
        out = _CAL_STEPS[name](obs(spark, sf_dir)).select(*KEY, *_CAL_COLS[name])
        return rounds(out, 6, *_CAL_COLS[name]) if name == "cyclical_encoding" else out

    return run


for _name, _sql in CAL.items():
    query(_name, with_obs(f"SELECT {K}, {_sql} FROM obs"))(_calendar(_name))


# ---- weather

WEATHER_SQL = """, extent AS (SELECT state, district, min(date) AS lo, max(date) AS hi FROM obs GROUP BY ALL),
 starts AS (SELECT state, district, hi, CAST(unnest(generate_series(lo, hi, INTERVAL 90 DAY)) AS DATE) AS chunk_start FROM extent),
 chunks AS (SELECT state, district, chunk_start, least(CAST(chunk_start + INTERVAL 89 DAY AS DATE), hi) AS chunk_end FROM starts),
 calendar AS (SELECT state, district, CAST(unnest(generate_series(chunk_start, chunk_end, INTERVAL 1 DAY)) AS DATE) AS date,
   month(chunk_start) AS m FROM chunks),
 defaults AS (SELECT state, district, date,
   CASE WHEN m IN (12, 1, 2) THEN 28.0 WHEN m BETWEEN 3 AND 5 THEN 38.0 WHEN m BETWEEN 6 AND 9 THEN 32.0 ELSE 30.0 END::DOUBLE AS temperature_2m_max,
   CASE WHEN m IN (12, 1, 2) THEN 15.0 WHEN m BETWEEN 3 AND 5 THEN 25.0 WHEN m BETWEEN 6 AND 9 THEN 24.0 ELSE 20.0 END::DOUBLE AS temperature_2m_min,
   CASE WHEN m IN (12, 1, 2) THEN 0.0 WHEN m BETWEEN 3 AND 5 THEN 0.0 WHEN m BETWEEN 6 AND 9 THEN 5.0 ELSE 2.0 END::DOUBLE AS precipitation_sum
   FROM calendar),
 weather AS (SELECT state, district, date,
   CASE WHEN dayofyear(date) % 11 = 0 THEN NULL ELSE temperature_2m_max + day(date) % 7 END AS temperature_2m_max,
   CASE WHEN dayofyear(date) % 11 = 0 THEN NULL ELSE temperature_2m_min + day(date) % 5 END AS temperature_2m_min,
   CASE WHEN dayofyear(date) % 13 = 0 THEN NULL ELSE precipitation_sum + day(date) % 3 END AS precipitation_sum
   FROM defaults WHERE dayofyear(date) % 17 <> 0)"""
JOINED_SQL = """, joined AS (SELECT o.*, w.temperature_2m_max, w.temperature_2m_min, w.precipitation_sum,
   (w.temperature_2m_max + w.temperature_2m_min) / 2 AS temperature, w.precipitation_sum AS rainfall
   FROM obs o LEFT JOIN weather w USING (state, district, date))"""
W = OBS + WEATHER_SQL
J = W + JOINED_SQL


@query("weather_fetch_plan", f"WITH {W} SELECT * FROM chunks")
def weather_fetch_plan(spark, sf_dir):
    return wx.weather_fetch_plan(obs(spark, sf_dir)).select("state", "district", "chunk_start", "chunk_end")


@query("default_weather_calendar", f"WITH {W} SELECT * FROM defaults")
def default_weather_calendar(spark, sf_dir):
    return imp.default_weather_calendar(wx.weather_fetch_plan(obs(spark, sf_dir))).select(
        "state", "district", "date", "temperature_2m_max", "temperature_2m_min", "precipitation_sum")


@query("join_weather", f"WITH {J} SELECT {K}, temperature_2m_max, temperature_2m_min, precipitation_sum, temperature, rainfall FROM joined")
def join_weather(spark, sf_dir):
    o = obs(spark, sf_dir)
    return wx.join_weather(o, wx.weather(o)).select(
        *KEY, "temperature_2m_max", "temperature_2m_min", "precipitation_sum", "temperature", "rainfall")


@query("weather_coverage", f"""WITH {J}, c AS (SELECT count(*) AS total,
   count(*) FILTER (temperature_2m_max IS NOT NULL AND temperature_2m_min IS NOT NULL AND precipitation_sum IS NOT NULL) AS rows_all,
   count(*) FILTER (temperature_2m_max IS NOT NULL OR temperature_2m_min IS NOT NULL OR precipitation_sum IS NOT NULL) AS rows_any FROM joined)
   SELECT total, rows_all, rows_any, round(rows_all * 100.0 / total, 2)::DOUBLE AS pct_all,
   round(rows_any * 100.0 / total, 2)::DOUBLE AS pct_any FROM c""")
def weather_coverage(spark, sf_dir):
    o = obs(spark, sf_dir)
    return wx.weather_coverage(wx.join_weather(o, wx.weather(o)))


@query("fill_weather_gaps", f"""WITH {W}, days AS (SELECT DISTINCT state, district, date FROM obs),
  d AS (SELECT * FROM days LEFT JOIN weather USING (state, district, date)),
  f AS (SELECT state, district, date, precipitation_sum,
    last_value(temperature_2m_max IGNORE NULLS) OVER p AS pmax, last_value(temperature_2m_min IGNORE NULLS) OVER p AS pmin,
    first_value(temperature_2m_max IGNORE NULLS) OVER n AS nmax, first_value(temperature_2m_min IGNORE NULLS) OVER n AS nmin
    FROM d WINDOW p AS (PARTITION BY state, district ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                  n AS (PARTITION BY state, district ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT {', '.join('o.' + c for c in KEY)}, coalesce(pmax, nmax) AS temperature_2m_max,
    coalesce(pmin, nmin) AS temperature_2m_min, coalesce(precipitation_sum, 0) AS precipitation_sum
  FROM obs o JOIN f USING (state, district, date)""")
def fill_weather_gaps(spark, sf_dir):
    o = obs(spark, sf_dir)
    return wx.panel_weather_filled(o, wx.weather(o)).select(
        *KEY, "temperature_2m_max", "temperature_2m_min", "precipitation_sum")


def _wx(sql_col, n, fn="avg"):
    return (f"{fn}({sql_col}) OVER (PARTITION BY state, district ORDER BY crop, {ORDER} "
            f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)")


@query("temp_moving_avg", f"""WITH {J} SELECT {K}, {R(_wx('temperature', 7), 6)} AS temp_ma_7,
   {R(_wx('temperature', 30), 6)} AS temp_ma_30 FROM joined""")
def temp_moving_avg(spark, sf_dir):
    o = obs(spark, sf_dir)
    out = sf.temp_moving_avg(wx.join_weather(o, wx.weather(o)))
    return rounds(out.select(*KEY, "temp_ma_7", "temp_ma_30"), 6, "temp_ma_7", "temp_ma_30")


@query("rainfall_rolling", f"""WITH {J} SELECT {K}, {R(_wx('rainfall', 7), 6)} AS rainfall_ma_7,
   {R(_wx('rainfall', 30), 6)} AS rainfall_ma_30, {R(_wx('rainfall', 30, 'sum'), 6)} AS rainfall_sum_30 FROM joined""")
def rainfall_rolling(spark, sf_dir):
    o = obs(spark, sf_dir)
    cols = ["rainfall_ma_7", "rainfall_ma_30", "rainfall_sum_30"]
    return rounds(sf.rainfall_rolling(wx.join_weather(o, wx.weather(o))).select(*KEY, *cols), 6, *cols)


@query("fill_weather_defaults", f"""WITH {J} SELECT {K}, {R('coalesce(temperature, (SELECT avg(temperature) FROM joined))', 6)} AS temperature,
   coalesce(rainfall, 0)::DOUBLE AS rainfall FROM joined""")
def fill_weather_defaults(spark, sf_dir):
    o = obs(spark, sf_dir)
    out = imp.fill_weather_defaults(wx.join_weather(o, wx.weather(o))).select(*KEY, "temperature", "rainfall")
    return rounds(out, 6, "temperature")


# ---- location, commodity, interaction

def _group(keys, cols, extra=""):
    on = ", ".join(keys)
    return with_obs(f"""SELECT {K}, {extra or ', '.join(f'{R(a)} AS {n}' for n, a in cols.items())}
      FROM obs JOIN (SELECT {on}, {', '.join(f'{s} AS {a}' for a, s in cols_src(cols).items())} FROM obs GROUP BY {on}) USING ({on})""")


def cols_src(cols):
    return {a: {"m": "avg(price)", "sd": "stddev_samp(price)", "med": "quantile_cont(price, 0.5)",
                "mn": "min(price)", "mx": "max(price)", "c": "count(*)"}[a] for a in dict.fromkeys(cols.values())}


@query("state_price_stats", _group(["state"], {"state_price_avg": "m", "state_price_std": "sd", "state_price_median": "med"}))
def state_price_stats(spark, sf_dir):
    o = obs(spark, sf_dir)
    cols = ["state_price_avg", "state_price_std", "state_price_median"]
    return rounds(gf.state_price_stats(o, gf.PriceCube(o)).select(*KEY, *cols), 4, *cols)


@query("district_price_stats", _group(["state", "district"], {"district_price_avg": "m", "district_price_std": "sd"}))
def district_price_stats(spark, sf_dir):
    o = obs(spark, sf_dir)
    cols = ["district_price_avg", "district_price_std"]
    return rounds(gf.district_price_stats(o, gf.PriceCube(o)).select(*KEY, *cols), 4, *cols)


@query("price_vs_location", with_obs(f"""SELECT {K}, {R('(price - sm) / (sm + 1e-6)')} AS price_vs_state_avg,
   {R('(price - dm) / (dm + 1e-6)')} AS price_vs_district_avg FROM obs
   JOIN (SELECT state, avg(price) AS sm FROM obs GROUP BY state) USING (state)
   JOIN (SELECT state, district, avg(price) AS dm FROM obs GROUP BY ALL) USING (state, district)"""))
def price_vs_location(spark, sf_dir):
    o = obs(spark, sf_dir)
    cube = gf.PriceCube(o)
    out = cube.attach(o, cube.stats(["state"], "state_price", ["avg"]), ["state"])
    out = gf.price_vs_location(gf.district_price_stats(out, cube))
    return rounds(out.select(*KEY, "price_vs_state_avg", "price_vs_district_avg"), 4,
                  "price_vs_state_avg", "price_vs_district_avg")


@query("location_frequency", with_obs(f"""SELECT {K}, a.n AS state_frequency, b.n AS district_frequency FROM obs
   JOIN (SELECT state, count(*) AS n FROM obs GROUP BY 1) a USING (state)
   JOIN (SELECT district, count(*) AS n FROM obs GROUP BY 1) b USING (district)"""))
def location_frequency(spark, sf_dir):
    o = obs(spark, sf_dir)
    return gf.location_frequency(o, gf.PriceCube(o)).select(*KEY, "state_frequency", "district_frequency")


_CROP = {"crop_price_avg": "m", "crop_price_std": "sd", "crop_price_median": "med", "crop_price_min": "mn", "crop_price_max": "mx"}


@query("crop_price_stats", _group(["crop"], _CROP, ", ".join(f"{R(a)} AS {n}" for n, a in _CROP.items())
                                  + f", {R('(price - m) / (m + 1e-6)')} AS price_vs_crop_avg"))
def crop_price_stats(spark, sf_dir):
    o = obs(spark, sf_dir)
    cols = [*_CROP, "price_vs_crop_avg"]
    return rounds(gf.crop_price_stats(o, gf.PriceCube(o)).select(*KEY, *cols), 4, *cols)


@query("crop_range_position", with_obs(f"""SELECT {K}, n AS crop_frequency, {R('hi - lo')} AS crop_price_range,
   {R('(price - lo) / (hi - lo + 1e-6)')} AS crop_price_position FROM obs
   JOIN (SELECT crop, count(*) AS n, min(price) AS lo, max(price) AS hi FROM obs GROUP BY 1) USING (crop)"""))
def crop_range_position(spark, sf_dir):
    o = obs(spark, sf_dir)
    cube = gf.PriceCube(o)
    out = cube.attach(o, cube.stats(["crop"], "crop_price", ["min", "max"]), ["crop"])
    out = gf.crop_range_position(out, cube).select(*KEY, "crop_frequency", "crop_price_range", "crop_price_position")
    return rounds(out, 4, "crop_price_range", "crop_price_position")


@query("crop_price_category", with_obs(f"""SELECT {K}, CASE WHEN m <= 0 THEN NULL WHEN m <= 50 THEN 'low'
   WHEN m <= 200 THEN 'medium' WHEN m <= 1000 THEN 'high' ELSE 'very_high' END AS crop_price_category,
   CASE WHEN s <= 0 THEN NULL WHEN s <= 50 THEN 'low' WHEN s <= 200 THEN 'medium' WHEN s <= 1000 THEN 'high'
   ELSE 'very_high' END AS scaled_category
   FROM (SELECT *, (price - 1500) / 30 AS s FROM obs) JOIN (SELECT crop, avg(price) AS m FROM obs GROUP BY 1) USING (crop)"""))
def crop_price_category(spark, sf_dir):
    o = obs(spark, sf_dir)
    cube = gf.PriceCube(o)
    out = cube.attach(o, cube.stats(["crop"], "crop_price", ["avg"]), ["crop"])
    out = gf.crop_price_category(out).withColumn("s", (F.col("price") - 1500) / 30)
    keep = out.select(*KEY, "s", F.col("crop_price_category").alias("kept"))
    return gf.crop_price_category(keep, "s").select(
        *KEY, F.col("kept").alias("crop_price_category"), F.col("crop_price_category").alias("scaled_category"))


@query("state_crop_interaction", with_obs(f"""SELECT {K}, {R('m')} AS state_crop_price_avg, {R('sd')} AS state_crop_price_std,
   {R('(price - m) / (m + 1e-6)')} AS price_vs_state_crop FROM obs
   JOIN (SELECT state, crop, avg(price) AS m, stddev_samp(price) AS sd FROM obs GROUP BY ALL) USING (state, crop)"""))
def state_crop_interaction(spark, sf_dir):
    o = obs(spark, sf_dir)
    cols = ["state_crop_price_avg", "state_crop_price_std", "price_vs_state_crop"]
    return rounds(gf.state_crop_interaction(o, gf.PriceCube(o)).select(*KEY, *cols), 4, *cols)


@query("state_month_interaction", with_obs(f"""SELECT {K}, {R('m')} AS state_month_price_avg FROM obs o
   JOIN (SELECT state, month(date) AS mo, avg(price) AS m FROM obs GROUP BY ALL) g ON g.state = o.state AND g.mo = month(o.date)""".replace(K, "o." + K.replace(", ", ", o."))))
def state_month_interaction(spark, sf_dir):
    o = obs(spark, sf_dir)
    out = gf.state_month_interaction(o.withColumn("month", F.month("date")), gf.PriceCube(o))
    return rounds(out.select(*KEY, "state_month_price_avg"), 4, "state_month_price_avg")


@query("crop_month_interaction", with_obs(f"""SELECT {K}, {R('m')} AS crop_month_price_avg FROM obs o
   JOIN (SELECT crop, month(date) AS mo, avg(price) AS m FROM obs GROUP BY ALL) g ON g.crop = o.crop AND g.mo = month(o.date)""".replace(K, "o." + K.replace(", ", ", o."))))
def crop_month_interaction(spark, sf_dir):
    o = obs(spark, sf_dir)
    out = gf.crop_month_interaction(o.withColumn("month", F.month("date")), gf.PriceCube(o))
    return rounds(out.select(*KEY, "crop_month_price_avg"), 4, "crop_month_price_avg")


@query("join_group_stats", with_obs(f"""SELECT {K}, {R('a.m')} AS state_price_avg, {R('b.m')} AS district_price_avg,
   {R('c.m')} AS crop_price_avg, {R('d.m')} AS state_crop_price_avg FROM obs
   JOIN (SELECT state, avg(price) AS m FROM obs GROUP BY ALL) a USING (state)
   JOIN (SELECT state, district, avg(price) AS m FROM obs GROUP BY ALL) b USING (state, district)
   JOIN (SELECT crop, avg(price) AS m FROM obs GROUP BY ALL) c USING (crop)
   JOIN (SELECT state, crop, avg(price) AS m FROM obs GROUP BY ALL) d USING (state, crop)"""))
def join_group_stats(spark, sf_dir):
    o = obs(spark, sf_dir)
    cube = gf.PriceCube(o)
    out = o
    for keys, prefix in ((["state"], "state_price"), (["state", "district"], "district_price"),
                         (["crop"], "crop_price"), (["state", "crop"], "state_crop_price")):
        out = cube.attach(out, cube.stats(keys, prefix, ["avg"]), keys)
    cols = ["state_price_avg", "district_price_avg", "crop_price_avg", "state_crop_price_avg"]
    return rounds(out.select(*KEY, *cols), 4, *cols)


@query("join_frequency", with_obs(f"""SELECT {K}, n AS crop_frequency FROM obs
   JOIN (SELECT crop, count(*) AS n FROM obs GROUP BY 1) USING (crop)"""))
def join_frequency(spark, sf_dir):
    o = obs(spark, sf_dir)
    cube = gf.PriceCube(o)
    counts = cube.cells.groupBy("crop").agg(F.sum("rows").alias("crop_frequency"))
    return cube.attach(o, counts, ["crop"]).select(*KEY, "crop_frequency")


# ---- imputation

@query("impute_by_name_rule", f"""WITH {J}, f AS (SELECT {K}, temperature, lag(price, 7) OVER ({WIN}) AS price_lag_7,
   lag(price, 30) OVER ({WIN}) AS price_lag_30 FROM joined)
   SELECT {K}, {R('coalesce(temperature, (SELECT avg(temperature) FROM f))', 6)} AS temperature,
   {R('coalesce(price_lag_7, (SELECT quantile_cont(price_lag_7, 0.5) FROM f))')} AS price_lag_7,
   {R('coalesce(price_lag_30, (SELECT quantile_cont(price_lag_30, 0.5) FROM f))')} AS price_lag_30 FROM f""")
def impute_by_name_rule(spark, sf_dir):
    o = obs(spark, sf_dir)
    f = sf.price_lags(wx.join_weather(o, wx.weather(o)), lags=(7, 30)).select(*KEY, "temperature", "price_lag_7", "price_lag_30")
    out = imp.impute_by_name_rule(f)
    return rounded(out, temperature=6, price_lag_7=4, price_lag_30=4)


@query("commodity_default_price", with_named(f""", d(k, lo, hi, av, ord) AS ({rows([(*r, i) for i, r in enumerate(fv.CROP_DEFAULT_PRICES)])}),
   n AS (SELECT DISTINCT crop FROM named UNION SELECT DISTINCT lower(crop) FROM named
         UNION SELECT DISTINCT crop || ' (Fresh)' FROM named UNION SELECT DISTINCT p_brand FROM part),
   c AS (SELECT n.crop, d.*, CASE WHEN k = crop THEN 1 WHEN lower(k) = lower(crop) THEN 2 ELSE 3 END AS tier FROM n JOIN d
         ON contains(lower(k), lower(crop)) OR contains(lower(crop), lower(k))),
   b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY crop ORDER BY tier, ord) = 1)
   SELECT crop, coalesce(lo, 3000)::DOUBLE AS default_min, coalesce(hi, 5000)::DOUBLE AS default_max,
   coalesce(av, 4000)::DOUBLE AS default_avg, coalesce(tier, 4)::INT AS default_tier FROM n LEFT JOIN b USING (crop)"""))
def commodity_default_price(spark, sf_dir):
    from ..sources.tables import table

    crops = named(spark, sf_dir).select("crop").distinct()
    spelled = crops.select(F.explode(F.array("crop", F.lower("crop"), F.concat("crop", F.lit(" (Fresh)")))).alias("crop"))
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("crop"))
    return imp.commodity_default_price(spelled.union(brands).distinct())


MISSING = ["price_ma_7", "seasonal_index", "crop_mean_price", "rainfall_ma_7"]


@query("default_missing_features", with_obs(f"""SELECT {K}, {R('m')} AS price_ma_7, 0.0::DOUBLE AS seasonal_index,
   {R('m')} AS crop_mean_price, 0.0::DOUBLE AS rainfall_ma_7 FROM obs JOIN
   (SELECT crop, CASE WHEN crop = 'PROMO' THEN 2000 ELSE avg(price) END AS m FROM obs GROUP BY crop) USING (crop)"""))
def default_missing_features(spark, sf_dir):
    o = obs(spark, sf_dir)
    means = gf.PriceCube(o).stats(["crop"], "c", ["avg"]).filter("crop <> 'PROMO'").select(
        "crop", F.col("c_avg").alias("mean_price"))
    out = imp.default_missing_features(o, MISSING, means).select(*KEY, *MISSING)
    return rounded(out, price_ma_7=4, crop_mean_price=4)


# ---- whole feature stage

@query("feature_catalog")
def feature_catalog(spark, sf_dir):
    from ..operators.panel_features import feature_catalog as catalog

    o = obs(spark, sf_dir)
    return catalog(engineer_all_features(o, wx.weather(o), impute=False))


def _over(n, where=WIN):
    return f"OVER ({where} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _feature_sql():
    """(name, SQL over the joined rows, digits that are compared, whether it can be missing) of every feature."""
    place = f"PARTITION BY state, district ORDER BY crop, {ORDER}"
    for name, step in (("calendar_parts", None), ("cyclical_encoding", 6), ("season_flags", None), ("crop_season_flags", None), ("weekend_flag", None)):
        for column in _CAL_COLS[name]:
            yield column, f"{column}", step, False
    yield from ((c, c, 4, False) for c in ("min_price", "max_price"))
    yield "price_range", "max_price - min_price", 4, False
    yield "price_range_pct", "CASE WHEN min_price > 0 THEN (max_price - min_price) / min_price ELSE 0 END", 6, False
    yield "price_volatility", "(max_price - min_price) / (price + 1e-6)", 6, False
    for k in LAGS:
        lag = f"lag(price, {k}) OVER ({WIN})"
        yield f"price_lag_{k}", lag, 4, True
        yield f"price_change_{k}", f"price - {lag}", 4, True
        yield f"price_change_pct_{k}", f"CASE WHEN {lag} > 0 THEN (price - {lag}) / {lag} * 100 ELSE 0 END", 4, False
    for n in FRAMES:
        ma = f"sum(CAST(round(price * 10000) AS BIGINT)) {_over(n)} / count(*) {_over(n)} / 10000.0"
        yield f"price_ma_{n}", f"round(sum(CAST(round(price * 10000) AS BIGINT)) {_over(n)} / count(*) {_over(n)}) / 10000.0", 4, False
        yield f"price_std_{n}", f"stddev_samp(price) {_over(n)}", 2, True
        yield f"price_min_{n}", f"min(price) {_over(n)}", 4, False
        yield f"price_max_{n}", f"max(price) {_over(n)}", 4, False
        yield f"price_vs_ma_{n}", f"(price - {ma}) / ({ma} + 1e-6)", 4, False
    yield "price_yoy_change", f"CASE WHEN count(*) OVER g = 1 THEN 0 ELSE price - lag(price) OVER (g ORDER BY {ORDER}) END", 4, True
    for n in (7, 30):
        yield f"temp_ma_{n}", f"avg(temperature) {_over(n, place)}", 5, True
        yield f"rainfall_ma_{n}", f"avg(rainfall) {_over(n, place)}", 5, True
    yield "rainfall_sum_30", f"sum(rainfall) {_over(30, place)}", 5, True
    for grain in ("state", "district", "crop", "state_crop"):
        t = grain.replace("_", "")
        yield f"{grain}_price_avg", f"{t}.m", 4, False
        yield f"{grain}_price_std", f"{t}.sd", 4, grain == "state_crop"
        yield f"price_vs_{grain}" + ("" if grain == "state_crop" else "_avg"), f"(price - {t}.m) / ({t}.m + 1e-6)", 4, False
    yield from ((f"{t}_price_median", f"{t}.md", 4, False) for t in ("state", "crop"))
    yield from ((f"{t}_frequency", f"{t}{'name' if t == 'district' else ''}.n", None, False) for t in ("state", "district", "crop"))
    yield "crop_price_min", "crop.lo", 4, False
    yield "crop_price_max", "crop.hi", 4, False
    yield "crop_price_range", "crop.hi - crop.lo", 4, False
    yield "crop_price_position", "(price - crop.lo) / (crop.hi - crop.lo + 1e-6)", 4, False
    yield "state_month_price_avg", "statemonth.m", 4, False
    yield "crop_month_price_avg", "cropmonth.m", 4, False


FEATURES = list(_feature_sql())
_GRAINS = {"state": "state", "district": "state, district", "crop": "crop", "statecrop": "state, crop", "statemonth": "state, month", "cropmonth": "crop, month",
           "districtname": "district"}


def _all_features_sql():
    calendar = ", ".join(CAL[c] for c in ("calendar_parts", "cyclical_encoding", "season_flags", "crop_season_flags", "weekend_flag"))
    tables = "".join(f""", {t}_t AS (SELECT {on}, avg(price) AS m, stddev_samp(price) AS sd, min(price) AS lo, max(price) AS hi, count(*) AS n,
      {"quantile_cont(price, 0.5)" if t in ("state", "crop") else "NULL"} AS md FROM dated GROUP BY {on})""" for t, on in _GRAINS.items())
    joins = " ".join(f"JOIN {t}_t {t} ON " + " AND ".join(f"{t}.{c} = dated.{c}" for c in on.split(", ")) for t, on in _GRAINS.items())
    qualified = {c: f"dated.{c}" for c in ("state", "district", "crop", "month")}
    made = []
    for name, sql, _, _ in FEATURES:
        for c, q in qualified.items():
            sql = q if sql == c else sql.replace("BY crop, state, district", "BY dated.crop, dated.state, dated.district").replace(
                "BY state, district ORDER BY crop", "BY dated.state, dated.district ORDER BY dated.crop")
        made.append(f"{sql} AS {name}")
    missing = [n for n, _, _, gap in FEATURES if gap]
    fills = ", ".join(f"{'quantile_cont(' + n + ', 0.5)' if 'price' in n else 'avg(' + n + ')'} AS {n}" for n in missing)
    key = ", ".join(f"f.{c}" for c in KEY)
    out = ", ".join(f"{R(f'coalesce(f.{n}, i.{n})' if gap else 'f.' + n, d) if d else 'f.' + n} AS {n}" for n, _, d, gap in FEATURES)
    own = ", ".join(f"dated.{c}" for c in KEY)
    return f"""WITH {J}, dated AS (SELECT *, {calendar} FROM joined){tables},
      f AS (SELECT {own}, temperature, rainfall, {", ".join(made)} FROM dated {joins}
        WINDOW g AS (PARTITION BY dated.crop, dated.state, dated.district, dated.month, dated.day)),
      i AS (SELECT avg(temperature) AS temperature, {fills} FROM f)
      SELECT {key}, {R('coalesce(f.temperature, i.temperature)', 6)} AS temperature, coalesce(f.rainfall, 0.0)::DOUBLE AS rainfall, {out} FROM f CROSS JOIN i"""


@query("engineer_all_features", _all_features_sql())
def engineer_all(spark, sf_dir):
    o = obs(spark, sf_dir)
    digits = {"temperature": 6, **{n: d for n, _, d, _ in FEATURES if d}}
    out = engineer_all_features(o, wx.weather(o)).select(*KEY, "temperature", "rainfall", *[n for n, _, _, _ in FEATURES])
    return rounded(out, **digits)
