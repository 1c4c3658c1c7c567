"""Registered queries: market state, forecasting and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.columns import rounded
from ..operators import forecast as fc
from ..operators import impute as imp
from ..operators import market as mk
from ..operators import series_features as sf
from ..operators import weather as wx
from ..session import materialize
from ..sources.views import SERIES, named, obs, requests
from .catalog import query
from .clean_queries import _REQ
from .feature_queries import W
from .sqltext import NAMED, OBS, R, rows, with_named, with_obs

KEYS = ["crop", "state", "district"]
DESC = "date DESC, orderkey DESC, linenumber DESC, partkey DESC, suppkey DESC, price DESC"
RECENT = "string_agg(strftime(date, '%Y-%m-%d') || '=' || CAST(CAST(price AS DECIMAL(18,2)) AS VARCHAR), ';' ORDER BY rn)"


def recent_text(df):
    return df.withColumn("recent_prices", F.array_join(F.transform("recent_prices", lambda e: F.concat(
        F.date_format(e["date"], "yyyy-MM-dd"), F.lit("="), e["price"].cast("decimal(18,2)").cast("string"))), ";"))


def market_sql(src: str, keys: str, n: int = 30, name: str = "m") -> str:
    return f"""{name}r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {DESC}) AS rn FROM {src} QUALIFY rn <= {n}),
      {name} AS (SELECT {keys}, arg_min(price, rn) AS current_price, arg_min(min_price, rn) AS market_min, arg_min(max_price, rn) AS market_max,
        round(avg(CAST(round(price * 10000) AS BIGINT)) FILTER (rn <= 7)) / 10000.0 AS avg_price_7d,
        round(avg(CAST(round(price * 10000) AS BIGINT))) / 10000.0 AS avg_price_30d,
        CASE WHEN arg_min(price, rn) > arg_max(price, rn) THEN 'increasing' WHEN arg_min(price, rn) < arg_max(price, rn) THEN 'decreasing' ELSE 'stable' END AS price_trend,
        {R('coalesce(stddev_samp(price), 0)', 2)} AS volatility, {RECENT} AS recent_prices, count(*) AS records_count FROM {name}r GROUP BY {keys})"""


def _round_market(df):
    return rounded(recent_text(df), avg_price_7d=4, avg_price_30d=4, volatility=2)


@query("market_conditions", with_obs(", " + market_sql("obs", "crop, state, district") + " SELECT * FROM m"))
def market_conditions(spark, sf_dir):
    return _round_market(mk.market_conditions(obs(spark, sf_dir)))


# A panel in which only some places report the primary source, so that all labels occur.
_SRC = """, src AS (SELECT * REPLACE (CASE WHEN state = 'Kerala' AND data_source = 'enam' THEN 'datagov' ELSE data_source END AS data_source,
   lower(crop) AS crop, lower(state) AS state, lower(district) AS district) FROM named WHERE crop <> 'Wheat' OR data_source <> 'enam')"""


def _src(spark, sf_dir):
    n = named(spark, sf_dir).filter("crop <> 'Wheat' OR data_source <> 'enam'")
    return n.withColumn("data_source", F.when((F.col("state") == "Kerala") & (F.col("data_source") == "enam"), "datagov").otherwise(F.col("data_source")))


_ASK = """asked AS (SELECT *, lower(trim(crop)) AS ck, lower(trim(state)) AS sk, lower(trim(district)) AS dk FROM req)"""
_MCOLS = ["current_price", "market_min", "market_max", "avg_price_7d", "avg_price_30d", "price_trend", "volatility", "recent_prices", "records_count"]


def _pick(c, trend=None):
    third = "'stable'" if c == "price_trend" and trend else f"c.{c}"
    return f"CASE WHEN a.crop IS NOT NULL THEN a.{c} WHEN b.crop IS NOT NULL THEN b.{c} WHEN c.crop IS NOT NULL THEN {third} END AS {c}"


_GRAIN = """CASE WHEN a.crop IS NOT NULL THEN 'location_specific' WHEN b.crop IS NOT NULL THEN 'state_level' WHEN c.crop IS NOT NULL THEN 'commodity_level' END"""
_JOINS = """FROM asked q LEFT JOIN a ON a.crop = ck AND a.state = sk AND a.district = dk LEFT JOIN b ON b.crop = ck AND b.state = sk LEFT JOIN c ON c.crop = ck"""


@query("market_conditions_fallback", with_named(_REQ + _SRC + ", " + ", ".join(
    [market_sql("src", "crop, state, district", 30, "a"), market_sql("src", "crop, state", 30, "b"), market_sql("src", "crop", 30, "c"), _ASK]) + f"""
   SELECT q.crop, q.state, q.district, q.kind, {', '.join(_pick(c, True) for c in _MCOLS)}, {_GRAIN} AS grain,
   CASE WHEN a.crop IS NOT NULL AND EXISTS (SELECT 1 FROM src s WHERE s.data_source = 'enam' AND s.crop = ck AND s.state = sk AND s.district = dk) THEN 'enam_primary'
        WHEN a.crop IS NULL AND b.crop IS NOT NULL AND EXISTS (SELECT 1 FROM src s WHERE s.data_source = 'enam' AND s.crop = ck AND s.state = sk) THEN 'enam_primary'
        WHEN a.crop IS NULL AND b.crop IS NULL AND EXISTS (SELECT 1 FROM src s WHERE s.data_source = 'enam' AND s.crop = ck) THEN 'enam_primary'
        ELSE {_GRAIN} END AS data_source, 0 AS is_fallback {_JOINS}"""))
def market_conditions_fallback(spark, sf_dir):
    out = mk.market_conditions_fallback(requests(spark, sf_dir), _src(spark, sf_dir)).drop("target_date")
    return _round_market(out).withColumn("is_fallback", F.col("is_fallback").cast("int"))


@query("previous_week_conditions", with_named(_REQ + """, src AS (SELECT * REPLACE (lower(crop) AS crop, lower(state) AS state, lower(district) AS district)
   FROM named WHERE date BETWEEN DATE '2000-06-16' AND DATE '2000-06-23'), """ + ", ".join(
    [market_sql("src", "crop, state, district", 7, "a"), market_sql("src", "crop, state", 7, "b"), market_sql("src", "crop", 7, "c"), _ASK]) + f""",
   w AS (SELECT q.crop, q.state, q.district, q.kind, {', '.join(_pick(c) for c in _MCOLS)}, {_GRAIN} AS grain, 'previous_week_fallback' AS data_source,
   1 AS is_fallback, '2000-06-16 to 2000-06-23' AS fallback_date_range {_JOINS}) SELECT * FROM w WHERE grain IS NOT NULL"""))
def previous_week_conditions(spark, sf_dir):
    out = mk.previous_week_conditions(requests(spark, sf_dir), named(spark, sf_dir), "2000-06-30").drop("target_date")
    return _round_market(out).withColumn("is_fallback", F.col("is_fallback").cast("int"))


@query("source_priority", with_named(_SRC.replace("lower(crop) AS crop, lower(state) AS state, lower(district) AS district", "crop AS crop") + """
   SELECT crop, state, district, count(*) AS records, count(DISTINCT data_source) AS sources,
   CASE WHEN bool_or(data_source = 'enam') THEN 'enam_primary' ELSE 'location_specific' END AS data_source FROM src GROUP BY 1, 2, 3"""))
def source_priority(spark, sf_dir):
    return mk.source_priority(_src(spark, sf_dir))


# Raw predictions off the market by a factor that depends on the lot, to reach every branch.
_RAWP = "CASE WHEN orderkey % 9 = 0 THEN NULL WHEN orderkey % 9 = 1 THEN 0 ELSE price * [0.2, 0.4, 0.69, 0.75, 1.0, 1.45, 3.0][orderkey % 7 + 1] END"
_CALS = f""", {market_sql('obs', 'crop, state, district')}, p AS (SELECT orderkey, linenumber, partkey, suppkey, {_RAWP} AS raw_prediction,
     CASE WHEN linenumber > 5 THEN NULL ELSE current_price END AS current_price, CASE WHEN linenumber = 7 THEN NULL ELSE avg_price_7d END AS avg_price_7d,
     avg_price_30d FROM obs JOIN m USING (crop, state, district)), r AS (SELECT *, current_price / nullif(raw_prediction, 0) AS q,
     coalesce(avg_price_7d, avg_price_30d) / nullif(raw_prediction, 0) AS s FROM p)"""


@query("calibrate_prediction", with_obs(_CALS + f""" SELECT orderkey, linenumber, partkey, suppkey, {R('raw_prediction')} AS raw_prediction,
   {R('''CASE WHEN raw_prediction IS NULL OR raw_prediction <= 0 THEN raw_prediction
     WHEN q > 1.3 THEN raw_prediction * (1 + (least(q, 2.5) - 1) * 0.7) WHEN q < 0.7 THEN raw_prediction * (1 + (greatest(q, 0.4) - 1) * 0.7)
     WHEN s > 1.3 OR s < 0.7 THEN raw_prediction * (1 + (least(greatest(s, 0.5), 2.0) - 1) * 0.5) ELSE raw_prediction END''', 6)} AS calibrated FROM r"""))
def calibrate_prediction(spark, sf_dir):
    o = obs(spark, sf_dir)
    factor = F.element_at(F.array(*[F.lit(x) for x in (0.2, 0.4, 0.69, 0.75, 1.0, 1.45, 3.0)]), (F.col("orderkey") % 7 + 1).cast("int"))
    k = F.col("orderkey") % 9
    m = mk.market_conditions(o).select(*KEYS, "current_price", F.round("avg_price_7d", 4).alias("avg_price_7d"), F.round("avg_price_30d", 4).alias("avg_price_30d"))
    p = o.join(m, KEYS).withColumns({
        "raw_prediction": F.when(k == 0, F.lit(None).cast("double")).when(k == 1, 0.0).otherwise(F.col("price") * factor),
        "current_price": F.when(F.col("linenumber") <= 5, F.col("current_price")),
        "avg_price_7d": F.when(F.col("linenumber") != 7, F.col("avg_price_7d"))})
    out = fc.calibrate_prediction(p).select("orderkey", "linenumber", "partkey", "suppkey", "raw_prediction", "calibrated")
    return rounded(out, raw_prediction=4, calibrated=6)


@query("forecast_grid", with_named(_REQ + """, g AS (SELECT *, least(length(district), 7)::INT AS h FROM req)
   SELECT crop, state, district, kind, s::INT AS step, (DATE '2001-06-30' + s::INT)::DATE AS date
   FROM g, range(7) r(s) WHERE s < h"""))
def forecast_grid(spark, sf_dir):
    return fc.forecast_grid(requests(spark, sf_dir), F.length("district")).drop("target_date")


def _unrolled(n=7):
    """The blended averages, one expression level per step."""
    sel = ["avg_price_7d AS a0, avg_price_30d AS b0, (avg_price_7d * 0.6 + avg_price_30d * 0.4) AS p0"]
    text = f"s0 AS (SELECT crop, state, district, avg_price_7d, avg_price_30d, {sel[0]} FROM m)"
    for d in range(1, n):
        w7, w30 = max(0.3, 1 - d * 0.1), max(0.5, 1 - d * 0.05)
        text += (f", t{d} AS (SELECT *, {w7} * avg_price_7d + (1 - {w7}) * p{d - 1} AS a{d}, {w30} * avg_price_30d + (1 - {w30}) * p{d - 1} AS b{d} FROM s{d - 1})"
                 f", s{d} AS (SELECT *, a{d} * 0.6 + b{d} * 0.4 AS p{d} FROM t{d})")
    union = " UNION ALL ".join(
        f"SELECT crop, state, district, {d} AS step, {R(f'a{d}', 3)} AS ma_7, {R(f'b{d}', 3)} AS ma_30, {R(f'p{d}', 3)} AS price FROM s{n - 1}" for d in range(n))
    return f", {text} {union}"


@query("project_moving_averages", with_obs(", " + market_sql("obs", "crop, state, district") + _unrolled()))
def project_moving_averages(spark, sf_dir):
    out = fc.project_moving_averages(_conditions(spark, sf_dir), lambda a, b: a * 0.6 + b * 0.4)
    return rounded(out.select(*KEYS, "step", "ma_7", "ma_30", "price"), ma_7=3, ma_30=3, price=3)


def _conditions(spark, sf_dir):
    m = mk.market_conditions(obs(spark, sf_dir)).select(*KEYS, "current_price", "avg_price_7d", "avg_price_30d")
    return materialize(m.withColumns({"avg_price_7d": F.round("avg_price_7d", 4), "avg_price_30d": F.round("avg_price_30d", 4)}), "conditions")


_FC = OBS + ", " + market_sql("obs", "crop, state, district")
_FCW = W + ", " + market_sql("obs", "crop, state, district")


def _series_grid(spark, sf_dir):
    o = obs(spark, sf_dir)
    ask = o.select(*KEYS).distinct().withColumn("target_date", F.lit("2001-08-01").cast("date"))
    return fc.forecast_grid(ask, 7)


@query("weather_for_forecast", f"""WITH {W}, g AS (SELECT crop, state, district, (DATE '2001-08-01' + s::INT)::DATE AS date, s::INT AS step
     FROM (SELECT DISTINCT crop, state, district FROM obs), range(7) r(s)),
   l AS (SELECT state, district, max(date) AS md FROM weather GROUP BY 1, 2),
   lw AS (SELECT w.* FROM weather w JOIN l ON l.state = w.state AND l.district = w.district AND l.md = w.date)
   SELECT crop, g.state, g.district, step, g.date,
     coalesce(CASE WHEN w.date IS NOT NULL THEN w.temperature_2m_max ELSE lw.temperature_2m_max END, 25) AS temperature_2m_max,
     coalesce(CASE WHEN w.date IS NOT NULL THEN w.temperature_2m_min ELSE lw.temperature_2m_min END, 20) AS temperature_2m_min,
     coalesce(CASE WHEN w.date IS NOT NULL THEN w.precipitation_sum ELSE lw.precipitation_sum END, 0) AS precipitation_sum
   FROM g LEFT JOIN weather w ON w.state = g.state AND w.district = g.district AND w.date = g.date AND w.date > DATE '2001-08-02'
   LEFT JOIN lw ON lw.state = g.state AND lw.district = g.district""")
def weather_for_forecast(spark, sf_dir):
    o = obs(spark, sf_dir)
    return fc.weather_for_forecast(_series_grid(spark, sf_dir), wx.weather(o), "2001-08-02").select(
        *KEYS, "step", "date", "temperature_2m_max", "temperature_2m_min", "precipitation_sum")


_DEF = f""", d(k, lo, hi, av, ord) AS ({rows([(*r, i) for i, r in enumerate(fv.CROP_DEFAULT_PRICES)])}),
   dd AS (SELECT c.crop, coalesce(lo, 3000)::DOUBLE AS dlo, coalesce(hi, 5000)::DOUBLE AS dhi, coalesce(av, 4000)::DOUBLE AS dav
     FROM (SELECT DISTINCT crop FROM named) c LEFT JOIN d ON k = c.crop)"""
_SF = ["min_price", "max_price", "price_ma_7", "price_ma_30", "price_std_7", "price_volatility", "price_range", "price_range_ratio",
       "seasonal_avg_price", "price_change_7d", "price_change_30d", "day_of_year", "is_monsoon"]


def _asked_market(spark, sf_dir):
    """Market columns per series; Tomato has no market data, Onion no bounds."""
    n = named(spark, sf_dir)
    m = mk.market_conditions(n.filter("crop <> 'Tomato'"))
    m = m.select(*KEYS, *[(F.when(F.col("crop") != "Onion", F.col(c)) if c in ("market_min", "market_max") else
                           F.round(c, 4) if c.startswith("avg") else F.round(c, 2) if c == "volatility" else F.col(c)).alias(c)
                          for c in ("current_price", "market_min", "market_max", "avg_price_7d", "avg_price_30d", "volatility")])
    return n.select(*KEYS).distinct().join(m, KEYS, "left").withColumn("date", F.lit("2001-07-15").cast("date"))


_ASKED = ", nt AS (SELECT * FROM named WHERE crop <> 'Tomato'), " + market_sql("nt", "crop, state, district") + """,
   s AS (SELECT DISTINCT crop, state, district FROM named),
   am AS (SELECT s.*, m.current_price, CASE WHEN s.crop <> 'Onion' THEN market_min END AS market_min, CASE WHEN s.crop <> 'Onion' THEN market_max END AS market_max,
     avg_price_7d, avg_price_30d, volatility, dlo, dhi, dav FROM s LEFT JOIN m USING (crop, state, district) JOIN dd USING (crop))"""


@query("scoring_features", with_named(_DEF + _ASKED + f""",
   f AS (SELECT *, coalesce(market_min, dlo) AS lo, coalesce(market_max, dhi) AS hi, coalesce(avg_price_7d, dav) AS w, coalesce(avg_price_30d, dav) AS mo,
     coalesce(volatility, dav * 0.1) AS v, coalesce(current_price, dav) AS p FROM am)
   SELECT crop, state, district, {R('lo')} AS min_price, {R('hi')} AS max_price, {R('w')} AS price_ma_7, {R('mo')} AS price_ma_30, {R('v')} AS price_std_7,
   {R('v')} AS price_volatility, {R('hi - lo')} AS price_range, {R('(hi - lo) / hi')} AS price_range_ratio, {R('mo')} AS seasonal_avg_price,
   {R('(p - w) / w * 100')} AS price_change_7d, {R('(p - mo) / mo * 100')} AS price_change_30d, 196 AS day_of_year, 1 AS is_monsoon FROM f"""))
def scoring_features(spark, sf_dir):
    out = fc.scoring_features(_asked_market(spark, sf_dir)).select(*KEYS, *_SF)
    return rounded(out, **{c: 4 for c in _SF[:-2]})


_MF = ["temperature_2m_max", "rain_days", "price_change_14d", "price_ma_14", "price_std_14", "seasonal_avg", "lat", "lon", "min_price", "max_price", "other"]


@query("default_features_by_market", with_named(_DEF + _ASKED + f""" SELECT crop, state, district, 25.0::DOUBLE AS temperature_2m_max, 0.0::DOUBLE AS rain_days,
   0.0::DOUBLE AS price_change_14d, {R('coalesce(avg_price_7d, dav)')} AS price_ma_14, {R('coalesce(nullif(volatility, 0), dav * 0.1)')} AS price_std_14,
   {R('coalesce(avg_price_30d, dav)')} AS seasonal_avg, 20.0::DOUBLE AS lat, 77.0::DOUBLE AS lon, {R('coalesce(market_min, dlo)')} AS min_price,
   {R('coalesce(avg_price_7d, dav)')} AS max_price, 0.0::DOUBLE AS other FROM am"""))
def default_features_by_market(spark, sf_dir):
    asked = imp.commodity_default_price(_asked_market(spark, sf_dir))
    out = imp.default_features_by_market(asked, _MF).select(*KEYS, *_MF)
    return rounded(out, price_ma_14=4, price_std_14=4, seasonal_avg=4, min_price=4, max_price=4)


def _paths(spark, sf_dir):
    cond = _conditions(spark, sf_dir)
    path = fc.project_moving_averages(cond, lambda a, b: a * 0.6 + b * 0.4)
    return cond, path.withColumn("date", F.date_add(F.lit("2001-08-01").cast("date"), F.col("step")))


_PATHS = f"WITH {_FC}" + _unrolled().replace(" SELECT crop, state, district, 0 AS step", ", path AS (SELECT crop, state, district, 0 AS step", 1) + ")"


@query("forecast_vs_current", _PATHS + f""", x AS (SELECT path.*, current_price AS c FROM path JOIN m USING (crop, state, district))
   SELECT crop, state, district, strftime(DATE '2001-08-01' + step, '%Y-%m-%d') AS label, price, {R('price - c', 3)} AS change,
     {R('(price - c) / c * 100', 3)} AS change_pct FROM x
   UNION ALL SELECT crop, state, district, 'current', current_price, 0, 0 FROM m""")
def forecast_vs_current(spark, sf_dir):
    cond, path = _paths(spark, sf_dir)
    out = fc.forecast_vs_current(rounded(path, price=3), cond, KEYS)
    return rounded(out, change=3, change_pct=3)


@query("target_date_lookup", _PATHS + """ SELECT crop, state, district, (DATE '2001-08-01' + step)::DATE AS date, price FROM path
   WHERE step = length(district) % 7""")
def target_date_lookup(spark, sf_dir):
    cond, path = _paths(spark, sf_dir)
    wanted = cond.select(*KEYS, F.date_add(F.lit("2001-08-01").cast("date"), F.length("district") % 7).alias("wanted_date"))
    return rounded(sf.target_date_lookup(path, wanted, KEYS).select(*KEYS, "date", "price"), price=3)


@query("forecast_quality_checks", _PATHS + """, ask AS (SELECT DISTINCT crop, state, district FROM obs UNION SELECT DISTINCT crop || '?', state, district FROM obs),
   f AS (SELECT crop, state, district, CASE WHEN crop = 'PROMO' AND step = 3 THEN -price ELSE price END AS price FROM path)
   SELECT a.crop, a.state, a.district, (count(f.price) > 0)::INT AS has_predictions, coalesce(bool_and(f.price > 0), false)::INT AS prices_positive,
   (count(f.price) > 0)::INT AS dates_valid, coalesce(bool_and(f.price > 0), false)::INT AS all_passed
   FROM ask a LEFT JOIN f USING (crop, state, district) GROUP BY 1, 2, 3""")
def forecast_quality_checks(spark, sf_dir):
    cond, path = _paths(spark, sf_dir)
    path = path.withColumn("price", F.when((F.col("crop") == "PROMO") & (F.col("step") == 3), -F.col("price")).otherwise(F.col("price")))
    ask = cond.select(F.explode(F.array("crop", F.concat("crop", F.lit("?")))).alias("crop"), "state", "district")
    return fc.forecast_quality_checks(path, ask, KEYS)


_REG = """, n AS (SELECT crop, state, district, count(*) AS c, count(*) FILTER (price > 50000) AS e FROM obs GROUP BY ALL),
   reg AS (SELECT 'commodity' AS level, crop, NULL AS state, NULL AS district FROM n WHERE crop < 'L' GROUP BY crop
     UNION ALL SELECT 'commodity_location', crop, state, district FROM n WHERE e % 2 = 0
     UNION ALL SELECT 'commodity_all', crop, NULL, NULL FROM n WHERE crop = 'PROMO' GROUP BY crop
     UNION ALL SELECT 'legacy', crop, state, district FROM n WHERE c % 3 = 0)"""


@query("resolve_model_level", with_obs(_REG + """ SELECT n.crop, n.state, n.district, CASE
     WHEN EXISTS (SELECT 1 FROM reg r WHERE level = 'commodity' AND r.crop = n.crop) THEN 'commodity'
     WHEN EXISTS (SELECT 1 FROM reg r WHERE level = 'commodity_location' AND r.crop = n.crop AND r.state = n.state AND r.district = n.district) THEN 'commodity_location'
     WHEN EXISTS (SELECT 1 FROM reg r WHERE level = 'commodity_all' AND r.crop = n.crop) THEN 'commodity_all'
     WHEN EXISTS (SELECT 1 FROM reg r WHERE level = 'legacy' AND r.crop = n.crop AND r.state = n.state AND r.district = n.district) THEN 'legacy' END AS model_level FROM n"""))
def resolve_model_level(spark, sf_dir):
    n = materialize(obs(spark, sf_dir).groupBy(*KEYS).agg(F.count("*").alias("c"), F.count_if(F.col("price") > 50000).alias("e")), "sizes")
    none = F.lit(None).cast("string")

    def level(name, df, wide):
        return df.select(F.lit(name).alias("level"), "crop", *[(F.col(c) if wide else none).alias(c) for c in ("state", "district")]).distinct()

    registry = level("commodity", n.filter("crop < 'L'"), False).unionByName(level("commodity_location", n.filter("e % 2 = 0"), True)) \
        .unionByName(level("commodity_all", n.filter("crop = 'PROMO'"), False)).unionByName(level("legacy", n.filter("c % 3 = 0"), True))
    return fc.resolve_model_level(n.select(*KEYS), materialize(registry, "registry"))
