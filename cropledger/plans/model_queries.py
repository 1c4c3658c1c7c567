"""Registered queries: splits, baselines, ensembles, evaluation, learned models, table scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import attribution as at
from ..operators import evaluate as ev
from ..operators import forecast as fc
from ..operators import impute as imp
from ..operators import locations as loc
from ..operators import models as md
from ..operators import series_features as sf
from ..session import materialize
from ..sources.payloads import KEYS as PKS
from ..sources.views import ORDER, SERIES, TIE, named, obs, requests
from .catalog import query
from .clean_queries import _REQ
from .source_queries import PK
from .sqltext import OBS, ORDER as ORDER_SQL, R, with_named

#: What tells the rows of the feature table apart.
PK_COLUMNS = ["crop", "state", "district", "date", "orderkey", "linenumber"]
MODELS = ["naive", "week", "month"]

CUTS = """, cuts AS (SELECT quantile_cont(date - DATE '1970-01-01', 0.7) AS c1, quantile_cont(date - DATE '1970-01-01', 0.8) AS c2 FROM obs),
  cut_obs AS (SELECT obs.*, CASE WHEN date - DATE '1970-01-01' < c1 THEN 'train' WHEN date - DATE '1970-01-01' < c2 THEN 'val' ELSE 'test' END AS split FROM obs, cuts)"""
_W = f"OVER (PARTITION BY crop, state, district ORDER BY {ORDER_SQL}"
SCORED = OBS + CUTS + f""", scored AS (SELECT *, lag(price) {_W}) AS naive, avg(price) {_W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS week,
  avg(price) {_W} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS month FROM cut_obs QUALIFY naive IS NOT NULL),
  melted AS (SELECT split, crop, state, district, {ORDER_SQL}, price AS y, 'naive' AS model, naive AS y_hat FROM scored
    UNION ALL SELECT split, crop, state, district, {ORDER_SQL}, price, 'week', week FROM scored
    UNION ALL SELECT split, crop, state, district, {ORDER_SQL}, price, 'month', month FROM scored),
  tested AS (SELECT * FROM melted WHERE split = 'test')"""


def scored(spark, sf_dir):
    """Actual prices next to three simple forecasts that only look back."""
    o = ev.split_by_date_quantile(obs(spark, sf_dir))
    out = sf.rolling_price_stats(sf.price_lags(o, lags=(1,)), frames=(7, 30), leak_safe=True)
    return out.withColumnsRenamed({"price_lag_1": "naive", "price_ma_7": "week", "price_ma_30": "month"}).filter("naive IS NOT NULL")


def tested(spark, sf_dir):
    """The test rows, melted and written once: the metrics read them several times."""
    keep = list(dict.fromkeys(["split", *SERIES, *ORDER]))
    rows = scored(spark, sf_dir).filter("split = 'test'")
    return ev.melt_predictions(materialize(rows.select(*keep, *MODELS), "tested"), MODELS, keep)


def METRICS(y="y", p="y_hat"):
    return f"""count(*) AS n, {R(f'avg(abs({p} - {y}))')} AS mae, {R(f'sqrt(avg(({p} - {y}) ** 2))')} AS rmse,
      {R(f'avg(abs(({p} - {y}) / ({y} + 1e-6))) * 100')} AS mape, {R(f'1 - sum(({p} - {y}) ** 2) / (count(*) * var_pop({y}))', 6)} AS r2"""


def r_metrics(df, **more):
    return rounded(df, mae=4, rmse=4, mape=4, r2=6, **more)


@query("split_by_date_quantile", f"WITH {OBS}{CUTS} SELECT {PK}, date, price, split FROM cut_obs")
def split_by_date_quantile(spark, sf_dir):
    return ev.split_by_date_quantile(obs(spark, sf_dir)).select(*PKS, "date", "price", "split")


@query("split_by_position", f"""WITH {OBS} SELECT {PK}, date, price, CASE WHEN row_number() OVER (ORDER BY {ORDER_SQL}) <= floor(count(*) OVER () * 0.8)
   THEN 'train' ELSE 'test' END AS split FROM obs""")
def split_by_position(spark, sf_dir):
    return ev.split_by_position(obs(spark, sf_dir), TIE).select(*PKS, "date", "price", "split")


_BASE = f""", tr AS (SELECT * FROM cut_obs WHERE split = 'train'), l30 AS (SELECT price, row_number() OVER (ORDER BY date DESC, orderkey DESC, linenumber DESC,
   partkey DESC, suppkey DESC, price DESC) AS rn FROM tr QUALIFY rn <= 30),
   b AS (SELECT (SELECT avg(price) FROM tr) AS mean, (SELECT price FROM l30 WHERE rn = 1) AS naive_last, (SELECT avg(price) FROM l30) AS moving_average_30,
   (SELECT quantile_cont(price, 0.5) FROM tr) AS seasonal_naive)"""


@query("baseline_values", f"WITH {OBS}{CUTS}{_BASE} SELECT {R('mean')} AS mean, naive_last, {R('moving_average_30')} AS moving_average_30, {R('seasonal_naive')} AS seasonal_naive FROM b")
def baseline_values(spark, sf_dir):
    out = ev.baseline_values(ev.split_by_date_quantile(obs(spark, sf_dir)), ORDER)
    return rounded(out, mean=4, moving_average_30=4, seasonal_naive=4)


@query("baseline_metrics", f"""WITH {OBS}{CUTS}{_BASE}, m AS (SELECT split, price AS y, unnest(['mean', 'naive_last', 'moving_average_30', 'seasonal_naive']) AS model,
   unnest([mean, naive_last, moving_average_30, seasonal_naive]) AS y_hat FROM cut_obs, b WHERE split <> 'train')
   SELECT model, split, {METRICS()} FROM m GROUP BY 1, 2""")
def baseline_metrics(spark, sf_dir):
    return r_metrics(ev.baseline_metrics(ev.split_by_date_quantile(obs(spark, sf_dir)), ORDER))


@query("impute_train_means", f"""WITH {OBS}{CUTS}, g AS (SELECT {PK}, price, split, CASE WHEN linenumber % 3 = 0 THEN NULL ELSE min_price END AS a,
   CASE WHEN orderkey % 4 = 0 THEN NULL ELSE max_price END AS b FROM cut_obs), t AS (SELECT avg(a) AS ma, avg(b) AS mb FROM g WHERE split = 'train')
   SELECT {PK}, price, split, {R('coalesce(a, ma)')} AS a, {R('coalesce(b, mb)')} AS b FROM g, t""")
def impute_train_means(spark, sf_dir):
    g = ev.split_by_date_quantile(obs(spark, sf_dir)).select(
        *PKS, "price", "split", F.when(F.col("linenumber") % 3 != 0, F.col("min_price")).alias("a"),
        F.when(F.col("orderkey") % 4 != 0, F.col("max_price")).alias("b"))
    return rounded(imp.impute_train_means(g, ["a", "b"]), a=4, b=4)


@query("scale_features", f"""WITH {OBS}{CUTS}, t AS (SELECT avg(min_price) AS a, stddev_pop(min_price) AS b, avg(linenumber) AS c, stddev_pop(linenumber) AS d
   FROM cut_obs WHERE split = 'train') SELECT {PK}, price, split, {R('(min_price - a) / b', 6)} AS min_price_scaled, {R('(linenumber - c) / d', 6)} AS linenumber_scaled
   FROM cut_obs, t""")
def scale_features(spark, sf_dir):
    out = ev.scale_features(ev.split_by_date_quantile(obs(spark, sf_dir)), ["min_price", "linenumber"])
    return rounded(out.select(*PKS, "price", "split", "min_price_scaled", "linenumber_scaled"), min_price_scaled=6, linenumber_scaled=6)


_MAE = """, wt AS (SELECT 1 / (avg(abs(naive - price)) + 1e-6) AS w1, 1 / (avg(abs(week - price)) + 1e-6) AS w2, 1 / (avg(abs(month - price)) + 1e-6) AS w3
   FROM scored WHERE split = 'val')"""


@query("ensemble_average", f"WITH {SCORED} SELECT split, {METRICS('price', '((naive + week + month) / 3)')} FROM scored GROUP BY split")
def ensemble_average(spark, sf_dir):
    out = ev.ensemble_average(scored(spark, sf_dir), MODELS).withColumnsRenamed({"price": "y", "ensemble": "y_hat"})
    return r_metrics(ev.metrics(out, ["split"]))


@query("ensemble_weighted", f"""WITH {SCORED}{_MAE}, e AS (SELECT split, price, (w1 * naive + w2 * week + w3 * month) / (w1 + w2 + w3) AS p FROM scored, wt)
   SELECT split, {METRICS('price', 'p')} FROM e GROUP BY split""")
def ensemble_weighted(spark, sf_dir):
    out = ev.ensemble_weighted(scored(spark, sf_dir), MODELS).withColumnsRenamed({"price": "y", "ensemble": "y_hat"})
    return r_metrics(ev.metrics(out, ["split"]))


@query("ensemble_fixed", f"""WITH {SCORED}, e AS (SELECT split, price, (0.4 * naive + 0.6 * week + 0.4 * month) / 1.4 AS p FROM scored)
   SELECT split, {METRICS('price', 'p')} FROM e GROUP BY split""")
def ensemble_fixed(spark, sf_dir):
    out = ev.ensemble_fixed(scored(spark, sf_dir), MODELS, "week").withColumnsRenamed({"price": "y", "ensemble": "y_hat"})
    return r_metrics(ev.metrics(out, ["split"]))


_PER = f", per AS (SELECT model, {METRICS()} FROM tested GROUP BY model)"


@query("leaderboard", f"""WITH {SCORED}{_PER} SELECT *, row_number() OVER (ORDER BY r2 DESC, model)::INT AS rank,
   (row_number() OVER (ORDER BY r2 DESC, model) = 1)::INT AS best_r2, (row_number() OVER (ORDER BY mae, model) = 1)::INT AS lowest_mae FROM per""")
def leaderboard(spark, sf_dir):
    return r_metrics(ev.leaderboard(ev.metrics(tested(spark, sf_dir), ["model"])))


@query("regression_metrics", f"""WITH {SCORED} SELECT model, {METRICS()}, {R('avg(y_hat - y)')} AS mean_error, {R('quantile_cont(y_hat - y, 0.5)')} AS median_error,
   {R('stddev_pop(y_hat - y)')} AS std_error FROM tested GROUP BY model""")
def regression_metrics(spark, sf_dir):
    return r_metrics(ev.regression_metrics(tested(spark, sf_dir)), mean_error=4, median_error=4, std_error=4)


@query("direction_accuracy", f"""WITH {SCORED}, d AS (SELECT model, y - lag(y) OVER s AS dy, y_hat - lag(y_hat) OVER s AS dp FROM tested
   WINDOW s AS (PARTITION BY model, crop, state, district ORDER BY {ORDER_SQL}))
   SELECT model, {R('avg(((dy > 0) = (dp > 0))::INT) * 100')} AS direction_accuracy, count(dy) AS steps FROM d GROUP BY model""")
def direction_accuracy(spark, sf_dir):
    return rounded(ev.direction_accuracy(tested(spark, sf_dir), SERIES, ORDER), direction_accuracy=4)


@query("error_stats", f"""WITH {SCORED} SELECT model, {R('avg(y_hat - y)')} AS mean_error, {R('stddev_pop(y_hat - y)')} AS std_error, {R('max(y_hat - y)', 3)} AS max_over,
   {R('min(y_hat - y)', 3)} AS max_under, {R('quantile_cont(y_hat - y, 0.5)')} AS median_error FROM tested GROUP BY model""")
def error_stats(spark, sf_dir):
    return rounded(ev.error_stats(tested(spark, sf_dir)), mean_error=4, std_error=4, max_over=3, max_under=3, median_error=4)


@query("error_by_price_range", f"""WITH {SCORED}, k AS (SELECT model, abs(y_hat - y) AS e, CASE WHEN y >= 0 AND y < 100 THEN 'Very Low' WHEN y < 500 THEN 'Low'
   WHEN y < 2000 THEN 'Medium' WHEN y < 10000 THEN 'High' ELSE 'Very High' END AS price_range FROM tested)
   SELECT model, price_range, {R('avg(e)')} AS mae, count(*) AS records FROM k GROUP BY 1, 2""")
def error_by_price_range(spark, sf_dir):
    return rounded(ev.error_by_price_range(tested(spark, sf_dir)), mae=4)


@query("abs_error_percentiles", f"""WITH {SCORED} SELECT model, p AS percentile, {R('quantile_cont(abs(y_hat - y), p / 100)', 3)} AS abs_error
   FROM tested, (VALUES (10), (25), (50), (75), (90), (95), (99)) v(p) GROUP BY model, p""".replace(
       "quantile_cont(abs(y_hat - y), p / 100)", "list_extract(quantile_cont(abs(y_hat - y), [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]), list_position([10, 25, 50, 75, 90, 95, 99], p))"))
def abs_error_percentiles(spark, sf_dir):
    return rounded(ev.abs_error_percentiles(tested(spark, sf_dir)), abs_error=3)


@query("kfold_mean_scores", f"""WITH {OBS}, f AS (SELECT *, ((orderkey * 31 + linenumber * 7 + partkey) % 5)::INT AS fold FROM obs),
   o AS (SELECT crop, state, fold, sum(price) AS s, count(*) AS c FROM f GROUP BY ALL), t AS (SELECT crop, state, sum(s) AS ts, sum(c) AS tc FROM o GROUP BY ALL),
   x AS (SELECT f.fold, price AS y, (ts - s) / (tc - c) AS p FROM f JOIN o USING (crop, state, fold) JOIN t USING (crop, state)),
   r AS (SELECT fold, count(*) AS n, 1 - sum((p - y) ** 2) / (count(*) * var_pop(y)) AS r2 FROM x GROUP BY fold)
   SELECT fold, n, {R('r2', 6)} AS r2, {R('avg(r2) OVER ()', 6)} AS mean_r2, {R('stddev_pop(r2) OVER ()', 6)} AS std_r2 FROM r""")
def kfold_mean_scores(spark, sf_dir):
    folded = obs(spark, sf_dir).withColumn("fold", F.expr("(orderkey * 31 + linenumber * 7 + partkey) % 5").cast("int"))
    return rounded(ev.kfold_mean_scores(folded, ["crop", "state"]), r2=6, mean_r2=6, std_r2=6)


@query("timeseries_mean_scores", f"""WITH {OBS}, p AS (SELECT price AS y, row_number() OVER (ORDER BY {ORDER_SQL}) - 1 AS i, count(*) OVER () AS n FROM obs),
   k AS (SELECT *, n // 6 AS ts FROM p), f AS (SELECT y, i, n, ts, unnest(range(0, 5)) AS fold FROM k),
   m AS (SELECT fold, avg(y) AS mean, count(*) AS train_rows FROM f WHERE i < n - (5 - fold) * ts GROUP BY fold),
   t AS (SELECT f.fold, f.y, mean, train_rows FROM f JOIN m USING (fold) WHERE i >= n - (5 - f.fold) * ts AND i < n - (4 - f.fold) * ts)
   SELECT (fold + 1)::INT AS fold, train_rows, count(*) AS test_rows, {R('1 - sum((y - mean) ** 2) / (count(*) * var_pop(y))', 6)} AS r2 FROM t GROUP BY 1, 2""")
def timeseries_mean_scores(spark, sf_dir):
    return rounded(ev.timeseries_mean_scores(obs(spark, sf_dir), TIE), r2=6)


@query("compare_model_runs", f"""WITH {SCORED}, per AS (SELECT split, model, 1 - sum((y_hat - y) ** 2) / (count(*) * var_pop(y)) AS r2 FROM melted GROUP BY ALL),
   o AS (SELECT model, r2 FROM per WHERE split = 'val' ORDER BY r2 DESC, model DESC LIMIT 1), n AS (SELECT model, r2 FROM per WHERE split = 'test' ORDER BY r2 DESC, model DESC LIMIT 1)
   SELECT o.model AS old_model, {R('o.r2', 6)} AS old_r2, n.model AS new_model, {R('n.r2', 6)} AS new_r2,
   {R('CASE WHEN o.r2 = 0 THEN 0 ELSE (n.r2 - o.r2) / abs(o.r2) * 100 END', 4)} AS r2_improvement_pct FROM o, n""")
def compare_model_runs(spark, sf_dir):
    per = materialize(ev.metrics(ev.melt_predictions(scored(spark, sf_dir), MODELS, ["split"]), ["split", "model"]), "run-metrics")
    out = ev.compare_model_runs(per.filter("split = 'val'"), per.filter("split = 'test'"))
    return rounded(out, old_r2=6, new_r2=6, r2_improvement_pct=4)


@query("retrain_due", f"""WITH {OBS}, m AS (SELECT DISTINCT crop, state, district FROM obs UNION SELECT DISTINCT 'NEW', state, district FROM obs),
   r AS (SELECT crop, state, district, max(date - (orderkey % 90)::INT) AS training_date FROM obs GROUP BY ALL) SELECT m.*, training_date, (DATE '2001-10-15' - training_date)::INT AS days_since,
   coalesce((DATE '2001-10-15' - training_date >= 30), true)::INT AS due FROM m LEFT JOIN r USING (crop, state, district)""")
def retrain_due(spark, sf_dir):
    o = obs(spark, sf_dir)
    runs = o.withColumn("training_date", F.date_sub("date", (F.col("orderkey") % 90).cast("int")))
    series = o.select(*SERIES).distinct()
    fresh = series.withColumn("crop", F.lit("NEW")).distinct()  # series that no run has seen
    return ev.retrain_due(series.union(fresh), runs, SERIES, "2001-10-15")


# ---- fits and scoring

FITS = """, fits AS (SELECT state, district, crop, count(*) AS samples, regr_slope(price, date - DATE '1995-01-01') AS slope,
   regr_intercept(price, date - DATE '1995-01-01') AS intercept, regr_r2(price, date - DATE '1995-01-01') AS r2 FROM {0} GROUP BY ALL)"""


@query("fit_per_series", f"WITH {OBS}{FITS.format('obs')} SELECT state, district, crop, samples, {R('slope', 6)} AS slope, {R('intercept')} AS intercept, {R('r2', 8)} AS r2 FROM fits")
def fit_per_series(spark, sf_dir):
    return rounded(md.fit_per_series(obs(spark, sf_dir)), slope=6, intercept=4, r2=8)


@query("model_fleet_summary", f"""WITH {OBS}{FITS.format('obs')}, e AS (SELECT state, district, crop, avg(abs((intercept + slope * (date - DATE '1995-01-01') - price) / (price + 1e-6))) * 100 AS mape
   FROM obs JOIN fits USING (state, district, crop) GROUP BY ALL)
   SELECT count(*) AS total, count(slope) AS trained, count(*) - count(slope) AS failed, {R('avg(r2)', 6)} AS average_r2, {R('avg(mape)')} AS average_mape
   FROM fits LEFT JOIN e USING (state, district, crop)""")
def model_fleet_summary(spark, sf_dir):
    o = obs(spark, sf_dir)
    return rounded(md.model_fleet_summary(o, materialize(md.fit_per_series(o), "series-fits")), average_r2=6, average_mape=4)


@query("fit_per_commodity")
def fit_per_commodity(spark, sf_dir):
    return md.fit_per_commodity(obs(spark, sf_dir))


def _series_fits(spark, sf_dir):
    return materialize(md.fit_per_series(named(spark, sf_dir)), "series-fits")


def _score_keyed(fits):
    """Score requests whose names may differ in case and blanks."""
    from ..functions.columns import name_key

    keys = [f"{c}_key" for c in ("state", "district", "crop")]
    keyed = fits.withColumns({f"{c}_key": name_key(c) for c in ("state", "district", "crop")}).drop("state", "district", "crop")

    def score(valid):
        asked = valid.withColumns({f"{c}_key": name_key(c) for c in ("state", "district", "crop")}).withColumn("date", F.col("target_date"))
        return md.score_series(asked, keyed, keys).drop(*keys, "date")

    return score


@query("score_batch", with_named(_REQ + FITS.format("named") + f""" SELECT q.crop, q.state, q.district, kind,
   {R("intercept + slope * (DATE '2001-06-30' - DATE '1995-01-01')", 3)} AS prediction, 'series_line' AS model,
   CASE WHEN kind <> 'known' THEN 'No data for ' || q.crop || ' in ' || q.district || ', ' || q.state END AS error,
   CASE WHEN kind = 'known' THEN 'high' END AS confidence
   FROM req q LEFT JOIN fits f ON lower(f.crop) = lower(trim(q.crop)) AND lower(f.state) = lower(trim(q.state)) AND lower(f.district) = lower(trim(q.district))"""))
def score_batch(spark, sf_dir):
    out = fc.score_batch(requests(spark, sf_dir), named(spark, sf_dir), _score_keyed(_series_fits(spark, sf_dir)), "series_line")
    return rounded(out.drop("target_date"), prediction=3)


@query("score_commodity_grid", with_named(FITS.format("named") + f""", g AS (SELECT state, district, crop, CAST(unnest(generate_series(DATE '2001-06-01', DATE '2001-06-30', INTERVAL 1 DAY)) AS DATE) AS date
   FROM (SELECT DISTINCT state, district, crop FROM named WHERE crop = 'Wheat'))
   SELECT g.*, {R("intercept + slope * (date - DATE '1995-01-01')", 3)} AS prediction FROM g JOIN fits USING (state, district, crop)"""))
def score_commodity_grid(spark, sf_dir):
    grid = loc.cross_location_dates(named(spark, sf_dir), "wheat", "2001-06-01", "2001-06-30")
    return rounded(md.score_series(grid, _series_fits(spark, sf_dir)), prediction=3)


@query("score_location_grid", with_named(FITS.format("named") + f""", g AS (SELECT state, district, crop, CAST(unnest(generate_series(DATE '2001-06-01', DATE '2001-06-10', INTERVAL 1 DAY)) AS DATE) AS date
   FROM (SELECT DISTINCT state, district, crop FROM named WHERE state = 'Kerala' AND district = 'Ernakulam'))
   SELECT g.*, {R("intercept + slope * (date - DATE '1995-01-01')", 3)} AS prediction FROM g JOIN fits USING (state, district, crop)"""))
def score_location_grid(spark, sf_dir):
    grid = loc.cross_crop_dates(named(spark, sf_dir), "Kerala", "Ernakulam", "2001-06-01", "2001-06-10")
    return rounded(md.score_series(grid, _series_fits(spark, sf_dir)), prediction=3)


# ---- learned models

@query("train_boosted_trees")
def train_boosted_trees(spark, sf_dir):
    frame = md.training_frame(obs(spark, sf_dir))
    return md.score(md.train_boosted_trees(frame), frame, "boosted_trees")


@query("train_trees_early_stop")
def train_trees_early_stop(spark, sf_dir):
    frame = md.training_frame(obs(spark, sf_dir))
    return md.score_booster(md.train_trees_early_stop(frame), frame, "trees_early_stop")


@query("train_perceptron")
def train_perceptron(spark, sf_dir):
    return md.train_perceptron(md.training_frame(obs(spark, sf_dir)))


@query("kfold_scores")
def kfold_scores(spark, sf_dir):
    frame = md.training_frame(obs(spark, sf_dir))
    return md.kfold_scores(ev.with_fold(frame, PK_COLUMNS))


@query("timeseries_cv_scores")
def timeseries_cv_scores(spark, sf_dir):
    return md.timeseries_cv_scores(md.training_frame(obs(spark, sf_dir)), PK_COLUMNS)


@query("shap_importance")
def shap_importance(spark, sf_dir):
    frame = md.training_frame(obs(spark, sf_dir))
    return at.shap_importance(md.train_trees_early_stop(frame), frame.filter("split = 'test'"))


@query("train_scaled_linear")
def train_scaled_linear(spark, sf_dir):
    return md.train_scaled_linear(md.training_frame(obs(spark, sf_dir)))


@query("feature_importance")
def feature_importance(spark, sf_dir):
    frame = md.training_frame(obs(spark, sf_dir))
    return md.feature_importance(md.train_boosted_trees(frame), frame)


@query("permutation_importance")
def permutation_importance(spark, sf_dir):
    frame = md.training_frame(obs(spark, sf_dir))
    return md.permutation_importance(md.train_boosted_trees(frame), frame)
