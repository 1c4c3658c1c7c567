"""Learned models and closed-form fits per group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..session import materialize, maybe_broadcast, release, spread
from . import boosting as bo
from . import calendar as cal
from . import perceptron as pc
from .evaluate import metric_columns, metrics, scale_features, split_by_date_quantile, with_expanding_fold
from .impute import impute_train_means, numeric_columns
from .panel_features import NOT_FEATURES, engineer_all_features
from .weather import weather

#: Rounds without a better validation error after which boosting ends.
PATIENCE = 20
#: Train rows from which on the boosted trees' input is dealt evenly over the cores.
SPREAD_ROWS = 100_000


def inputs_of(frame: DataFrame) -> list[str]:
    """All numeric columns that are features."""
    return numeric_columns(frame, NOT_FEATURES)


def training_frame(panel: DataFrame, inputs: Sequence[str] | None = None) -> DataFrame:
    """Leak-safe inputs (all features without a choice), date split, train-mean imputation. Written once: trainers read it many
    times. An input without a value in any train row is 0."""
    f = engineer_all_features(panel, weather(panel), impute=False, leak_safe=True)
    inputs = list(inputs or inputs_of(f))
    rows = f.select("crop", "state", "district", "date", "orderkey", "linenumber", "price", *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in inputs])
    written = materialize(rows, "model-inputs")
    split = split_by_date_quantile(written).select("crop", "state", "district", "date", "orderkey", "linenumber", "price", "split", *inputs)
    training = materialize(impute_train_means(split, inputs).fillna(0.0, inputs), "training")
    release(written)
    return training


def with_vector(df: DataFrame, inputs: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(inputs), outputCol="features").transform(df)


def booster(trees: int, **more) -> GBTRegressor:
    return GBTRegressor(featuresCol="features", labelCol="price", predictionCol="prediction", maxIter=trees, maxDepth=6,
                        stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42, **more)


def train_boosted_trees(frame: DataFrame, trees: int = 200, inputs: Sequence[str] | None = None) -> GBTRegressionModel:
    """MLlib's trees. A level of a tree is a pass over the train rows, which waits for its slowest task: they are dealt evenly."""
    inputs = list(inputs or inputs_of(frame))
    train = frame.filter("split = 'train'").select("price", *inputs)
    if train.count() >= SPREAD_ROWS:
        train = spread(train)
    return booster(trees).fit(with_vector(train, inputs))


def train_trees_early_stop(frame: DataFrame, trees: int = 200, inputs: Sequence[str] | None = None, patience: int = PATIENCE) -> bo.Booster:
    """Leaf-wise trees. Training ends when the validation rows have not improved for ``patience`` rounds; the best round is kept."""
    code = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    params = bo.Params(trees=trees, rate=0.1, depth=6, leaves=31, least_rows=20, inputs=0.8, patience=patience)
    (model,), _ = bo.fit(frame.withColumn("_use", code), inputs or inputs_of(frame), "price", "_use", [{0: bo.TRAIN, 1: bo.VALIDATE}], params)
    return model


def score_booster(model: bo.Booster, frame: DataFrame, name: str) -> DataFrame:
    """Metrics of leaf-wise trees per split."""
    out = bo.predict(model, frame.select("split", "price", *model.inputs))
    return metrics(out.select("split", F.lit(name).alias("model"), F.col("price").alias("y"), F.col("prediction").alias("y_hat")), ["model", "split"])


def train_perceptron(frame: DataFrame, inputs: Sequence[str] | None = None, **more) -> DataFrame:
    """Dense member on scaled inputs: metrics per split."""
    inputs = inputs or inputs_of(frame)
    names = [f"{c}_scaled" for c in inputs]
    scaled = materialize(scale_features(frame, inputs).select("split", "price", *names), "scaled")
    out = pc.predict(pc.fit(scaled, names, **more), scaled)
    return metrics(out.select("split", F.lit("perceptron").alias("model"), F.col("price").alias("y"), F.col("prediction").alias("y_hat")), ["model", "split"])


#: Cross-validation fits 100 trees a fold, of depth 6, each leaf of one row at least.
CV_PARAMS = bo.Params(trees=100, rate=0.3, depth=6, leaves=64, least_rows=1, penalty=1.0)


def kfold_scores(frame: DataFrame, inputs: Sequence[str] | None = None, folds: int = 5, params: bo.Params = CV_PARAMS) -> DataFrame:
    """R2 per fold of trees fitted on all other folds; needs ``fold`` from 0 on. All folds are trained in the same passes, on
    all their rows."""
    roles = [{c: bo.TRAIN for c in range(folds) if c != f} for f in range(folds)]
    models, blocks = bo.fit(frame, inputs or inputs_of(frame), "price", "fold", roles, params)
    per = metrics(bo.block_predictions(blocks, models, [{f} for f in range(folds)]).withColumnRenamed("model", "fold"), ["fold"]).select("fold", "n", "r2")
    per = materialize(per, "fold-scores")
    over = per.agg(F.struct(F.avg("r2").alias("m"), F.stddev_pop("r2").alias("s"))).scalar()
    return per.withColumns({"mean_r2": over["m"], "std_r2": over["s"]})


def timeseries_cv_scores(frame: DataFrame, tie: Sequence[str], inputs: Sequence[str] | None = None, folds: int = 5, params: bo.Params = CV_PARAMS) -> DataFrame:
    """Expanding folds over date-ordered rows: trees fitted on everything before a fold, scored on the fold."""
    inputs = list(inputs or inputs_of(frame))
    placed = with_expanding_fold(frame, tie, folds).withColumn("_use", F.col("fold") + 1)
    roles = [{c: bo.TRAIN for c in range(f + 1)} for f in range(folds)]
    models, blocks = bo.fit(placed, inputs, "price", "_use", roles, params)
    scored = bo.block_predictions(blocks, models, [{f + 1} for f in range(folds)]).withColumnRenamed("model", "fold")
    before = Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)  # one row per fold
    rows = placed.groupBy("fold").agg(F.count("price").alias("c")).select("fold", F.sum("c").over(before).alias("train_rows"))
    out = metrics(scored, ["fold"]).join(rows, "fold")
    return out.select((F.col("fold") + 1).alias("fold"), "train_rows", F.col("n").alias("test_rows"), "r2")


def score(model, frame: DataFrame, name: str, inputs: Sequence[str] | None = None) -> DataFrame:
    """Metrics of a fitted model per split."""
    out = model.transform(with_vector(frame, inputs or inputs_of(frame))).select("split", F.lit(name).alias("model"), F.col("price").alias("y"), F.col("prediction").alias("y_hat"))
    return metrics(out, ["model", "split"])


def train_scaled_linear(frame: DataFrame, inputs: Sequence[str] | None = None) -> DataFrame:
    """Linear member on scaled inputs: metrics per split."""
    inputs = inputs or inputs_of(frame)
    scaled = scale_features(frame, inputs)
    names = [f"{c}_scaled" for c in inputs]
    model = LinearRegression(featuresCol="features", labelCol="price", regParam=0.01).fit(with_vector(scaled.filter("split = 'train'"), names))
    return score(model, scaled, "scaled_linear", names)


def feature_importance(model: GBTRegressionModel, frame: DataFrame, inputs: Sequence[str] | None = None, top: int = 20) -> DataFrame:
    values = [(n, float(v)) for n, v in zip(inputs or inputs_of(frame), model.featureImportances.toArray())]
    return frame.sparkSession.createDataFrame(values, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)


def permutation_importance(model, frame: DataFrame, inputs: Sequence[str] | None = None, sample: int = 1000) -> DataFrame:
    """Rise of the absolute error when one input is shuffled, on a fixed sample of the test rows.

    The sample is a feature of the method: attribution looks at ``sample`` rows.
    """
    inputs = inputs or inputs_of(frame)
    key = F.xxhash64("crop", "state", "district", "date", "orderkey", "linenumber")
    rows = frame.filter("split = 'test'").withColumn("h", key).orderBy("h").limit(sample)
    rows = materialize(rows.select("price", "h", *inputs), "sample")
    ranked = rows.select(F.array_sort(F.collect_list(F.struct("h", "price", *inputs))).alias("r"))  # at most ``sample`` entries
    # Each entry's partner is the entry of the same rank by a second hash: a permutation of all entries.
    again = F.array_sort(F.transform("r", lambda x: F.struct(F.xxhash64(x["h"], F.lit("again")).alias("k"), x.alias("x"))))
    one = ranked.withColumn("o", again).select("o", F.posexplode("r").alias("i", "x"))
    other = F.get("o", F.col("i"))["x"]
    pairs = one.select("x", other.alias("other"), F.explode(F.array(*[F.lit(f) for f in ["", *inputs]])).alias("feature"))
    long = pairs.select("feature", F.col("x.price").alias("price"), *[
        F.when(F.col("feature") == c, F.col("other")[c]).otherwise(F.col("x")[c]).alias(c) for c in inputs])
    scored = model.transform(with_vector(long, inputs)).groupBy("feature").agg(F.avg(F.abs(F.col("prediction") - F.col("price"))).alias("mae"))
    base = scored.filter("feature = ''").select("mae").scalar()
    return scored.filter("feature <> ''").select("feature", (F.col("mae") - base).alias("mae_increase")).orderBy(F.desc("mae_increase"), "feature")


# ---- closed-form fits

SIMPLE_INPUTS = ["min_price", "max_price", "weekday", "month"]


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Coefficients from each group's moments: one small row per group."""
    names = SIMPLE_INPUTS
    for pdf in batches:
        out = []
        for _, r in pdf.iterrows():
            a = np.array([[r[f"c_{x}_{y}"] for y in names] for x in names])
            b = np.array([r[f"c_{x}_y"] for x in names])
            w = np.linalg.lstsq(a, b, rcond=1e-12)[0]
            icpt = r["m_y"] - float(sum(wi * r[f"m_{x}"] for wi, x in zip(w, names)))
            out.append((r["crop"], r["train_rows"], icpt, *map(float, w)))
        yield pd.DataFrame(out, columns=["crop", "train_rows", "intercept", *[f"w_{x}" for x in names]])


def fit_per_commodity(panel: DataFrame) -> DataFrame:
    """Least squares per crop on four inputs, first 80 % of its dates, metrics on the rest.

    Only means and covariances leave the map tasks, so a crop with most of the rows costs no more
    than a rare one.
    """
    base = cal.basic_calendar(panel)
    cut = quantiles(base.select("crop", F.unix_date("date").alias("day")), ["crop"], "day", [0.8]).select("crop", F.col("q")[0].alias("cut"))
    rows = base.join(cut, "crop").withColumn("is_train", F.unix_date("date") < F.col("cut")).select(
        "crop", "is_train", F.col("price").alias("y"), *[F.col(c).cast("double").alias(c) for c in SIMPLE_INPUTS])
    aggs = [F.count("*").alias("train_rows"), F.avg("y").alias("m_y")]
    for x in SIMPLE_INPUTS:
        aggs += [F.avg(x).alias(f"m_{x}"), F.covar_pop(x, "y").alias(f"c_{x}_y")]
        aggs += [F.covar_pop(x, z).alias(f"c_{x}_{z}") for z in SIMPLE_INPUTS]
    moments = rows.filter("is_train").groupBy("crop").agg(*aggs)
    schema = "crop string, train_rows long, intercept double, " + ", ".join(f"w_{x} double" for x in SIMPLE_INPUTS)
    fits = materialize(moments.mapInPandas(_solve, schema), "crop-fits")
    guess = F.col("intercept")
    for x in SIMPLE_INPUTS:
        guess = guess + F.col(f"w_{x}") * F.col(x)
    scored = rows.filter("NOT is_train").join(maybe_broadcast(fits), "crop").withColumn("y_hat", guess)
    return metrics(scored, ["crop", "train_rows"])


def day_number(date: Column | str) -> Column:
    return F.datediff(date, F.lit("1995-01-01").cast("date")).cast("double")


def fit_per_series(panel: DataFrame, keys: Sequence[str] = ("state", "district", "crop")) -> DataFrame:
    """Straight line of price over time per series."""
    x = day_number("date")
    return panel.withColumn("x", x).groupBy(*keys).agg(
        F.count("*").alias("samples"), F.regr_slope("price", "x").alias("slope"), F.regr_intercept("price", "x").alias("intercept"),
        F.regr_r2("price", "x").alias("r2"))


def score_series(df: DataFrame, fits: DataFrame, keys: Sequence[str] = ("state", "district", "crop")) -> DataFrame:
    """Add ``prediction`` from the series' line; NULL where no line could be fitted."""
    small = maybe_broadcast(fits.select(*keys, "slope", "intercept"))
    return df.join(small, list(keys), "left").withColumn("prediction", F.col("intercept") + F.col("slope") * day_number("date")).drop("slope", "intercept")


def model_fleet_summary(panel: DataFrame, fits: DataFrame, keys: Sequence[str] = ("state", "district", "crop")) -> DataFrame:
    """How many series models exist, how many failed, mean R2 where defined and mean MAPE."""
    scored = score_series(panel, fits, keys).withColumnsRenamed({"price": "y", "prediction": "y_hat"})
    mape = scored.groupBy(*keys).agg(metric_columns()["mape"].alias("mape"))
    return fits.join(mape, list(keys), "left").agg(
        F.count("*").alias("total"), F.count("slope").alias("trained"), F.count_if(F.col("slope").isNull()).alias("failed"),
        F.avg(F.nanvl("r2", F.lit(None))).alias("average_r2"), F.avg("mape").alias("average_mape"))
