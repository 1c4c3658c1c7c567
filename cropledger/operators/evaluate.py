"""Splits, baselines, ensembles and model evaluation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import EPS, one_row
from ..functions.quantiles import quantiles
from ..plans.series import global_position
from .series_features import direction_of_change

RANGES = [("Very Low", 0.0, 100.0), ("Low", 100.0, 500.0), ("Medium", 500.0, 2000.0), ("High", 2000.0, 10000.0),
          ("Very High", 10000.0, float("inf"))]
PERCENTILES = (10, 25, 50, 75, 90, 95, 99)


def split_by_date_quantile(df: DataFrame, train: float = 0.7, val: float = 0.8) -> DataFrame:
    """Cut the rows at two quantiles of their dates; the cuts reach the rows as literals."""
    days = df.select(F.unix_date("date").alias("day"))
    row = quantiles(days, [], "day", [train, val]).select("q").first()
    cuts = [F.lit(q) for q in (row["q"] if row else (None, None))]
    day = F.unix_date("date")
    return df.withColumn("split", F.when(day < cuts[0], "train").when(day < cuts[1], "val").otherwise("test"))


def split_by_position(df: DataFrame, tie: Sequence[str], train: float = 0.8) -> DataFrame:
    """The last rows in date order are the test rows."""
    placed = global_position(df, "date", tie)
    return placed.withColumn("split", F.when(F.col("position") <= F.floor(F.col("total") * train), "train").otherwise("test")).drop("position", "total")


def baseline_values(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row of constant baselines from the train rows. ``seasonal_naive`` is the train median."""
    train = df.filter("split = 'train'")
    last = train.orderBy(*[F.desc(c) for c in order]).limit(30)
    newest = last.agg(F.struct(F.max_by("price", F.struct(*order)).alias("last"), F.avg("price").alias("ma"))).scalar()
    median = quantiles(train, [], "price", [0.5]).select(F.col("q")[0]).scalar()
    return train.agg(F.avg("price").alias("mean")).select(
        "mean", newest["last"].alias("naive_last"), newest["ma"].alias("moving_average_30"), median.alias("seasonal_naive"))


def metric_columns(y: str = "y", p: str = "y_hat") -> dict[str, Column]:
    """Metrics as aggregates of one pass; NULL pairs do not count."""
    both = F.col(y).isNotNull() & F.col(p).isNotNull()
    yy, err = F.when(both, F.col(y)), F.when(both, F.col(p) - F.col(y))
    sse, n = F.sum(err * err), F.count(err)
    return {
        "n": n, "mae": F.avg(F.abs(err)), "rmse": F.sqrt(F.avg(err * err)), "mape": F.avg(F.abs(err / (yy + EPS))) * 100,
        "r2": F.when(F.var_pop(yy) > 0, 1 - sse / (n * F.var_pop(yy))),
    }


def metrics(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    return scored.groupBy(*keys).agg(*[c.alias(n) for n, c in metric_columns().items()])


def melt_predictions(wide: DataFrame, models: Sequence[str], keep: Sequence[str], actual: str = "price") -> DataFrame:
    """Prediction columns to rows (model, y, y_hat)."""
    entries = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("y_hat")) for m in models])
    return wide.select(*keep, F.col(actual).alias("y"), F.inline(entries))


def baseline_metrics(df: DataFrame, order: Sequence[str]) -> DataFrame:
    values = baseline_values(df, order)
    held = values.select(F.struct("*")).scalar()
    models = values.columns
    wide = df.filter("split <> 'train'").withColumns({m: held[m] for m in models})
    return metrics(melt_predictions(wide, models, ["split"]), ["model", "split"])


def scale_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """z-scores with mean and population deviation of the train rows; a constant column gives 0."""
    train = lambda c: F.when(F.col("split") == "train", F.col(c))
    if not columns:
        return df
    s = one_row(df.agg(*[x for c in columns for x in (F.avg(train(c)).alias(f"{c}_m"), F.stddev_pop(train(c)).alias(f"{c}_s"))]))
    return df.withColumns({
        f"{c}_scaled": (F.col(c) - s[f"{c}_m"]) / F.when(s[f"{c}_s"] > 0, s[f"{c}_s"]).otherwise(1.0) for c in columns})


def ensemble_average(df: DataFrame, models: Sequence[str]) -> DataFrame:
    total = F.col(models[0])
    for m in models[1:]:
        total = total + F.col(m)
    return df.withColumn("ensemble", total / len(models))


def _weighted(models: Sequence[str], weights: Mapping[str, Column]) -> Column:
    total, mass = F.lit(0.0), F.lit(0.0)
    for m in models:
        total, mass = total + weights[m] * F.col(m), mass + weights[m]
    return total / mass


def ensemble_weighted(df: DataFrame, models: Sequence[str], actual: str = "price") -> DataFrame:
    """Weights are the inverse validation errors."""
    val = F.col("split") == "val"
    mae = df.agg(F.struct(*[F.avg(F.when(val, F.abs(F.col(m) - F.col(actual)))).alias(m) for m in models])).scalar()
    return df.withColumn("ensemble", _weighted(models, {m: 1 / (mae[m] + EPS) for m in models}))


def ensemble_fixed(df: DataFrame, models: Sequence[str], favourite: str) -> DataFrame:
    return df.withColumn("ensemble", _weighted(models, {m: F.lit(0.6 if m == favourite else 0.4) for m in models}))


def leaderboard(per_model: DataFrame) -> DataFrame:
    """Models by R2 with flags for the best R2 and the lowest MAE. One row per model."""
    w = Window.orderBy(F.desc("r2"), "model")
    low = per_model.agg(F.min(F.struct("mae", "model"))).scalar()
    return per_model.withColumn("rank", F.row_number().over(w)).withColumns({
        "best_r2": (F.col("rank") == 1).cast("int"), "lowest_mae": (F.col("model") == low["model"]).cast("int")})


def regression_metrics(scored: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    keys = list(keys)
    err = scored.withColumn("err", F.col("y_hat") - F.col("y"))
    med = quantiles(err, keys, "err", [0.5]).select(*keys, F.col("q")[0].alias("median_error"))
    out = err.groupBy(*keys).agg(*[c.alias(n) for n, c in metric_columns().items()],
                                 F.avg("err").alias("mean_error"), F.stddev_pop("err").alias("std_error"))
    return out.join(med, keys)


def direction_accuracy(scored: DataFrame, series: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Percent of steps with equal direction per model; 0 without a step."""
    moved = direction_of_change(scored, ["model", *series], order)
    same = (F.col("actual_sign") > 0) == (F.col("predicted_sign") > 0)
    return moved.groupBy("model").agg(
        (F.coalesce(F.avg(same.cast("int")), F.lit(0.0)) * 100).alias("direction_accuracy"), F.count(same).alias("steps"))


def error_stats(scored: DataFrame) -> DataFrame:
    err = scored.withColumn("err", F.col("y_hat") - F.col("y"))
    med = quantiles(err, ["model"], "err", [0.5]).select("model", F.col("q")[0].alias("median_error"))
    return err.groupBy("model").agg(
        F.avg("err").alias("mean_error"), F.stddev_pop("err").alias("std_error"), F.max("err").alias("max_over"),
        F.min("err").alias("max_under")).join(med, "model")


def error_by_price_range(scored: DataFrame) -> DataFrame:
    label = None
    for name, low, high in RANGES:
        test = (F.col("y") >= low) & (F.col("y") < high)
        label = F.when(test, name) if label is None else label.when(test, name)
    return scored.withColumn("price_range", label).filter("price_range IS NOT NULL").groupBy("model", "price_range").agg(
        F.avg(F.abs(F.col("y_hat") - F.col("y"))).alias("mae"), F.count("*").alias("records"))


def abs_error_percentiles(scored: DataFrame) -> DataFrame:
    err = scored.withColumn("err", F.abs(F.col("y_hat") - F.col("y")))
    q = quantiles(err, ["model"], "err", [p / 100 for p in PERCENTILES])
    return q.select("model", F.inline(F.arrays_zip(F.array(*[F.lit(p) for p in PERCENTILES]).alias("percentile"), F.col("q").alias("abs_error"))))


def with_fold(df: DataFrame, keys: Sequence[str], folds: int = 5) -> DataFrame:
    """Fold from a hash of the row's key: the same rows fold alike on every run."""
    return df.withColumn("fold", F.pmod(F.xxhash64(*keys), F.lit(folds)).cast("int"))


def kfold_mean_scores(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """R2 per fold of the group mean over the other folds; needs ``fold``.

    Group totals minus the fold's own totals give every out-of-fold mean, so rows are read once more
    only to score them.
    """
    keys = list(keys)
    own = df.groupBy(*keys, "fold").agg(F.sum("price").alias("s"), F.count("price").alias("c"))
    every = own.groupBy(*keys).agg(F.sum("s").alias("ts"), F.sum("c").alias("tc"))
    means = own.join(every, keys).select(*keys, "fold", F.try_divide(F.col("ts") - F.col("s"), F.col("tc") - F.col("c")).alias("y_hat"))
    scored = df.withColumn("y", F.col("price")).join(means, [*keys, "fold"])
    per = metrics(scored, ["fold"]).select("fold", "n", "r2")
    over = per.agg(F.struct(F.avg("r2").alias("m"), F.stddev_pop("r2").alias("s"))).scalar()
    return per.withColumns({"mean_r2": over["m"], "std_r2": over["s"]})


def with_expanding_fold(df: DataFrame, tie: Sequence[str], folds: int = 5) -> DataFrame:
    """``fold`` 0 to folds - 1 by position in date order, folds of one size; -1 for what lies before the first."""
    placed = global_position(df, "date", tie)
    size = F.floor(F.col("total") / (folds + 1))
    block = F.floor((F.col("position") - 1 - (F.col("total") - folds * size)) / size)
    return placed.withColumn("fold", F.greatest(block, F.lit(-1)).cast("int")).drop("position", "total")


def timeseries_mean_scores(df: DataFrame, tie: Sequence[str], folds: int = 5) -> DataFrame:
    """Expanding folds over date-ordered rows, scored by the mean of everything before the fold."""
    rows = with_expanding_fold(df, tie, folds).select(F.col("price").alias("y"), "fold")
    sums = rows.groupBy("fold").agg(F.sum("y").alias("s"), F.count("y").alias("c"))
    before = Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)  # one row per fold
    means = sums.select("fold", (F.sum("s").over(before) / F.sum("c").over(before)).alias("y_hat"), F.sum("c").over(before).alias("train_rows"))
    scored = rows.filter("fold >= 0").join(means, "fold")
    return metrics(scored, ["fold", "train_rows"]).select((F.col("fold") + 1).alias("fold"), "train_rows", F.col("n").alias("test_rows"), "r2")


def compare_model_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Best model of each run by R2 and the improvement in percent of the old."""
    def best(df: DataFrame) -> Column:
        return df.agg(F.max_by(F.struct("model", "r2"), F.struct("r2", "model"))).scalar()

    a, b = best(old), best(new)
    change = F.when(a["r2"] == 0, 0.0).otherwise((b["r2"] - a["r2"]) / F.abs(a["r2"]) * 100)
    return old.sparkSession.range(1).select(
        a["model"].alias("old_model"), a["r2"].alias("old_r2"), b["model"].alias("new_model"), b["r2"].alias("new_r2"),
        change.alias("r2_improvement_pct"))


def retrain_due(models: DataFrame, runs: DataFrame, keys: Sequence[str], as_of: str, days: int = 30) -> DataFrame:
    """Models without a run or with the last run at least ``days`` days ago."""
    last = runs.groupBy(*keys).agg(F.max("training_date").alias("training_date"))
    age = F.datediff(F.lit(as_of).cast("date"), "training_date")
    return models.join(last, list(keys), "left").select(
        *keys, "training_date", age.alias("days_since"), F.coalesce(age >= days, F.lit(True)).cast("int").alias("due"))
