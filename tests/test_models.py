"""Learned models: all features, 200 trees, patience."""

import inspect

from pyspark.sql import functions as F

from cropledger.operators import models as md
from cropledger.sources.views import obs


def test_queries_train_200_trees_and_patience_is_twenty_rounds():
    from cropledger.plans import model_queries as mq

    assert not hasattr(mq, "QUERY_TREES")
    for f in (md.train_boosted_trees, md.train_trees_early_stop):
        assert inspect.signature(f).parameters["trees"].default == 200
    assert inspect.signature(md.train_trees_early_stop).parameters["patience"].default == 20


def test_all_features_are_inputs(spark):
    frame = md.training_frame(obs(spark, "/root/testdata/sf0.001"))
    inputs = md.inputs_of(frame)
    assert len(inputs) == 86
    assert frame.select(F.count_if(F.greatest(*[F.col(c).isNull() for c in inputs]))).first()[0] == 0
    model = md.train_boosted_trees(frame, 3)
    assert md.feature_importance(model, frame).count() == 20
    assert {r.split for r in md.score(model, frame, "three").collect()} == {"train", "val", "test"}


def test_early_stop_permutation_and_linear_on_a_small_frame(spark):
    frame = spark.range(600).selectExpr(
        "'c' AS crop", "'s' AS state", "'d' AS district", "date'2000-01-01' AS date", "id AS orderkey", "1L AS linenumber",
        "cast(id % 17 + id % 5 AS double) AS price", "CASE WHEN id % 10 < 7 THEN 'train' WHEN id % 10 < 8 THEN 'val' ELSE 'test' END AS split",
        "cast(id % 17 AS double) AS a", "cast(id % 5 AS double) AS b", "cast(id % 3 AS double) AS z")
    assert md.inputs_of(frame) == ["a", "b", "z"]
    model = md.train_trees_early_stop(frame, 5)
    assert 1 <= len(model.trees) <= 5 and {r.split for r in md.score_booster(model, frame, "trees").collect()} == {"train", "val", "test"}
    assert [r.feature for r in md.permutation_importance(md.train_boosted_trees(frame, 5), frame).collect()][0] == "a"
    assert {r.split for r in md.train_perceptron(frame, steps=5).collect()} == {"train", "val", "test"}
    assert {r.split for r in md.train_scaled_linear(frame).collect()} == {"train", "val", "test"}


def test_the_training_frame_stays_alone_on_disk(spark, monkeypatch):
    """The rows that it is made from go, and windows are fed rows without columns that follow from the row alone."""
    from cropledger.operators import panel_features as pf

    written, fed, write, window = [], [], md.materialize, pf.sf.lags_and_rolling
    monkeypatch.setattr(md, "materialize", lambda df, label: written.append((label, write(df, label))) or written[-1][1])
    monkeypatch.setattr(pf.sf, "lags_and_rolling", lambda df, **more: fed.extend(df.columns) or window(df, **more))
    frame = md.training_frame(obs(spark, "/root/testdata/sf0.001").limit(300))
    left = {label: spark.read.parquet(df.inputFiles()[0].rsplit("/", 1)[0]).count() for label, df in written}
    assert left == {"model-inputs": 0, "training": 300} and len(md.inputs_of(frame)) == 86
    assert not {"year", "month", "month_sin", "is_weekend", "price_range", "price_volatility"} & set(fed)
    inputs = md.inputs_of(frame)
    assert inputs.index("price_volatility") < inputs.index("price_lag_1") < inputs.index("price_yoy_change")
