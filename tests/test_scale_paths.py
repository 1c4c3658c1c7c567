"""The ways taken for large groups give the same rows as the plain ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cropledger.functions.quantiles import column_quantile, quantiles
from cropledger.operators import group_features as gf
from cropledger.operators import impute as imp
from cropledger.operators import series_features as sf
from cropledger.operators.panel_features import engineer_all_features
from cropledger.plans.series import global_position, over_series


@pytest.fixture(scope="module")
def panel(spark):
    """One series with most of the rows, days of very different size, a gap and many ties."""
    rnd = random.Random(7)
    rows = []
    for crop, days, per_day in (("hot", 60, lambda d: [1, 1, 2, 40, 0, 3][d % 6]), ("small", 25, lambda d: 1), ("one", 1, lambda d: 1)):
        for d in range(days):
            for i in range(per_day(d)):
                price = round(rnd.uniform(10, 900), 2)
                rows.append((crop, "S", "D", d + (300 if d > 40 else 0), rnd.randrange(1000), i, i, i, price, float(d % 9), float(i % 3)))
    df = spark.createDataFrame(rows, "crop string, state string, district string, n int, orderkey long, linenumber int, partkey long, "
                                     "suppkey long, price double, temperature double, rainfall double")
    return df.withColumn("date", F.date_add(F.lit("1999-12-01").cast("date"), F.col("n"))).drop("n").cache()


def same(a, b):
    cols = sorted(a.columns)
    key = lambda r: tuple(str(x) for x in r)
    left, right = (sorted(map(tuple, d.select(*cols).collect()), key=key) for d in (a, b))
    assert len(left) == len(right)
    for x, y in zip(left, right):
        for u, v in zip(x, y):
            assert u == v or (isinstance(u, float) and u == pytest.approx(v, abs=1e-9))


@pytest.mark.parametrize("size", [1, 5, 37, 100])
def test_lags_in_runs(panel, size):
    same(sf.price_lags(panel, lags=(1, 7, 30)), sf.price_lags(panel, lags=(1, 7, 30), rows_per_task=size))


@pytest.mark.parametrize("size", [5, 64])
@pytest.mark.parametrize("leak_safe", [False, True])
def test_frames_in_runs(panel, size, leak_safe):
    back = 91 if leak_safe else 90
    whole = over_series(panel, sf.SERIES, sf.ORDER, lambda w: sf.rolling_columns(w, end=-int(leak_safe)), back)
    same(whole, over_series(panel, sf.SERIES, sf.ORDER, lambda w: sf.rolling_columns(w, end=-int(leak_safe)), back, rows_per_task=size))


def test_yoy_in_runs(panel):
    more = panel.unionByName(panel.withColumn("date", F.add_months("date", 12))).unionByName(panel.withColumn("date", F.add_months("date", 24)))
    same(sf.price_yoy(more), sf.price_yoy(more, rows_per_task=3))


def test_weather_frames_in_runs(panel):
    same(sf.weather_rolling(panel), sf.weather_rolling(panel, rows_per_task=20))


def test_global_position(panel):
    got = global_position(panel, "date", ["crop", "orderkey", "linenumber", "price"]).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, len(got) + 1))
    keys = [(r.date, r.crop, r.orderkey, r.linenumber, r.price) for r in got]
    assert keys == sorted(keys)
    assert {r.total for r in got} == {len(got)}


@pytest.mark.parametrize("accuracy", [10, 50, 1000])
def test_bracketed_quantiles(spark, accuracy):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=997), "b": np.repeat([1.0, 2.0, 2.0, 5.0], 40), "c": np.array([4.0, 9.0]), "d": np.array([3.5])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.7, 0.99, 1.0]
    for r in quantiles(df, ["k"], "v", probs, accuracy=accuracy).collect():
        assert r.q == pytest.approx(list(np.quantile(groups[r.k], probs)), abs=1e-9)
    whole = quantiles(df, [], "v", [0.3], accuracy=accuracy).first().q[0]
    assert whole == pytest.approx(np.quantile([v for _, v in rows], 0.3))


@pytest.mark.parametrize("accuracy", [10, 100_000])
def test_column_quantile(spark, accuracy):
    rng = np.random.default_rng(1)
    cols = {"a": rng.normal(size=500).round(1), "b": rng.integers(0, 4, 500).astype(float)}
    df = spark.createDataFrame([(*map(float, r), None) for r in zip(*cols.values())], "a double, b double, c double")
    row = df.select(*[q.alias(c) for c, q in column_quantile(df, ["a", "b", "c"], 0.3, accuracy).items()]).first()
    assert (row.a, row.b) == (pytest.approx(np.quantile(cols["a"], 0.3)), pytest.approx(np.quantile(cols["b"], 0.3))) and row.c is None


def test_gaps_are_filled_by_name(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (2.0, 4.0, None), (10.0, 8.0, 7.0), (None, None, 1.0)], "price_a double, price_b double, t double")
    got = sorted(imp.impute_by_name_rule(df).collect())
    assert (1.0, 6.0, 5.0) in got and (2.0, 6.0, 1.0) in got


def test_few_states_are_broadcast_though_cells_are_many(panel):
    """With a low limit the state table is still broadcast; larger grains are joined by a shuffle."""
    with_month = panel.withColumn("month", F.month("date"))
    cube = gf.PriceCube(panel, limit=1)
    assert not cube.small
    plan = gf.state_price_stats(with_month, cube)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    same(gf.group_features(with_month, cube), gf.group_features(with_month, gf.PriceCube(panel)))


def test_medians_of_all_features_do_not_reach_the_driver_as_sketches(panel, monkeypatch):
    seen, plain = [], type(panel).observe

    def observe(self, name, *columns):
        seen.extend(map(str, columns))
        return plain(self, name, *columns)

    monkeypatch.setattr(type(panel), "observe", observe)
    rows = panel.withColumns({"min_price": F.when(F.col("linenumber") % 2 == 0, F.col("price")), "max_price": F.col("price")})
    out = engineer_all_features(rows)
    assert out.filter("min_price IS NULL").count() == 0 and seen
    assert not [c for c in seen if "percentile" in c]


def test_a_written_table_leaves_no_shuffle_files(spark):
    """They go as the write ends; the session's own setting stays."""
    import time

    from cropledger.session import materialize

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = manager.getAllFiles()
        return {n for n in (found.apply(i).getName() for i in range(found.size())) if n.startswith("shuffle_")}

    own, before = spark.conf.get(key), files()
    frame = spark.range(50_000).repartition(4, "id").groupBy((F.col("id") % 100).alias("k")).agg(F.max("id").alias("m"))
    assert materialize(frame, "shuffled").count() == 100 and spark.conf.get(key) == own
    until = time.time() + 15
    while (left := {n for n in files() - before if n.endswith(".data")}) and time.time() < until:
        time.sleep(0.2)
    assert len(left) <= 1  # that of the count
