"""Long row frames are put together from short ones."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from cropledger.functions.columns import TICK, ticks
from cropledger.operators.series_features import rolling_price_stats


def test_joined_frames_equal_sliding_ones(spark):
    deal = random.Random(3)
    rows = [(i % 3, i, deal.choice([None, 5.1, deal.uniform(1, 1e5)]) if i % 3 else 0.1) for i in range(600)] + [(9, 1, None), (8, 1, 3.0)]
    df = spark.createDataFrame(rows, "g int, i int, price double")
    w = Window.partitionBy("g").orderBy("i")
    for frames, end, size in (((7, 30, 90), 0, 4_000_000), ((30, 7), -1, 40)):
        was = df
        for n in frames:
            f = w.rowsBetween(end - (n - 1), end)
            was = was.withColumns({f"price_ma_{n}": F.avg(ticks(F.col("price"))).over(f) / TICK, f"price_std_{n}": F.stddev_samp("price").over(f),
                                   f"price_min_{n}": F.min("price").over(f), f"price_max_{n}": F.max("price").over(f)})
        now = rolling_price_stats(df, ["g"], ["i"], frames, end == -1, size)
        assert now.columns == was.columns
        plan, first = now._jdf.queryExecution().optimizedPlan().toString(), end - max(frames) + 1
        assert f"RowFrame, {first}," not in plan.replace(f"RowFrame, {first}, {first})", "lag")
        for a, b in zip(was.orderBy("g", "i").collect(), now.orderBy("g", "i").collect()):
            for c in was.columns:
                assert a[c] == b[c] or c.startswith("price_std") and None not in (a[c], b[c]) and abs(a[c] - b[c]) <= 1e-9 * max(1, a[c]), (c, a, b)
