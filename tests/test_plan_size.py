"""Plans over many columns do not grow with the square of their number."""

from pyspark.sql import functions as F

from cropledger.operators import evaluate as ev
from cropledger.operators import impute as imp


def test_plans_of_many_columns_hold_their_statistics_once(spark):
    names = [f"x{i}" for i in range(40)]
    rows = spark.range(20).select(F.when(F.col("id") < 15, "train").otherwise("test").alias("split"),
                                  *[F.when(F.col("id") % 4 != 0, F.col("id") * F.lit(i)).cast("double").alias(c) for i, c in enumerate(names)])
    for out in (imp.impute_train_means(rows, names), ev.scale_features(rows, names)):
        assert len(out._jdf.queryExecution().logical().toString()) < 40_000
    filled = imp.impute_train_means(rows, names).orderBy("x1").first()
    assert filled["x2"] == 2.0 and imp.impute_train_means(rows.filter("split = 'test'"), names).filter("x1 IS NULL").count() == 1
