"""Sources of many rows: hot crops, costly dates, generated code that the JVM compiles."""

import io
import re
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from cropledger.functions.columns import to_date_any
from cropledger.functions.fixed_values import DATE_FORMATS
from cropledger.operators import standardize as std
from cropledger.session import compiled_methods


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_quotes_are_not_dealt_by_crop(spark):
    quotes = spark.createDataFrame([("2020-01-02", "Rice ", None, "10.004", "20.004"), ("x", "Wheat", "Rs 5.556", "1", "2"), ("x", "Tea", "3", "1", "2")],
                                   "date string, commodity string, spot_price string, low_price string, high_price string")
    places = spark.createDataFrame([("Rice", "a", "b"), ("Rice", "a", "b"), ("Rice", "a", None), ("Wheat", None, "c"), (None, "d", "e")], "crop string, state string, district string")
    out = std.adapt_exchange(quotes, places, "2001-06-30", digits=2)
    assert sorted(map(str, out.select("crop", F.col("date").cast("string"), "price", "min_price", "state", "district").collect())) == sorted([
        "Row(crop='Rice', date='2020-01-02', price=15.0, min_price=10.0, state='a', district='b')",
        "Row(crop='Rice', date='2020-01-02', price=15.0, min_price=10.0, state='a', district=None)",
        "Row(crop='Wheat', date='2001-06-30', price=5.56, min_price=1.0, state=None, district='c')"])
    assert std.adapt_exchange(quotes, places, "2001-06-30").filter("price = 5.556").count() == 1
    assert "rightHint=(strategy=broadcast)" in _plan(out)
    assert _plan(out).index("round(") > _plan(out).index("Join Inner")  # below the join, once for each quote


def test_known_dates_are_read_without_a_formatter(spark):
    texts = [None, "", "1/1/2020\n", "2020-1-1\n", "1 Jan 2020\n", " 1/1/2020 ", "0000-1-1", "1/1/0000", "2020-1-1T", "31/02/2020", "29/02/2021", "29/02/2020",
             "29 FEB 2020", "31 april 2021", "13/45/2020", "0/1/2020", "001/1/2020", "1  Jan 2020", "99 May 2020", "5 Sept 2020", "5 September 2020", "5 Sep 2020",
             "07-12-1582", "9999-12-31", "12/31/2020", "5 Foo 2020", "5 Janu 2020"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    by_formatter = F.coalesce(*[F.when(F.trim("t").rlike(s), F.try_to_date(F.trim("t"), f)) for s, f in DATE_FORMATS])
    rows = df.select("t", by_formatter.alias("was"), to_date_any("t").alias("now"))
    assert "gettimestamp" not in _plan(df.select(to_date_any("t"))).lower()
    assert rows.filter("NOT was <=> now").collect() == [] and rows.filter("now IS NOT NULL").count() > 8


def test_long_generated_methods_are_cut(spark):
    limit = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.unset(limit)
    compiled_methods(spark)
    assert spark.conf.get(limit) == "8000"
    spark.conf.set(limit, "9000")
    compiled_methods(spark)
    assert spark.conf.get(limit) == "9000"
    spark.conf.unset(limit)


def test_untidy_rows_are_read_by_compiled_code(spark, tmp_path):
    from cropledger.plans.source_queries import adapt_enam

    limit, d = "spark.sql.codegen.hugeMethodLimit", str(tmp_path)
    spark.conf.unset(limit)
    spark.sql("SELECT 1L l_orderkey, 1 l_linenumber, 1L l_partkey, 1L l_suppkey, 2D l_extendedprice, 0D l_discount, 0D l_tax, timestamp_ntz'2020-01-01 00:00:00' l_shipdate").write.parquet(f"{d}/lineitem.parquet")
    spark.sql("SELECT 1L p_partkey, 'LARGE' p_type").write.parquet(f"{d}/part.parquet")
    spark.sql("SELECT 1L s_suppkey, 1 s_nationkey").write.parquet(f"{d}/supplier.parquet")
    spark.sql("SELECT 1 n_nationkey, 'x' n_name, 1 n_regionkey").write.parquet(f"{d}/nation.parquet")
    spark.sql("SELECT 1 r_regionkey, 'y' r_name").write.parquet(f"{d}/region.parquet")
    said = io.StringIO()
    with redirect_stdout(said):
        adapt_enam(spark, d).explain("codegen")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:\s*(\d+)", said.getvalue())]
    assert adapt_enam(spark, d).count() == 1
    assert max(sizes, default=0) <= 8000 or int(spark.conf.get(limit)) <= 8000
    spark.conf.unset(limit)
