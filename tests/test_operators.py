"""Edge cases on small hand-made rows."""

import datetime as dt
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from cropledger.functions.columns import finite, to_date_any, to_int, to_number
from cropledger.operators import calendar as cal
from cropledger.operators import clean as cl
from cropledger.operators import forecast as fc
from cropledger.operators import group_features as gf
from cropledger.operators import impute as imp
from cropledger.operators import market as mk
from cropledger.operators import models as md
from cropledger.operators import monitor as mo
from cropledger.operators import profile as pr
from cropledger.operators import resolve as rs
from cropledger.operators import series_features as sf
from cropledger.operators import standardize as std
from cropledger.sources import ingest as ing
from cropledger.streaming import monitor as st

COLS = "crop string, state string, district string, date date, orderkey long, linenumber int, partkey long, suppkey long, price double"


def series(spark, prices, dates=None):
    dates = dates or [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(len(prices))]
    return spark.createDataFrame([("c", "s", "d", d, i, 1, 1, 1, p) for i, (d, p) in enumerate(zip(dates, prices))], COLS)


def test_single_row_series(spark):
    r = sf.price_yoy(sf.lags_and_rolling(series(spark, [10.0]))).first()
    assert r.price_std_7 is None and r.price_lag_1 is None and r.price_change_pct_1 == 0.0
    assert r.price_ma_90 == 10.0 and r.price_yoy_change == 0.0


def test_change_after_a_zero_price(spark):
    rows = sf.price_change_pct(sf.price_lags(series(spark, [0.0, 5.0, 10.0]))).orderBy("date").collect()
    assert [r.price_change_pct_1 for r in rows] == [0.0, 0.0, 100.0]


def test_yoy_pairs(spark):
    days = [dt.date(y, 3, 1) for y in (2018, 2019, 2020)] + [dt.date(2020, 5, 5)]
    rows = sf.price_yoy(series(spark, [1.0, 3.0, 2.0, 9.0], days)).orderBy("date").collect()
    assert [r.price_yoy_change for r in rows] == [None, 2.0, -1.0, 0.0]


def test_frames_count_rows_not_days(spark):
    days = [dt.date(2020, 1, 1), dt.date(2020, 1, 2), dt.date(2020, 1, 11), dt.date(2020, 2, 20)]
    rows = sf.price_lags(series(spark, [1.0, 2.0, 3.0, 4.0], days), lags=(1, 3)).orderBy("date").collect()
    assert rows[3].price_lag_3 == 1.0


def test_calendar_edges(spark):
    days = [dt.date(2023, 1, 1), dt.date(2024, 2, 29), dt.date(2024, 12, 30), dt.date(2024, 12, 31)]
    rows = cal.all_calendar(series(spark, [1.0] * 4, days)).orderBy("date").collect()
    assert [r.week_of_year for r in rows] == [52, 9, 1, 1]
    assert [r.day_of_week for r in rows] == [6, 3, 0, 1]
    assert rows[3].day_of_year == 366 and rows[0].is_winter == 1 and rows[0].is_rabi == 1


def test_price_texts(spark):
    df = spark.createDataFrame([("Rs 1,234.50",), ("N/A",), ("",), ("12/kg",), ("1.2.3",), (None,)], "t string")
    got = df.select(to_number("t"), to_number("t", 0.0), to_int("t", -1)).collect()
    assert [r[0] for r in got] == [1234.5, None, None, 12.0, None, None]
    assert [r[1] for r in got] == [1234.5, 0.0, 0.0, 12.0, 0.0, 0.0]
    assert [r[2] for r in got] == [1234, -1, -1, 12, -1, -1]


def test_date_texts(spark):
    texts = ["05/03/2020", "5-3-2020", "2020-03-05", "05 Mar 2020", "05 March 2020", "13/45/2020", "2020-03", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    day = dt.date(2020, 3, 5)
    assert [r[0] for r in df.select(to_date_any("t", "2021-01-01")).collect()] == [day] * 5 + [dt.date(2021, 1, 1)] * 3
    got = [r.parsed_date for r in std.parse_month_strings(df, "t").collect()]
    assert got == [day] * 5 + [None, dt.date(2020, 3, 1), None]


def test_not_finite(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (-float("inf"),), (2.0,), (None,)], "v double")
    assert [r[0] for r in df.select(finite(F.col("v"))).collect()] == [None, None, None, 2.0, None]
    assert [r.v for r in cl.sanitize_nonfinite(df, ["v"]).collect()] == [2.0] * 5


def test_null_keys_and_placeholders(spark):
    df = spark.createDataFrame([("A", "x"), ("Unknown", "x"), (" NAN ", "x"), ("", "x"), (None, "x"), ("B", None)], "state string, district string")
    assert [r.state for r in cl.filter_unknown(df, ["state"]).collect()] == ["A", "B"]
    assert cl.drop_missing_essentials(df, ["state", "district"]).count() == 4


def test_keep_first_by_ingest_order(spark):
    df = spark.createDataFrame([("k", 3), ("k", 1), ("k", 2), ("j", 9)], "k string, n int")
    assert sorted(map(tuple, cl.dedupe_first(df, ["k"], ["n"]).collect())) == [("j", 9), ("k", 1)]


def test_category_bins_close_on_the_right(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 50.0, 50.01, 200.0, 1000.0, 1000.01)], "crop_price_avg double")
    assert [r.crop_price_category for r in gf.crop_price_category(df).collect()] == [None, "low", "medium", "medium", "high", "very_high"]


def test_calibration_branches(spark):
    cases = [(0.2, 0.58), (0.4, 0.58), (0.69, 0.783), (0.7, 1.0), (1.0, 1.0), (1.3, 1.0), (1.31, 1.217), (2.5, 2.05), (4.0, 2.05)]
    df = spark.createDataFrame([(100.0, 100.0 * r, None, None) for r, _ in cases], "raw_prediction double, current_price double, avg_price_7d double, avg_price_30d double")
    got = [r.calibrated for r in fc.calibrate_prediction(df).collect()]
    assert got == pytest.approx([100.0 * f for _, f in cases])
    rest = spark.createDataFrame([(0.0, 5.0, 5.0, 5.0), (None, 5.0, 5.0, 5.0), (100.0, None, 300.0, 1.0), (100.0, None, None, 60.0), (100.0, 110.0, 300.0, None)],
                                 df.schema)
    assert [r.calibrated for r in fc.calibrate_prediction(rest).collect()] == [0.0, None, 150.0, 80.0, 150.0]


def test_ragged_arrays(spark):
    df = spark.sql("""select 1 as k, named_struct('time', array('2020-01-01', '2020-01-02', 'bad'), 'a', array(1.0D, 2.0D), 'b', array()) as daily""")
    df = df.withColumn("daily", F.col("daily").cast("struct<time:array<string>,a:array<double>,b:array<double>>"))
    got = [tuple(r) for r in ing.inline_daily_arrays(df, "daily", ["k"], ["a", "b"]).collect()]
    assert got == [(1, dt.date(2020, 1, 1), 1.0, None), (1, dt.date(2020, 1, 2), 2.0, None), (1, None, None, None)]


def test_default_weather_without_a_range(spark):
    df = spark.createDataFrame([(1, None, None), (2, dt.date(2020, 5, 30), dt.date(2020, 6, 2))], "k int, chunk_start date, chunk_end date")
    rows = imp.default_weather_calendar(df).collect()
    assert [tuple(r)[1:] for r in rows if r.k == 1] == [(None, 30.0, 20.0, 0.0)]
    assert {r.temperature_2m_max for r in rows if r.k == 2} == {38.0}  # the chunk's first month decides
    assert sum(r.k == 2 for r in rows) == 4


KNOWN = [("Karnataka", "Mysuru"), ("Karnataka", "Bengaluru Urban"), ("Tamil Nadu", "Salem"), ("Uttar Pradesh", "Mau"), ("Himachal Pradesh", "Mandi")]


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame(KNOWN, "state string, district string")


def test_name_tiers(spark, known):
    texts = ["KARNATAKA", "tn", "Tamilnadu", "Karnataka State", "Uttar", "Narnia", " ", "ut tarpra desh"]
    names = spark.createDataFrame([(t,) for t in texts], "raw string")
    got = {r.raw: (r.canonical, r.tier) for r in rs.normalize_state(names, known).collect()}
    assert got["KARNATAKA"] == ("Karnataka", 1) and got["tn"] == ("Tamil Nadu", 3) and got["Tamilnadu"] == ("Tamil Nadu", 3)
    assert got["Karnataka State"] == ("Karnataka", 4) and got["Uttar"] == ("Uttar Pradesh", 3)
    assert got["Narnia"] == (None, None) and got[" "] == (None, None) and got["ut tarpra desh"] == ("Uttar Pradesh", 5)


def test_district_scope(spark, known):
    names = spark.createDataFrame([("Karnataka", "Mysore"), ("Tamil Nadu", "Mysore"), (None, "Mysore")], "state string, raw string")
    got = {r.state: r.canonical for r in rs.normalize_district(names, known).collect()}
    assert got == {"Karnataka": "Mysuru", "Tamil Nadu": None, None: "Mysuru"}


def test_similar_pairs_miss_nothing(spark):
    rng = np.random.default_rng(11)
    base = ["thrissur", "ernakulam", "salem", "nadia", "chikkamagaluru", "dakshina kannada", "x", "ab"]
    names = set(base)
    for b in base:
        for _ in range(12):
            s = list(b)
            for _ in range(rng.integers(0, 4)):
                i = rng.integers(0, len(s) + 1)
                op = rng.integers(0, 3)
                if op == 0:
                    s.insert(i, "e")
                elif s and op == 1:
                    s.pop(min(i, len(s) - 1))
                elif s:
                    s[min(i, len(s) - 1)] = "o"
            if s:
                names.add("".join(s))
    df = spark.createDataFrame([("b", n) for n in names], "block string, name string")
    for t in (0.85, 0.9):
        want = {(a, b) for a in names for b in names if a < b
                for r in [SequenceMatcher(None, a, b).ratio()] if r >= t or ((a in b or b in a) and r > 0.7)}
        got = {(r.a, r.b) for r in rs.similar_name_pairs(df, t, "sequence").collect()}
        assert got == want

        leaders, groups = set(), {}
        for n in sorted(names):
            lead = next((x for x in sorted(leaders) if (x, n) in want), None)
            if lead is None:
                leaders.add(n)
            else:
                groups.setdefault(lead, {lead}).add(n)
        pairs = rs.similar_name_pairs(df, t, "sequence")
        clustered = {}
        for r in rs.cluster_names_greedy(pairs).collect():
            clustered.setdefault(r.leader, set()).add(r.name)
        assert clustered == groups


def test_no_similar_pairs(spark):
    df = spark.createDataFrame([("b", "rice"), ("b", "wheat")], "block string, name string")
    assert rs.cluster_names_greedy(rs.similar_name_pairs(df, 0.85)).count() == 0


def test_market_cascade(spark, known):
    rows = [("Salem APMC", None, None), ("Any", "KA", "Mysore"), ("Big Mandi", "Himachal", None), ("Big Mandi", None, None),
            ("Karnataka Yard", None, None), ("Nowhere Depot", None, None)]
    df = spark.createDataFrame(rows, "apmc string, given_state string, given_district string")
    got = {(r.apmc, r.given_state): (r.district, r.state, r.confidence) for r in rs.map_apmc(df, known).collect()}
    assert got[("Salem APMC", None)] == ("Salem", "Tamil Nadu", "name_extraction")
    assert got[("Any", "KA")] == ("Mysuru", "Karnataka", "provided")
    assert got[("Big Mandi", "Himachal")] == ("Mandi", "Himachal Pradesh", "state_constrained")
    assert got[("Big Mandi", None)] == ("Mandi", "Himachal Pradesh", "fuzzy_match")
    assert got[("Karnataka Yard", None)] == (None, "Karnataka", "name_extraction")
    assert got[("Nowhere Depot", None)] == (None, None, "none")


def test_consolidation_maps_by_frequency(spark):
    rows = [("Brinjal",)] * 3 + [("Brinjall",)] + [("Paddy",)] * 2 + [("Rice",)]
    df = spark.createDataFrame(rows, "crop string")
    got = {(r.crop_original, r.crop) for r in rs.consolidate_crops(df).collect()}
    assert got == {("Brinjal", "Brinjal"), ("Brinjall", "Brinjal"), ("Paddy", "Rice"), ("Rice", "Rice")}


def test_trend_and_short_series(spark):
    df = series(spark, [5.0, 6.0, 8.0]).withColumns({"min_price": F.col("price") - 1, "max_price": F.lit(None).cast("double")})
    r = mk.market_conditions(df).first()
    assert (r.current_price, r.market_min, r.market_max, r.price_trend, r.records_count) == (8.0, 7.0, None, "increasing", 3)
    assert r.avg_price_7d == pytest.approx(19 / 3) and [e.price for e in r.recent_prices] == [8.0, 6.0, 5.0]


def test_commodity_fit_equals_least_squares(spark):
    rng = np.random.default_rng(5)
    n = 400
    days = [dt.date(2019, 1, 1) + dt.timedelta(int(i)) for i in range(n)]
    lo, hi = rng.uniform(10, 50, n), rng.uniform(60, 90, n)
    y = 3 + 0.5 * lo + 0.25 * hi + rng.normal(0, 1, n)
    df = spark.createDataFrame([("c", d, float(a), float(b), float(v)) for d, a, b, v in zip(days, lo, hi, y)],
                               "crop string, date date, min_price double, max_price double, price double")
    got = md.fit_per_commodity(df).first()
    cut = np.quantile(np.arange(n), 0.8)
    x = np.column_stack([np.ones(n), lo, hi, [d.weekday() for d in days], [d.month for d in days]])
    train = np.arange(n) < cut
    w = np.linalg.lstsq(x[train], y[train], rcond=None)[0]
    err = x[~train] @ w - y[~train]
    assert got.train_rows == train.sum() and got.n == (~train).sum()
    assert got.mae == pytest.approx(np.abs(err).mean(), rel=1e-6)


def test_percent_error_of_a_zero_actual(spark):
    log = spark.createDataFrame([(0.0, 2.0), (4.0, 5.0), (None, 5.0)], "actual double, predicted double")
    assert [tuple(r)[2:] for r in mo.log_predictions(log).collect()] == [(2.0, 0.0), (1.0, 25.0), (None, None)]


def test_late_rows_count_and_tables_are_carried(spark, tmp_path):
    """Each file is a batch, and they are out of order: all rows count, and a run without new files changes nothing."""
    src = str(tmp_path / "in")
    one = [(1, dt.datetime(2024, 1, 1, 5), "m", 1.0, 2.0, None), (2, dt.datetime(2024, 1, 9), "m", 1.0, 2.0, None)]
    two = [(3, dt.datetime(2024, 1, 1, 6), "m", 1.0, 9.0, None), (4, dt.datetime(2024, 1, 20), "m", 1.0, 2.0, "e")]
    schema = "event_id long, ts timestamp, model string, actual double, predicted double, error string"
    three = [(5, dt.datetime(2024, 1, 2), "m", 1.0, 9.0, None), (6, dt.datetime(2024, 1, 21), "m", 1.0, 2.0, None)]
    for part in (one, two, three):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    for _ in range(2):
        out = st.windowed_stats(mo.log_predictions(stream), "1 day", None, "late", str(tmp_path / "out")).orderBy("window_start").collect()
        assert [(r.window_start.day, r.total_predictions) for r in out] == [(1, 2), (2, 1), (9, 1), (20, 1), (21, 1)]

    panel = str(tmp_path / "panel")
    for lo in (0, 20):
        series(spark, [float(i) for i in range(lo, lo + 20)], [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(lo, lo + 20)]) \
            .coalesce(1).write.mode("append").parquet(panel)
    rows = spark.readStream.schema(COLS).option("maxFilesPerTrigger", 1).parquet(panel)
    latest = st.latest_conditions(rows).select("price").collect()
    assert sorted(r.price for r in latest) == [float(i) for i in range(10, 40)]


def test_files_of_one_folder_are_read_by_their_own_header_and_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("date,state,price\n2020-01-01,Kérala,10\n".encode())
    (tmp_path / "b.csv").write_bytes("state,price,date\nGoéa,20,2020-01-02\n".encode("latin-1"))
    (tmp_path / "empty.csv").write_bytes(b"")
    got = {(r.date, r.state, r.price) for r in ing.scan_multi_file(spark, [str(tmp_path), str(tmp_path / "none")]).collect()}
    assert got == {("2020-01-01", "Kérala", "10"), ("2020-01-02", "Goéa", "20")}
    with pytest.raises(ValueError):
        ing.scan_multi_file(spark, [str(tmp_path / "none")])


def test_outer_table_keeps_its_rows_around_a_nested_one(spark):
    page = ("<table><tr><th>Price</th><th>Date</th></tr><tr><td>1</td><td>a</td></tr><tr><td><table><tr><th>Price</th></tr><tr><td>9</td></tr></table></td><td>b</td></tr>"
            "<tr><td>3</td><td>c</td></tr></table>")
    cells = ing.harvest_html_tables(spark.createDataFrame([(1, page)], "k int, html string"), "html", ["k"]).collect()
    assert sorted(r.cell for r in cells if r.header == "Date") == ["a", "b", "c"]
    assert sorted(r.cell for r in cells if r.header == "Price") == ["", "1", "3", "9"]


def test_histogram_of_one_price(spark):
    got = pr.price_histogram(spark.createDataFrame([(5.0,), (5.0,), (None,)], "price double"), 4).orderBy("bin").collect()
    assert [r.records for r in got] == [0, 0, 2, 0] and got[0].lower == 4.5 and got[-1].upper == 5.5
