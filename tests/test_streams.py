"""Streams that keep what a batch changes: restarts, folding, panes of sliding windows, state of latest rows."""

import datetime as dt
import os
import random

from cropledger.operators import monitor as mo
from cropledger.operators.series_features import latest_n_per_series
from cropledger.streaming import monitor as st

LOG = "event_id long, ts timestamp, model string, actual double, predicted double, error string"
OBS = ("orderkey long, linenumber long, partkey long, suppkey long, date date, price double, min_price double, "
       "state string, district string, crop string")


def files(spark, folder, schema, parts):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_sliding_windows_are_sums_of_panes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "FOLD_BATCHES", 2)
    rng = random.Random(1)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randint(0, 24 * 80)), rng.choice("ab"), rng.choice([None, 2.0]), 3.0, rng.choice([None, "e"])) for i in range(300)]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for cut in (0, 150):  # the second run goes on where the first ended
        stream = files(spark, src, LOG, [rows[k:k + 50] for k in range(cut, cut + 150, 50)])
        got = st.windowed_stats(mo.log_predictions(stream), "30 days", "1 day", "sliding", out)
        seen, want = rows[:cut + 150], {}
        for _, ts, model, actual, predicted, error in seen:
            for back in range(30):
                w = want.setdefault((ts.date() - dt.timedelta(back), model), [0, 0, 0.0, 0])
                w[0] += 1
                w[1] += error is not None
                w[2] += abs(predicted - actual) if actual is not None else 0
                w[3] += actual is not None
        have = {(r.window_start, r.model): r for r in got.collect()}
        assert set(have) == set(want)
        for k, (n, failed, total, with_actual) in want.items():
            r = have[k]
            assert (r.total_predictions, r.error_rate, r.predictions_with_actual) == (n, failed * 100.0 / n, with_actual)
            assert r.window_end == k[0] + dt.timedelta(30) and r.average_error == (total / with_actual if with_actual else None)


def test_latest_rows_live_in_state_and_a_batch_touches_its_series_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "FOLD_BATCHES", 3)
    rng = random.Random(2)

    def row(i, crop):
        return (i, 1, 1, 1, dt.date(2020, 1, 1) + dt.timedelta(rng.randint(0, 60)), float(rng.randint(1, 9)), rng.choice([None, 0.5]), "s", None if crop == "z" else "d", crop)

    parts = [[row(40 * p + i, rng.choice("abz")) for i in range(40)] for p in range(4)]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    st.latest_conditions(files(spark, src, OBS, parts), "latest", 5, out).count()
    parts.append([row(900 + i, "b") for i in range(3)])
    got = st.latest_conditions(files(spark, src, OBS, parts[-1:]), "latest", 5, out)
    every = spark.createDataFrame([r for p in parts for r in p], OBS)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, latest_n_per_series(every, 5).drop("rn").select(*got.columns).collect()), key=str)
    last = max(int(d.split("=")[1]) for d in os.listdir(f"{out}/batches") if d.startswith("batch="))
    assert last == 4 and {r.crop for r in spark.read.parquet(f"{out}/batches/batch={last}").collect()} == {"b"}
    again = st.latest_conditions(spark.readStream.schema(OBS).parquet(src), "latest", 5, out)
    assert again.count() == got.count()


def test_streams_without_rows(spark, tmp_path):
    stream = files(spark, str(tmp_path / "none"), OBS, [[]])
    assert st.latest_conditions(stream).count() == 0
    log = files(spark, str(tmp_path / "log"), LOG, [[]])
    assert st.windowed_stats(mo.log_predictions(log), "30 days", "1 day", "sliding").count() == 0


def test_map_tasks_hand_on_the_latest_rows_only():
    import random

    import pyarrow as pa

    from cropledger.sources.views import ORDER, SERIES
    from cropledger.streaming.monitor import newest_in_task

    deal = random.Random(5)
    rows = [{"crop": deal.choice(["a", "b", None]), "state": deal.choice(["s", None]), "district": deal.choice(["d", "e"]), "date": deal.choice([None, 1, 2, 3]),
             "orderkey": deal.choice([None, 2**60 + i]), "linenumber": i, "partkey": 1, "suppkey": 1, "price": None if i % 5 == 0 else i / 7} for i in range(3_000)]
    kinds = pa.schema([("crop", pa.string()), ("state", pa.string()), ("district", pa.string()), ("date", pa.int32()), ("orderkey", pa.int64()),
                       ("linenumber", pa.int32()), ("partkey", pa.int64()), ("suppkey", pa.int64()), ("price", pa.float64())])
    batches = lambda: iter(pa.Table.from_pylist(rows, kinds).to_batches(max_chunksize=100))

    def latest(some):
        series = {}
        for r in some:
            series.setdefault(tuple(r[c] for c in SERIES), []).append(tuple(r[c] for c in ORDER))
        return {k: sorted(v, key=lambda t: [(x is not None, x or 0) for x in t], reverse=True)[:4] for k, v in series.items()}

    once = [r for b in newest_in_task(batches(), ORDER, 4) for r in b.to_pylist()]
    assert len(once) == 12 * 4 and latest(once) == latest(rows)
    early = [r for b in newest_in_task(batches(), ORDER, 4, held_rows=60) for r in b.to_pylist()]
    assert 48 < len(early) < 3_000 and latest(early) == latest(rows)
    assert list(newest_in_task(iter([]), ORDER, 4)) == []
