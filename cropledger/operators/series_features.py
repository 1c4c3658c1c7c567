"""Lag, rolling, year-on-year and weather features."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import EPS, TICK, ticks
from ..functions.fixed_values import FRAMES, LAGS
from ..plans.series import ROWS_PER_TASK, first_per_group, over_series
from ..sources.views import ORDER, SERIES

PLACE = ["state", "district"]


def lag_columns(w: WindowSpec, lags: Sequence[int] = LAGS) -> dict[str, Column]:
    return {f"price_lag_{k}": F.lag("price", k).over(w) for k in lags}


def rolling_columns(w: WindowSpec, frames: Sequence[int] = FRAMES, end: int = 0) -> list[dict[str, Column]]:
    """Row frames ending at the current row, or one row earlier with ``end=-1``, in steps for ``over_series``.

    Only the shortest frame slides over its rows. A longer one is put together from the one before it, by lags: blocks of that
    length side by side, and single rows where they do not fill it (bounds: a last block that overlaps). A row so costs a few
    lags, not as many rows as its frames hold. Variances are joined by counts, means and squared distances from them.
    """
    sizes = sorted(set(frames))
    n, f = sizes[0], w.rowsBetween(end - (sizes[0] - 1), end)
    steps = [{
        "_t": ticks(F.col("price")).cast("double"), f"_sum{n}": F.sum(ticks(F.col("price")).cast("double")).over(f), f"_n{n}": F.count("price").over(f), f"_avg{n}": F.avg("price").over(f),
        f"price_std_{n}": F.stddev_samp("price").over(f), f"price_min_{n}": F.min("price").over(f), f"price_max_{n}": F.max("price").over(f),
    }, {
        f"price_ma_{n}": F.when(F.col(f"_n{n}") > 0, F.col(f"_sum{n}") / F.col(f"_n{n}") / TICK),
        f"_sq{n}": F.coalesce(F.pow(f"price_std_{n}", 2) * (F.col(f"_n{n}") - 1), F.lit(0.0)),
    }]
    for part, n in zip(sizes, sizes[1:]):
        steps += _joined_frames(w, part, n, end)
    return steps


def rolling_names(frames: Sequence[int] = FRAMES) -> list[str]:
    return [f"price_{c}_{n}" for n in frames for c in ("ma", "std", "min", "max")]


def _joined_frames(w: WindowSpec, part: int, n: int, end: int) -> list[dict[str, Column]]:
    """Steps that make the frame of ``n`` rows from that of ``part`` rows."""
    blocks, rest = divmod(n, part)
    back = [part * k for k in range(1, blocks)]
    lags = {f"_{c}_{k}": F.lag(f"_{c}{part}", k).over(w) for k in back for c in ("n", "sum", "avg", "sq")}
    lags |= {f"_{c}_{k}": F.lag(f"price_{c}_{part}", k).over(w) for k in {*back, n - part} for c in ("min", "max")}
    single = [part * blocks + j - end for j in range(rest)]
    lags |= {f"_{c}_row{k}": F.lag(name, k).over(w) for k in single for c, name in (("sum", "_t"), ("avg", "price"))}
    lags = {f"{c}_of{n}": v for c, v in lags.items()}

    def held(c: str, zero: bool = True) -> list[Column]:
        out = [F.col(f"_{c}{part}"), *[F.col(f"_{c}_{k}_of{n}") for k in back]]
        out += [F.col(f"_{c}_row{k}_of{n}") for k in single] if c in ("sum", "avg") else []
        return [F.coalesce(x, F.lit(0)) for x in out] if zero else out

    counts = [*held("n"), *[F.col(f"_avg_row{k}_of{n}").isNotNull().cast("bigint") for k in single]]
    means = held("avg", zero=False)
    near = F.coalesce(*means)  # means are joined as distances from one of them, which loses no digits
    away = {f"_away{i}_of{n}": F.coalesce(m - near, F.lit(0.0)) for i, m in enumerate(means)}
    by_count = [F.col(a) * c for a, c in zip(away, counts)]
    some = F.col(f"_n{n}") > 0
    total = {f"_n{n}": reduce(add, counts), f"_sum{n}": reduce(add, held("sum")), f"_near{n}": near, **away}
    bounds = {f"price_{c}_{n}": best(F.col(f"price_{c}_{part}"), *[F.col(f"_{c}_{k}_of{n}") for k in sorted({*back, n - part})])
              for c, best in (("min", F.least), ("max", F.greatest))}
    moved = {f"_move{n}": reduce(add, by_count), f"_spread{n}": reduce(add, [*held("sq"), *[F.col(a) * x for a, x in zip(away, by_count)]])}
    ends = {
        f"price_ma_{n}": F.when(some, F.col(f"_sum{n}") / F.col(f"_n{n}") / TICK),
        f"_avg{n}": F.when(some, F.col(f"_near{n}") + F.col(f"_move{n}") / F.col(f"_n{n}")),
        f"_sq{n}": F.when(some, F.greatest(F.col(f"_spread{n}") - F.pow(f"_move{n}", 2) / F.col(f"_n{n}"), F.lit(0.0))).otherwise(0.0),
    }
    std = {f"price_std_{n}": F.when(F.col(f"_n{n}") > 1, F.sqrt(F.col(f"_sq{n}") / (F.col(f"_n{n}") - 1)))}
    return [lags, {**total, **bounds}, moved, ends, std]


def price_lags(df: DataFrame, keys=SERIES, order=ORDER, lags=LAGS, rows_per_task=ROWS_PER_TASK) -> DataFrame:
    return over_series(df, keys, order, lambda w: lag_columns(w, lags), max(lags), rows_per_task=rows_per_task)


def price_changes(df: DataFrame, lags: Sequence[int] = LAGS) -> DataFrame:
    """Difference to each lag; needs the lag columns."""
    return df.withColumns({f"price_change_{k}": F.col("price") - F.col(f"price_lag_{k}") for k in lags})


def price_change_pct(df: DataFrame, lags: Sequence[int] = LAGS) -> DataFrame:
    """Change in percent of the lag, 0 where the lag is missing or not positive."""
    out = {}
    for k in lags:
        lag = F.col(f"price_lag_{k}")
        out[f"price_change_pct_{k}"] = F.when(lag > 0, (F.col("price") - lag) / lag * 100).otherwise(0.0)
    return df.withColumns(out)


def rolling_price_stats(
    df: DataFrame, keys=SERIES, order=ORDER, frames=FRAMES, leak_safe=False, rows_per_task=ROWS_PER_TASK
) -> DataFrame:
    end = -1 if leak_safe else 0
    out = over_series(df, keys, order, lambda w: rolling_columns(w, frames, end), max(frames), rows_per_task=rows_per_task)
    return out.select(*df.columns, *rolling_names(frames))


def price_vs_ma(df: DataFrame, frames: Sequence[int] = FRAMES) -> DataFrame:
    return df.withColumns({
        f"price_vs_ma_{n}": (F.col("price") - F.col(f"price_ma_{n}")) / (F.col(f"price_ma_{n}") + EPS) for n in frames
    })


def lags_and_rolling(
    df: DataFrame, keys=SERIES, order=ORDER, leak_safe=False, rows_per_task=ROWS_PER_TASK, largest: int | None = None
) -> DataFrame:
    """Every lag and row frame of the series in one window: one exchange, one sort."""
    end = -1 if leak_safe else 0
    out = over_series(df, keys, order, lambda w: [lag_columns(w), *rolling_columns(w, end=end)],
                      max(LAGS), rows_per_task=rows_per_task, largest=largest)
    out = out.select(*df.columns, *[f"price_lag_{k}" for k in LAGS], *rolling_names())
    return price_vs_ma(price_change_pct(price_changes(out)))


def price_yoy(
    df: DataFrame, keys=SERIES, order=ORDER, rows_per_task=ROWS_PER_TASK, largest: int | None = None
) -> DataFrame:
    """Change to the previous row of the same month and day.

    A row without any neighbour gets 0, the first of several gets NULL. Both are told apart by one
    lag and one lead, so no group is buffered.
    """
    md = df.withColumns({"_m": F.month("date"), "_d": F.dayofmonth("date")})

    def columns(w):
        before, after = F.lag("price").over(w), F.lead("price").over(w)
        return {"price_yoy_change": F.when(before.isNull() & after.isNull(), 0.0).otherwise(F.col("price") - before)}

    return over_series(md, [*keys, "_m", "_d"], order, columns, 1, look_ahead=True,
                       rows_per_task=rows_per_task, largest=largest).drop("_m", "_d")


def price_spread(df: DataFrame) -> DataFrame:
    width = F.col("max_price") - F.col("min_price")
    return df.withColumns({
        "price_range": width,
        "price_range_pct": F.when(F.col("min_price") > 0, width / F.col("min_price")).otherwise(0.0),
        "price_volatility": width / (F.col("price") + EPS),
    })


def temp_moving_avg(df: DataFrame, rows_per_task=ROWS_PER_TASK) -> DataFrame:
    return weather_rolling(df, rain=False, rows_per_task=rows_per_task)


def rainfall_rolling(df: DataFrame, rows_per_task=ROWS_PER_TASK) -> DataFrame:
    return weather_rolling(df, temperature=False, rows_per_task=rows_per_task)


def weather_rolling(
    df: DataFrame, temperature=True, rain=True, rows_per_task=ROWS_PER_TASK, largest: int | None = None
) -> DataFrame:
    """Row frames per place; the place's rows run crop by crop."""

    def columns(w):
        out = {}
        for n in (7, 30):
            f = w.rowsBetween(-(n - 1), 0)
            if temperature:
                out[f"temp_ma_{n}"] = F.avg("temperature").over(f)
            if rain:
                out[f"rainfall_ma_{n}"] = F.avg("rainfall").over(f)
        if rain:
            out["rainfall_sum_30"] = F.sum("rainfall").over(w.rowsBetween(-29, 0))
        return out

    return over_series(df, PLACE, ["crop", *ORDER], columns, 30, cell=2,
                       rows_per_task=rows_per_task, largest=largest)


def fill_weather_gaps(days: DataFrame, columns=("temperature_2m_max", "temperature_2m_min"), zero=("precipitation_sum",)) -> DataFrame:
    """Carry values forward, then backward, per place over its days; missing rain is 0.

    Works on one row per place and day. The backward fill runs forward over the reversed order, so
    both frames only grow.
    """
    past = Window.partitionBy(*PLACE).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    future = Window.partitionBy(*PLACE).orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)
    filled = days.withColumns({c: F.coalesce(F.last(c, True).over(past), F.last(c, True).over(future)) for c in columns})
    return filled.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in zero})


def latest_n_per_series(df: DataFrame, n: int = 30, keys=SERIES, order=ORDER) -> DataFrame:
    return first_per_group(df, keys, [F.desc(c) for c in order], n)


def direction_of_change(df: DataFrame, keys=SERIES, order=ORDER, actual="y", predicted="y_hat", rows_per_task=ROWS_PER_TASK) -> DataFrame:
    """Signs of consecutive differences of the actual and the predicted value."""

    def columns(w):
        return {
            "actual_sign": F.signum(F.col(actual) - F.lag(actual).over(w)).cast("int"),
            "predicted_sign": F.signum(F.col(predicted) - F.lag(predicted).over(w)).cast("int"),
        }

    return over_series(df, keys, order, columns, 1, rows_per_task=rows_per_task)


def target_date_lookup(forecast: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The forecast row of the wanted date per request."""
    return forecast.join(targets.select(*keys, F.col("wanted_date").alias("date")), [*keys, "date"])
