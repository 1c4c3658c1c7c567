"""Windows over a price series that stay bounded when one series holds most of the rows.

A series that fits one task runs as a plain window. A larger one is cut into runs of whole days of
about ``rows_per_task`` rows. Each run also receives the days just before (and after) it that its
row frames reach into, so every row sees exactly the frame it would see in the uncut series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import materialize

ROWS_PER_TASK = 4_000_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group; one number reaches the driver."""
    if not keys:
        return df.count()
    top = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return top or 0


def over_series(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Callable[[WindowSpec], dict[str, Column] | list[dict[str, Column]]],
    look_back: int = 0,
    look_ahead: bool = False,
    cell: int = 1,
    rows_per_task: int = ROWS_PER_TASK,
    largest: int | None = None,
) -> DataFrame:
    """Add ``columns(window)``; frames reach at most ``look_back`` rows back and one row ahead.

    A list of columns is added one after the other, so that later ones use earlier ones; names with an underscore in front go at
    the end.
    The first ``cell`` order columns name the unit that is never cut (a day). ``largest`` is an upper
    bound of the rows per group where the caller already has one; otherwise they are counted.
    """
    if (largest_group(df, keys) if largest is None else largest) <= rows_per_task:
        return _added(df, columns(Window.partitionBy(*keys).orderBy(*order)))
    cells = _runs(df, list(keys), list(order[:cell]), look_back, look_ahead, rows_per_task)
    rows = df.join(cells, [*keys, *order[:cell]]).withColumn("_run", F.explode("_targets")).drop("_targets")
    w = Window.partitionBy(*keys, "_run").orderBy(*order)
    return _added(rows, columns(w)).filter("_run = _own").drop("_run", "_own")


def _added(df: DataFrame, columns: dict[str, Column] | list[dict[str, Column]]) -> DataFrame:
    if isinstance(columns, dict):
        return df.withColumns(columns)
    for step in columns:
        df = df.withColumns(step)
    return df.drop(*[c for step in columns for c in step if c.startswith("_")])


def _runs(
    df: DataFrame, keys: list[str], cell: list[str], look_back: int, look_ahead: bool, size: int
) -> DataFrame:
    """Per cell: the run it belongs to and the runs it must be copied to."""
    days = Window.partitionBy(*keys).orderBy(*cell)
    reach = max(look_back, 1)
    counted = (
        df.groupBy(*keys, *cell).agg(F.count("*").alias("_n"))
        .withColumn("_end", F.sum("_n").over(days))
        .withColumn("_own", F.floor((F.col("_end") - F.col("_n")) / size))
    )
    first = F.greatest(F.col("_own") + 1, F.floor(F.col("_end") / size))
    last = F.floor((F.col("_end") + reach - 1) / size)
    later = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    targets = F.concat(F.array("_own"), later) if look_back else F.array("_own")
    if look_ahead:
        before = F.lag("_own").over(days)
        earlier = F.when(before < F.col("_own"), F.array(before)).otherwise(F.array().cast("array<bigint>"))
        targets = F.concat(targets, earlier)
    return counted.withColumn("_targets", targets).select(*keys, *cell, "_own", "_targets")


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first ``n`` rows per key. Spark limits each map task to ``n`` rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def global_position(df: DataFrame, by: str, tie: Sequence[str]) -> DataFrame:
    """``position`` (from 1) and ``total`` over all rows, by one sort into ranges.

    Rows are dealt by ranges of the whole order, so a day with most of the rows is spread like any other, and written once with
    their place in their range. What comes before a range is a sum over the ranges, one row each.
    """
    order = [by, *tie]
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = materialize(placed, "ordered").withColumns({"_part": F.shiftright("_id", 33), "_rank": F.col("_id").bitwiseAND((1 << 33) - 1)})
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per range
    offsets = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset"),
                            F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("total"))
    return placed.join(F.broadcast(offsets), "_part").withColumn("position", F.col("_offset") + F.col("_rank") + 1).drop("_offset", "_part", "_rank", "_id")
