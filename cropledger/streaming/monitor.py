"""Structured Streaming jobs over the prediction log and the observations.

Jobs run to the end of the available input. Each batch leaves a table of its own, of what it adds or changes, and every so many
batches the tables are folded into one, so a batch costs as much as it brings. Rows may come in any order: partial figures are
added up, so late rows count and windows that are still open are shown. A job given a path of its own resumes there.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType, StructField, StructType, LongType

from ..operators.monitor import log_predictions
from ..session import new_path
from ..sources.tables import table
from ..sources.views import ORDER, SERIES, log_columns

_STORE = "spark.sql.streaming.stateStore.providerClass"


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A landed table as a file stream, whether it is one file or a folder (a pattern that only this name fits)."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(os.path.join(sf_dir, f"{name}.parque[t]"))


def run_to_table(stream: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Appends the stream's rows to the table under ``path``, from where the last run ended."""
    spark = stream.sparkSession
    root = path or new_path(spark, label)
    done = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/rows")
        .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    )
    done.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


#: Batches whose tables are folded into one.
FOLD_BATCHES = 20


def kept_by_batches(stream: DataFrame, shape: Callable[[DataFrame], DataFrame], fold: Callable[[DataFrame], DataFrame], label: str, path: str | None = None,
                    mode: str = "append") -> DataFrame:
    """What ``fold`` makes of the tables that ``shape`` makes of the batches (with their number as ``batch``).

    A batch that is run again overwrites its own table only. Folded tables take turns in two folders; folding what is folded
    already must change nothing. A run without new input returns the table as it was.
    """
    spark = stream.sparkSession
    root = path or new_path(spark, label)
    empty = shape(spark.createDataFrame([], stream.schema))
    columns = empty.columns
    empty.withColumn("upto", F.lit(-1).cast("bigint")).write.mode("ignore").parquet(f"{root}/folded/turn=-1")
    empty.write.mode("ignore").parquet(f"{root}/batches/batch=-1")

    def current(session: SparkSession) -> DataFrame:
        folded = session.read.schema(StructType([*empty.schema.fields, StructField("upto", LongType())])).parquet(f"{root}/folded")
        upto = folded.agg(F.coalesce(F.max("upto"), F.lit(-1)).alias("u")).first()["u"]
        newer = session.read.option("basePath", f"{root}/batches").parquet(f"{root}/batches").where(F.col("batch") > upto)
        own = folded.where(F.col("upto") == upto).select(*columns, F.col("upto").alias("batch"))
        return fold(own.unionByName(newer.select(*columns, F.col("batch").cast("bigint").alias("batch")))).select(*columns)

    def keep(batch: DataFrame, number: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{root}/batches/batch={number}")
        if (number + 1) % FOLD_BATCHES == 0:
            turn = (number + 1) // FOLD_BATCHES % 2
            current(batch.sparkSession).withColumn("upto", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{root}/folded/turn={turn}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return current(spark)


def prediction_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_predictions(log_columns(table_stream(spark, sf_dir, "events")))


def partial_stats() -> dict[str, Column]:
    return {"total": F.count("*"), "failed": F.count("error"), "error_sum": F.sum("absolute_error"), "with_actual": F.count("absolute_error")}


def windowed_stats(log: DataFrame, size: str, slide: str | None, label: str, path: str | None = None) -> DataFrame:
    """Usage stats per model and event-time window of whole days; a sliding window moves by one day.

    What is kept are panes, one for each day and model; a batch adds to those of its days. A sliding window is a sum over the
    panes of its days.
    """
    days = int(size.split()[0])
    if size.split()[1].rstrip("s") != "day" or slide not in (None, "1 day") or (slide is None and days != 1):
        raise ValueError("windows are single days, or days that slide by one")
    names = list(partial_stats())

    def panes(batch: DataFrame) -> DataFrame:
        return batch.groupBy(F.to_date("ts").alias("day"), "model").agg(*[c.alias(n) for n, c in partial_stats().items()])

    def add(rows: DataFrame) -> DataFrame:
        return rows.groupBy("day", "model").agg(*[F.sum(n).alias(n) for n in names])

    t = kept_by_batches(log, panes, add, label, path)
    if days > 1:
        grid = t.groupBy("model").agg(F.explode(F.sequence(F.date_sub(F.min("day"), days - 1), F.max("day"))).alias("day"))
        over = Window.partitionBy("model").orderBy(F.unix_date("day")).rangeBetween(0, days - 1)
        t = grid.join(t, ["model", "day"], "left").select("model", "day", *[F.sum(n).over(over).alias(n) for n in names]).where("total > 0")
    return t.select(F.col("day").alias("window_start"), F.date_add("day", days).alias("window_end"), "model",
                    F.col("total").alias("total_predictions"), (F.col("failed") * 100.0 / F.col("total")).alias("error_rate"),
                    F.try_divide(F.col("error_sum"), F.col("with_actual")).alias("average_error"), F.col("with_actual").alias("predictions_with_actual"))


def stream_monitor_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_stats(prediction_stream(spark, sf_dir), "1 day", None, "daily")


def stream_monitor_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_stats(prediction_stream(spark, sf_dir), "30 days", "1 day", "sliding")


def dedupe_stream(observed: DataFrame, keys: list[str], late: str | None = None) -> DataFrame:
    """One row per key. All keys are remembered; with ``late`` only for as long as the watermark admits late rows, which
    bounds the state but lets copies through that are further apart."""
    if late is None:
        return observed.dropDuplicates(keys)
    return observed.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


class LatestRows(StatefulProcessor):
    """Keeps the latest rows of every key as list state, and gives them when the key has new ones."""

    def __init__(self, schema: StructType, order: Sequence[str], rows: int, ttl_ms: int | None):
        self.schema, self.places, self.rows, self.ttl_ms = schema, [schema.names.index(c) for c in order], rows, ttl_ms
        self.whole = [isinstance(f.dataType, IntegralType) for f in schema.fields]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("latest", self.schema, self.ttl_ms)

    def _row(self, values: tuple) -> tuple:
        return tuple(None if v is None or v != v else int(v) if whole else v for v, whole in zip(values, self.whole))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [self._row(r) for r in self.state.get()] if self.state.exists() else []
        for batch in rows:
            held += [self._row(r) for r in batch[self.schema.names].itertuples(index=False, name=None)]
            held.sort(key=lambda r: [(r[i] is not None, r[i]) if r[i] is not None else (False, 0) for i in self.places], reverse=True)
            del held[self.rows:]  # no more than a batch beyond what stays is held
        self.state.put(held)
        yield pd.DataFrame(held, columns=self.schema.names, dtype=object)

    def close(self) -> None:
        pass


#: Rows that a map task holds before it hands on what it has found.
HELD_ROWS = 200_000


def newest_in_task(batches: Iterator[pa.RecordBatch], order: Sequence[str], rows: int, held_rows: int = HELD_ROWS) -> Iterator[pa.RecordBatch]:
    """The latest rows of every series among those a map task reads, so that no others are shuffled and looked at one by one.

    Of many series a task holds a bounded number of rows: what it hands on early are rows too many, never too few.
    """
    def newest(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, sort_keys=[(c, "descending") for c in order], null_placement="at_end"))
        series = np.zeros(len(t), dtype=np.int64)
        for c in SERIES:
            names = pa.chunked_array([t[c].combine_chunks()]).combine_chunks().dictionary_encode(null_encoding="encode")
            series = series * max(1, len(names.dictionary)) + names.indices.to_numpy(zero_copy_only=False)
        return t.filter(pa.array(pd.Series(series).groupby(series).cumcount().to_numpy() < rows))

    held: list[pa.Table] = []
    for batch in batches:
        if len(batch):
            held.append(newest(pa.Table.from_batches([batch])))
        if sum(map(len, held)) > held_rows:
            held = [newest(pa.concat_tables(held))]
            if len(held[0]) > held_rows // 2:
                yield from held.pop().to_batches(max_chunksize=10_000)
    if held:
        yield from newest(pa.concat_tables(held)).to_batches(max_chunksize=10_000)


def latest_conditions(observed: DataFrame, label: str = "latest", rows: int = 30, path: str | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Latest rows per series, kept in a state store: a batch reads and changes the series that it has rows of.

    With ``ttl_ms`` a series is forgotten by the state that long after its last rows; the table still shows them.
    """
    spark, schema = observed.sparkSession, observed.schema
    held = {k: spark.conf.get(k, None) for k in (_STORE,)}
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        fresh = observed.mapInArrow(lambda batches: newest_in_task(batches, ORDER, rows), schema)
        changed = fresh.groupBy(*SERIES).transformWithStateInPandas(
            LatestRows(schema, ORDER, rows, ttl_ms), schema, "Update", "ProcessingTime" if ttl_ms else "None")

        def newest(rows_: DataFrame) -> DataFrame:
            last = rows_.groupBy(*SERIES).agg(F.max("batch").alias("newest")).withColumnsRenamed({c: f"_{c}" for c in SERIES})
            same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in SERIES])  # a series may lack a name
            return rows_.join(last, same).where("batch = newest")

        return kept_by_batches(changed, lambda batch: batch, newest, label, path, "update")
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
