"""Exact interpolated quantiles, by one method for groups of every size.

A quantile sketch brackets each quantile. One pass over the rows then counts what lies below the brackets, and keeps the
values inside them, which are few, with their counts; only those are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import materialize, maybe_broadcast

SKETCH_ACCURACY = 100_000
#: Of the sketches of many columns at once: every task sends one a column, and 8 values in 10,000 lie inside a bracket.
COLUMN_ACCURACY = 10_000


def _ends(probs: Sequence[float], accuracy: int) -> list[float]:
    """Both ends of each bracket: four times the sketch's error away."""
    return [min(max(p + side * 4.0 / accuracy, 0.0), 1.0) for p in probs for side in (-1, 1)]


def _interpolated(a: Column, b: Column, pos: Column) -> Column:
    return a + (b - a) * (pos - F.floor(pos))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """One row per key with ``q``, the array of quantiles in the order of ``probs``.

    Rows are never shuffled by key: sketches and counts are combined in the map tasks, and the brackets, one row per key,
    reach the rows as a scalar subquery (no key) or by a join that broadcasts them where their number allows.
    """
    keys, probs = list(keys), [float(p) for p in probs]
    base = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    brackets = base.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_v", _ends(probs, accuracy), accuracy).alias("_e"))
    if keys:
        rows = base.join(maybe_broadcast(materialize(brackets, "brackets")), keys)
    else:
        one = brackets.select(F.struct("_n", "_e")).scalar()
        rows = base.withColumns({"_n": one["_n"], "_e": one["_e"]})
    lo = [F.col("_e")[2 * i] for i in range(len(probs))]
    hi = [F.col("_e")[2 * i + 1] for i in range(len(probs))]
    v, inside = F.col("_v"), F.lit(False)
    for a, b in zip(lo, hi):
        inside = inside | v.between(a, b)
    # One group per key for the rows in no bracket, one per value for the others.
    counted = rows.groupBy(*keys, F.when(inside, v).alias("_in")).agg(
        F.max("_n").alias("_n"), F.max("_e").alias("_e"), F.count("*").alias("_c"),
        *[x for i in range(len(probs)) for x in (
            F.count_if(v < lo[i]).alias(f"_below{i}"), F.max(F.when(v < lo[i], v)).alias(f"_pred{i}"), F.min(F.when(v > hi[i], v)).alias(f"_succ{i}"))])
    outside = counted.groupBy(*keys).agg(F.max("_n").alias("_n"), F.array(*[
        F.struct(F.lit(i).alias("_i"), F.lit(p).alias("_p"), F.sum(f"_below{i}").alias("_below"), F.max(f"_pred{i}").alias("_pred"), F.min(f"_succ{i}").alias("_succ"))
        for i, p in enumerate(probs)]).alias("_o")).select(*keys, "_n", F.inline("_o"))
    held = counted.filter("_in IS NOT NULL").select(*keys, F.col("_in").alias("_v"), "_c", F.explode(F.array_compact(F.array(*[
        F.when(F.col("_in").between(lo[i], hi[i]), F.lit(i)) for i in range(len(probs))]))).alias("_i"))
    ranked = held.withColumn("_to", F.sum("_c").over(Window.partitionBy(*keys, "_i").orderBy("_v"))).join(outside, [*keys, "_i"]).withColumn(
        "_pos", F.col("_p") * (F.col("_n") - 1))

    def at(rank: Column) -> Column:
        hit = (F.col("_below") + F.col("_to") - F.col("_c") <= rank) & (rank < F.col("_below") + F.col("_to"))
        return F.max(F.when(hit, F.col("_v")))

    per = ranked.groupBy(*keys, "_i").agg(
        F.coalesce(at(F.floor("_pos")), F.first("_pred")).alias("_a"), F.coalesce(at(F.ceil("_pos")), F.first("_succ")).alias("_b"), F.first("_pos").alias("_pos"))
    # One entry per asked probability and key.
    q = F.struct("_i", _interpolated(F.col("_a"), F.col("_b"), F.col("_pos")).alias("_q"))
    return per.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(q)), lambda s: s["_q"]).alias("q"))


def column_quantile(df: DataFrame, columns: Sequence[str], prob: float, accuracy: int = COLUMN_ACCURACY) -> dict[str, Column]:
    """The same quantile of many columns, as literals: two passes for all columns together, and the values inside the
    brackets. A column without values gives NULL."""
    if not columns:
        return {}
    ends = _ends([prob], accuracy)
    first = df.agg(*[x for c in columns for x in (F.count(c).alias(f"n_{c}"), F.percentile_approx(F.col(c).cast("double"), ends, accuracy).alias(f"e_{c}"))]).first()
    known = [c for c in columns if first[f"n_{c}"]]
    if not known:
        return {c: F.lit(None).cast("double") for c in columns}
    val = {c: F.col(c).cast("double") for c in known}
    lo, hi = {c: first[f"e_{c}"][0] for c in known}, {c: first[f"e_{c}"][1] for c in known}
    seen = Observation()  # what lies outside the brackets is counted in the pass that gathers what is inside
    spots = df.observe(seen, *[x for c in known for x in (
        F.count_if(val[c] < lo[c]).alias(f"b_{c}"), F.max(F.when(val[c] < lo[c], val[c])).alias(f"p_{c}"), F.min(F.when(val[c] > hi[c], val[c])).alias(f"s_{c}"))])
    spots = spots.select(F.explode(F.array_compact(F.array(*[
        F.when(val[c].between(lo[c], hi[c]), F.struct(F.lit(c).alias("name"), val[c].alias("v"))) for c in known]))).alias("e")).select("e.*")
    held = materialize(spots.groupBy("name", "v").agg(F.count("*").alias("c")), "inside-brackets")
    around = seen.get
    place = {c: prob * (first[f"n_{c}"] - 1) for c in known}
    rank = F.create_map(*[x for c in known for x in (F.lit(c), F.lit(float(place[c] - around[f"b_{c}"])))])[F.col("name")]
    upto = held.withColumn("to", F.sum("c").over(Window.partitionBy("name").orderBy("v"))).withColumn("r", rank)

    def at(r: Column) -> Column:
        return F.max(F.when((F.col("to") - F.col("c") <= r) & (r < F.col("to")), F.col("v")))

    found = {r["name"]: r for r in upto.groupBy("name").agg(at(F.floor("r")).alias("a"), at(F.ceil("r")).alias("b")).collect()}  # one row per column
    out = {}
    for c in columns:
        if c not in known:
            out[c] = F.lit(None).cast("double")
            continue
        a, b = found[c]["a"], found[c]["b"]
        a, b = around[f"p_{c}"] if a is None else a, around[f"s_{c}"] if b is None else b
        part = place[c] - int(place[c])
        out[c] = F.lit(a if not part else a + (b - a) * part)
    return out
