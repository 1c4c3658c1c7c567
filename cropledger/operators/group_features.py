"""Location, commodity and interaction features.

All group means and deviations come from one small cube of partial sums, computed in a single pass
with map-side aggregation and written once. Every grain is rolled up from that cube.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import EPS, TICK, ticks
from ..functions.quantiles import quantiles
from ..session import BROADCAST_ROWS, materialize, maybe_broadcast

SERIES_KEYS = ["crop", "state", "district"]


class PriceCube:
    """Partial sums per state, district, crop and month, written once.

    Every roll-up has at most as many rows as the cube, so a small cube makes all of them small. The same
    cells bound the rows of the largest series and place.
    """

    def __init__(self, df: DataFrame, price: str = "price", limit: int = BROADCAST_ROWS):
        t, self.limit = ticks(F.col(price)), limit
        self.panel = df
        self.cells = materialize(df.groupBy("state", "district", "crop", F.month("date").alias("month")).agg(
            F.count(price).alias("n"), F.sum(t).cast("decimal(38,0)").alias("s"),
            F.avg(price).alias("m"), (F.coalesce(F.var_pop(price), F.lit(0.0)) * F.count(price)).alias("m2"),
            F.min(price).alias("lo"), F.max(price).alias("hi"), F.count("*").alias("rows"),
        ), "price-cube")
        self.small = self.cells.count() <= limit

    def largest(self, *keys: str) -> int:
        return self.cells.groupBy(*keys).agg(F.sum("rows").alias("r")).agg(F.max("r")).first()[0] or 0

    def largest_series_and_place(self) -> tuple[int, int]:
        series = self.cells.groupBy(*SERIES_KEYS).agg(F.sum("rows").alias("r"))
        place = series.groupBy("state", "district").agg(F.max("r").alias("one"), F.sum("r").alias("all"))
        row = place.agg(F.max("one"), F.max("all")).first()
        return row[0] or 0, row[1] or 0

    def stats(self, keys: Sequence[str], prefix: str, want: Sequence[str]) -> DataFrame:
        """Roll up to ``keys``: mean, std, min, max and row count."""
        n = F.sum("n")
        mean = F.sum("s").cast("double") / n / TICK
        # Merge of within-cell and between-cell deviations.
        between = F.sum(F.col("n") * F.pow(F.col("m"), F.lit(2))) - n * F.pow(F.sum(F.col("n") * F.col("m")) / n, F.lit(2))
        std = F.when(n > 1, F.sqrt(F.greatest(F.sum("m2") + between, F.lit(0.0)) / (n - 1)))
        made = {"avg": mean, "std": std, "min": F.min("lo"), "max": F.max("hi"), "freq": F.sum("rows")}
        return self.cells.groupBy(*keys).agg(*[made[k].alias(f"{prefix}_{k}") for k in want])

    def medians(self, keys: Sequence[str], name: str) -> DataFrame:
        """Exact medians from the panel, written once."""
        q = quantiles(self.panel, keys, "price", [0.5])
        return materialize(q.select(*keys, F.col("q")[0].alias(name)), "medians")

    def medians_by(self, names: dict[str, str]) -> dict[str, DataFrame]:
        """Exact medians by each of several columns, in the passes of one quantile: every row counts for each column."""
        rows = self.panel.select("price", F.explode(F.array(*[F.struct(F.lit(k).alias("grain"), F.col(k).alias("key")) for k in names])).alias("g"))
        q = materialize(quantiles(rows.select("g.*", "price"), ["grain", "key"], "price", [0.5]), "medians")
        return {k: q.filter(F.col("grain") == k).select(F.col("key").alias(k), F.col("q")[0].alias(n)) for k, n in names.items()}

    def attach(self, df: DataFrame, rolled: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Each rolled table is broadcast by its own size: few states are broadcast however many cells there are."""
        return df.join(F.broadcast(rolled) if self.small else maybe_broadcast(materialize(rolled, "rolled"), self.limit), list(keys), "left")


def relative(a: str, b: str) -> Column:
    return (F.col(a) - F.col(b)) / (F.col(b) + EPS)


def state_price_stats(df: DataFrame, cube: PriceCube) -> DataFrame:
    small = cube.stats(["state"], "state_price", ["avg", "std"]).join(
        cube.medians(["state"], "state_price_median"), "state", "left")
    return cube.attach(df, small, ["state"])


def district_price_stats(df: DataFrame, cube: PriceCube) -> DataFrame:
    return cube.attach(df, cube.stats(["state", "district"], "district_price", ["avg", "std"]), ["state", "district"])


def price_vs_location(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "price_vs_state_avg": relative("price", "state_price_avg"),
        "price_vs_district_avg": relative("price", "district_price_avg"),
    })


def location_frequency(df: DataFrame, cube: PriceCube) -> DataFrame:
    """Rows of the state, and of the district by its name alone."""
    out = cube.attach(df, cube.cells.groupBy("state").agg(F.sum("rows").alias("state_frequency")), ["state"])
    return cube.attach(out, cube.cells.groupBy("district").agg(F.sum("rows").alias("district_frequency")), ["district"])


def crop_price_stats(df: DataFrame, cube: PriceCube) -> DataFrame:
    small = cube.stats(["crop"], "crop_price", ["avg", "std", "min", "max"]).join(
        cube.medians(["crop"], "crop_price_median"), "crop", "left")
    return cube.attach(df, small, ["crop"]).withColumn("price_vs_crop_avg", relative("price", "crop_price_avg"))


def crop_range_position(df: DataFrame, cube: PriceCube) -> DataFrame:
    """Needs the crop price columns."""
    out = cube.attach(df, cube.cells.groupBy("crop").agg(F.sum("rows").alias("crop_frequency")), ["crop"])
    return out.withColumn("crop_price_range", F.col("crop_price_max") - F.col("crop_price_min")).withColumn(
        "crop_price_position", (F.col("price") - F.col("crop_price_min")) / (F.col("crop_price_range") + EPS))


def crop_price_category(df: DataFrame, avg: str = "crop_price_avg") -> DataFrame:
    c = F.col(avg)
    return df.withColumn("crop_price_category", F.when(c <= 0, None).when(c <= 50, "low").when(c <= 200, "medium")
                         .when(c <= 1000, "high").when(c > 1000, "very_high"))


def state_crop_interaction(df: DataFrame, cube: PriceCube) -> DataFrame:
    out = cube.attach(df, cube.stats(["state", "crop"], "state_crop_price", ["avg", "std"]), ["state", "crop"])
    return out.withColumn("price_vs_state_crop", relative("price", "state_crop_price_avg"))


def state_month_interaction(df: DataFrame, cube: PriceCube) -> DataFrame:
    return cube.attach(df, cube.stats(["state", "month"], "state_month_price", ["avg"]), ["state", "month"])


def crop_month_interaction(df: DataFrame, cube: PriceCube) -> DataFrame:
    return cube.attach(df, cube.stats(["crop", "month"], "crop_month_price", ["avg"]), ["crop", "month"])


def group_features(df: DataFrame, cube: PriceCube) -> DataFrame:
    """All location, commodity and interaction features; needs the month column.

    In a small cube every cell first gets the figures of all its grains, and the panel is joined once.
    """
    median = cube.medians_by({"state": "state_price_median", "crop": "crop_price_median"})
    place, cell = ["state", "district"], [*SERIES_KEYS, "month"]
    grains = [
        (cube.stats(["state"], "state_price", ["avg", "std"]).join(median["state"], "state", "left")
         .join(cube.cells.groupBy("state").agg(F.sum("rows").alias("state_frequency")), "state"), ["state"]),
        (cube.stats(place, "district_price", ["avg", "std"]), place),
        (cube.cells.groupBy("district").agg(F.sum("rows").alias("district_frequency")), ["district"]),
        (cube.stats(["crop"], "crop_price", ["avg", "std", "min", "max"]).join(median["crop"], "crop", "left")
         .join(cube.cells.groupBy("crop").agg(F.sum("rows").alias("crop_frequency")), "crop"), ["crop"]),
        (cube.stats(["state", "crop"], "state_crop_price", ["avg", "std"]), ["state", "crop"]),
        (cube.stats(["state", "month"], "state_month_price", ["avg"]), ["state", "month"]),
        (cube.stats(["crop", "month"], "crop_month_price", ["avg"]), ["crop", "month"]),
    ]
    if cube.small:
        wide = cube.cells.select(*cell)
        for rolled, keys in grains:
            wide = wide.join(rolled, keys, "left")
        wide = materialize(wide, "grains")
        held = wide.select(*[F.col(c).alias(f"_{c}") for c in cell], *[c for c in wide.columns if c not in cell])
        same = F.lit(True)
        for c in cell:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        out = df.join(F.broadcast(held), same, "left").drop(*[f"_{c}" for c in cell])
    else:
        out = df
        for rolled, keys in grains:
            out = cube.attach(out, rolled, keys)
    out = price_vs_location(out).withColumns({
        "price_vs_crop_avg": relative("price", "crop_price_avg"), "price_vs_state_crop": relative("price", "state_crop_price_avg"),
        "crop_price_range": F.col("crop_price_max") - F.col("crop_price_min")})
    return crop_price_category(out.withColumn("crop_price_position", (F.col("price") - F.col("crop_price_min")) / (F.col("crop_price_range") + EPS)))
