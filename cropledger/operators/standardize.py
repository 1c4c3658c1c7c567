"""Standardisation of landed sources into the panel schema (P1-P19). All adapters are projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import one_of, rounded, to_date_any, to_number
from ..functions.fixed_values import COLUMN_ALIASES, COMMON_NAMES, PORTAL_NAMES
from ..session import materialize, maybe_broadcast

REQUIRED = ["date", "state", "district", "crop", "price"]
MONTH_FORMATS = ((r"^\d{4}-\d{2}$", "yyyy-MM"),)
OPTIONAL = ["min_price", "max_price", "temperature", "rainfall", "data_source", "source_dataset"]


def physical(name: str) -> Column:
    return F.col(f"`{name}`")


def fold(name: str) -> str:
    return name.strip().replace(" ", "_").replace("-", "_").lower()


def resolve_column_aliases(df: DataFrame, aliases: Mapping[str, Sequence[str]] = COLUMN_ALIASES) -> DataFrame:
    """Rename by the first physical column that matches an alias. Works on the schema, runs no job."""
    found = {}
    for canonical, names in aliases.items():
        accepted = {fold(n) for n in names}
        hit = next((c for c in df.columns if fold(c) in accepted), None)
        if hit is not None:
            found[hit] = canonical
    return df.select(*[physical(c).alias(found.get(c, c)) for c in df.columns])


def rename_common(df: DataFrame, names: Mapping[str, Sequence[str]] = COMMON_NAMES) -> DataFrame:
    """Many-to-one rename: the first non-NULL alias wins, so no column name is produced twice."""
    present = {c.lower() for c in df.columns}
    used = {n.lower() for group in names.values() for n in group}
    merged = [one_of(df, *group).alias(c) for c, group in names.items() if present & {n.lower() for n in group}]
    return df.select(*merged, *[physical(c) for c in df.columns if c.lower() not in used])


def number(c: str) -> Column:
    return physical(c).try_cast("double")


def sold(df: DataFrame, *needed: str) -> DataFrame:
    """Rows with all needed columns and a price above zero."""
    return df.na.drop(subset=[*needed, "price"]).filter("price > 0")


def adapt_reported_date(df: DataFrame, source_dataset: str | None = None) -> DataFrame:
    out = df.select(
        F.try_to_date(physical("Reported Date"), "M/d/yyyy").alias("date"),
        physical("State Name").alias("state"), physical("District Name").alias("district"),
        physical("Commodity").alias("crop"), number("Modal Price (Rs./Quintal)").alias("price"),
        number("Min Price (Rs./Quintal)").alias("min_price"), number("Max Price (Rs./Quintal)").alias("max_price"),
    )
    return tag_source(sold(out, "date", "state", "crop"), "reported", source_dataset)


def adapt_arrival_date(df: DataFrame, source_dataset: str | None = None) -> DataFrame:
    out = df.select(
        F.try_to_date("Arrival_Date", "d/M/yyyy").alias("date"), F.col("State").alias("state"),
        F.col("District").alias("district"), F.col("Commodity").alias("crop"),
        number("Modal_x0020_Price").alias("price"), number("Min_x0020_Price").alias("min_price"),
        number("Max_x0020_Price").alias("max_price"),
    )
    return tag_source(sold(out, "date", "state", "crop"), "arrival", source_dataset)


def adapt_year_month(df: DataFrame, source_dataset: str | None = None) -> DataFrame:
    out = df.select(
        F.try_to_date(F.format_string("%04d-%02d-01", F.col("Year").try_cast("int"), F.col("Month").try_cast("int")), "yyyy-MM-dd").alias("date"),
        F.col("State").alias("state"), F.lit("Unknown").alias("district"), F.trim(physical("Crop ")).alias("crop"),
        number("Wholesale_Price [Rs. Per Quintal]").alias("price"),
        number("Temperature (Celsis)").alias("temperature"), number("Rainfall in mm").alias("rainfall"),
    )
    return tag_source(sold(out, "date", "state", "crop"), "monthly", source_dataset)


def adapt_item_price(df: DataFrame, source_dataset: str | None = None) -> DataFrame:
    out = df.select(
        F.try_to_date("Date", "M/d/yyyy").alias("date"), F.lit("Unknown").alias("state"),
        F.lit("Unknown").alias("district"), F.col("Item_Name").alias("crop"), number("Price").alias("price"),
    )
    return tag_source(sold(out, "date", "crop"), "items", source_dataset)


def blank_nan(c: Column) -> Column:
    t = F.trim(c)
    return F.when(F.lower(t) != "nan", t)


def adapt_enam(df: DataFrame, as_of: str) -> DataFrame:
    """Market-level source: the market column is kept, prices lose currency marks, blank markets go."""
    market = next(c for c in df.columns if "apmc" in c.strip().lower())
    names = {fold(c): c for c in df.columns}

    def money(key: str) -> Column:
        if key not in names:
            return F.lit(None).cast("double")
        text = physical(names[key])
        for mark in (",", "Rs", "/"):
            text = F.replace(text, F.lit(mark), F.lit(""))
        return F.trim(text).try_cast("double")

    price = money("modal_price") if "modal_price" in names else (money("min_price") + money("max_price")) / 2
    out = df.select(
        to_date_any(physical(names["date"]), as_of).alias("date") if "date" in names else F.lit(as_of).cast("date").alias("date"),
        blank_nan(physical(names["state"])).alias("state") if "state" in names else F.lit(None).cast("string").alias("state"),
        blank_nan(physical(names["district"])).alias("district") if "district" in names else F.lit(None).cast("string").alias("district"),
        F.trim(physical(names["commodity"])).alias("crop"), price.alias("price"),
        money("min_price").alias("min_price"), money("max_price").alias("max_price"),
        blank_nan(physical(market)).alias("apmc"),
    )
    return out.filter((F.col("price") > 0) & (F.col("apmc") != ""))


def adapt_commodityonline(df: DataFrame, as_of: str) -> DataFrame:
    """Missing text columns become '', missing bounds NULL, unreadable dates the as-of day."""

    def text(c: str) -> Column:
        return (F.trim(F.coalesce(physical(c), F.lit("nan"))) if c in df.columns else F.lit("")).alias(c)

    def bound(c: str) -> Column:
        return (to_number(physical(c)) if c in df.columns else F.lit(None).cast("double")).alias(c)

    return df.select(
        (to_date_any("date", as_of) if "date" in df.columns else F.lit(as_of).cast("date")).alias("date"),
        text("state"), text("district"), text("crop"), to_number("price").alias("price"),
        bound("min_price"), bound("max_price"),
    ).filter("price > 0")


def adapt_exchange(df: DataFrame, wanted: DataFrame, as_of: str, digits: int | None = None) -> DataFrame:
    """Exchange quotes have no place: they are stamped with the places that asked for the crop.

    Crops are few and hot, so the places are written, counted and broadcast, and quotes are not dealt by crop. With ``digits``
    prices are rounded, once for each quote and not for each place.
    """
    quotes = df.select(
        to_date_any("date", as_of).alias("date"), F.trim("commodity").alias("crop"),
        derive_price(to_number("spot_price"), None, to_number("low_price"), to_number("high_price")).alias("price"),
        to_number("low_price").alias("min_price"), to_number("high_price").alias("max_price"),
    ).filter("price > 0")
    if digits is not None:
        quotes = rounded(quotes, price=digits, min_price=digits, max_price=digits)
    places = materialize(wanted.select("crop", "state", "district").distinct(), "places")
    return quotes.join(maybe_broadcast(places), "crop")


def adapt_datagov(df: DataFrame) -> DataFrame:
    out = df.select(
        to_date_any("arrival_date").alias("date"), "state", "district", "market", F.col("commodity").alias("crop"),
        "variety", number("modal_price").alias("price"), number("min_price").alias("min_price"),
        number("max_price").alias("max_price"),
    )
    return out.na.drop(subset=["date", "price"])


def adapt_agmarknet(df: DataFrame) -> DataFrame:
    out = rename_common(df, PORTAL_NAMES)
    return out.withColumns({"date": to_date_any("date"), "price": number("price")}).na.drop(subset=["price"])


def adapt_state_board(df: DataFrame, state: str = "Maharashtra") -> DataFrame:
    """Source of a single state: the constant stands in where the column is absent or NULL."""
    given = F.coalesce(F.col("state"), F.lit(state)) if "state" in df.columns else F.lit(state)
    return df.select(
        to_date_any("arrival_date").alias("date"), given.alias("state"), "district",
        F.col("market_name").alias("market"), F.col("commodity").alias("crop"), number("modal_price").alias("price"),
    ).na.drop(subset=["price"])


def header_role(header: Column, exchange: bool = False) -> Column:
    """Panel column a table header stands for; the first matching rule wins."""
    h = F.lower(header)

    def has(*words: str) -> Column:
        test = F.contains(h, F.lit(words[0]))
        for w in words[1:]:
            test = test | F.contains(h, F.lit(w))
        return test

    if exchange:
        return (F.when(has("commodity", "product"), "crop").when(has("date"), "date")
                .when(has("price") & has("min", "low"), "min_price").when(has("price") & has("max", "high"), "max_price")
                .when(has("price", "spot"), "price"))
    return (F.when(has("commodity", "crop"), "crop").when(has("state"), "state")
            .when(has("district", "mandi", "apmc"), "district").when(has("price") & has("min"), "min_price")
            .when(has("price") & has("max"), "max_price").when(has("price", "rs"), "price").when(has("date"), "date"))


def route_header_cells(cells: DataFrame, keys: Sequence[str], exchange: bool = False) -> DataFrame:
    """Cells to one row per table row: the last column of a role counts, rows without crop or price go."""
    routed = cells.withColumn("role", header_role(F.col("header"), exchange)).filter("role IS NOT NULL")
    roles = ["crop", "date", "min_price", "max_price", "price"] + ([] if exchange else ["state", "district"])
    out = routed.groupBy(*keys).agg(*[
        F.max_by(F.when(F.col("role") == r, F.col("cell")), F.when(F.col("role") == r, F.col("col_no"))).alias(r)
        for r in roles
    ])
    return out.filter("crop IS NOT NULL AND (price IS NOT NULL OR min_price IS NOT NULL)")


def parse_dates_multi(df: DataFrame, column: str, as_of: str) -> DataFrame:
    return df.withColumn("parsed_date", to_date_any(column, as_of))


def parse_month_strings(df: DataFrame, column: str) -> DataFrame:
    """Month text first, then any full date, both over the original text."""
    return df.withColumn("parsed_date", F.coalesce(to_date_any(column, formats=MONTH_FORMATS), to_date_any(column)))


def derive_price(price: Column | None, avg: Column | None, low: Column, high: Column) -> Column:
    """price, else average, else the middle of min and max, else min, else max."""
    tries = [c for c in (price, avg) if c is not None]
    return F.coalesce(*tries, (low + high) / 2, low, high)


def tag_source(df: DataFrame, source: str, dataset: str | None = None) -> DataFrame:
    out = df.withColumn("data_source", F.lit(source))
    return out.withColumn("source_dataset", F.lit(dataset)) if dataset else out


def project_panel(df: DataFrame) -> DataFrame:
    return df.select(*REQUIRED, *[c for c in OPTIONAL if c in df.columns])
