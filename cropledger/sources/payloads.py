"""Source payloads rendered from the panel: envelopes, script blocks, tables, attributes, daily arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.weather import weather
from .tables import table
from .views import named, obs

KEYS = ["orderkey", "linenumber", "partkey", "suppkey"]


def money(c: Column) -> Column:
    return c.cast("decimal(18,2)").cast("string")


def _records(df: DataFrame) -> DataFrame:
    def record(shift: int, tail: str) -> Column:
        return F.struct(
            F.col("crop").alias("commodity"), "state", F.concat("district", F.lit(tail)).alias("district"),
            money(F.col("price") + shift).alias("price"), F.date_format("date", "yyyy-MM-dd").alias("date"))

    return df.select(*KEYS, F.array(record(0, ""), record(1, " Rural")).alias("records"))


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("records")
    k = F.col("orderkey") % 4
    payload = (
        F.when(k == 0, F.to_json(r)).when(k == 1, F.to_json(F.struct(r.alias("data"))))
        .when(k == 2, F.to_json(F.struct(r.alias("records")))).otherwise(F.to_json(F.struct(r.alias("results"))))
    )
    return _records(named(spark, sf_dir)).select(*KEYS, payload.alias("payload"))


def _crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = table(spark, sf_dir, "pages")
    return page.select(F.col("page_id").alias("orderkey"), F.lit(0).alias("linenumber"), F.lit(0).cast("bigint").alias("partkey"),
                       F.lit(0).cast("bigint").alias("suppkey"), "html")


def script_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("<html><script>var quotes = "), F.to_json("records"), F.lit(';</script><p>{"price": "not data"}</p></html>'))
    return _records(named(spark, sf_dir)).select(*KEYS, body.alias("html")).unionByName(_crawled(spark, sf_dir))


HEADERS = [
    ["Commodity", "State", "District", "Min Price", "Max Price", "Price", "Date"],
    ["Crop", "Mandi", "Modal Price (Rs)", "Arrival Date"],
    ["Product", "Date", "Spot Price", "Low Price", "High Price"],
]


def _table(headers: list[str], cells: list[Column], tail: str) -> Column:
    head = "".join(f"<th>{h}</th>" for h in headers)
    row = [p for c in cells for p in (F.lit("<td>"), c, F.lit("</td>"))]
    return F.concat(F.lit(f"<table class='p'><tr>{head}</tr><tr>"), *row, F.lit(f"</tr>{tail}</table>"))


def table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    bold = F.concat(F.lit("<b>"), F.col("crop"), F.lit("</b>"))
    low, mid, high = money(F.col("price") - 1), money(F.col("price")), money(F.col("price") + 1)
    day = F.date_format("date", "dd/MM/yyyy")
    k = F.col("orderkey") % 3
    short = "<tr><td>closed</td></tr>"
    shown = (
        F.when(k == 0, _table(HEADERS[0], [bold, F.col("state"), F.col("district"), low, high, F.concat(F.lit("Rs "), mid), day], short))
        .when(k == 1, _table(HEADERS[1], [bold, F.concat("district", F.lit(" &amp; Co")), mid, day], ""))
        .otherwise(_table(HEADERS[2], [bold, day, mid, low, high], ""))
    )
    page = F.concat(F.lit("<html><table><tr><th>Name</th><th>Phone</th></tr><tr><td>desk</td><td>1</td></tr></table>"), shown, F.lit("</html>"))
    return named(spark, sf_dir).select(*KEYS, page.alias("html")).unionByName(_crawled(spark, sf_dir))


def attribute_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.concat(
        F.lit('<div class="x">none</div><div data-commodity="'), F.col("crop"), F.lit('" data-price="'), money(F.col("price")),
        F.lit('" id="q">q</div><div class="y" data-price="'), money(F.col("price") + 1), F.lit('"></div>'))
    return named(spark, sf_dir).select(*KEYS, page.alias("html")).unionByName(_crawled(spark, sf_dir))


def weather_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payload per place and year, so an array never exceeds 366 entries. Even years miss the last two rain values."""
    days = weather(obs(spark, sf_dir)).withColumn("year", F.year("date"))
    entry = F.struct("date", "temperature_2m_max", "temperature_2m_min", "precipitation_sum")
    lists = days.groupBy("state", "district", "year").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    rain = F.col("e.precipitation_sum")
    kept = F.when((F.col("year") % 2 == 0), F.slice(rain, F.lit(1), F.greatest(F.size(rain) - 2, F.lit(0)))).otherwise(rain)
    return lists.select("state", "district", "year", F.struct(
        F.transform("e.date", lambda d: F.date_format(d, "yyyy-MM-dd")).alias("time"),
        F.col("e.temperature_2m_max").alias("temperature_2m_max"), F.col("e.temperature_2m_min").alias("temperature_2m_min"),
        kept.alias("precipitation_sum")).alias("daily"))


def crop_map_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON object per place; the malformed key must be skipped."""
    places = named(spark, sf_dir).groupBy("state", "district").agg(F.array_sort(F.collect_set("crop")).alias("crops"))
    return places.select(F.to_json(F.map_from_arrays(
        F.array(F.concat("state", F.lit("_"), F.lit(" "), "district"), F.concat("state", F.lit(" only"))),
        F.array("crops", "crops"))).alias("payload"))
