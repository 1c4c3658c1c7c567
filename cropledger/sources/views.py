"""The price panel and its companions, as lazy views over the landed tables.

``obs`` is the clean panel. ``named`` carries the same rows under real place and crop names so
that the spelling dictionaries apply, ``raw_obs`` is ``named`` as untidy text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import compiled_methods
from .tables import spread, table

SERIES = ["crop", "state", "district"]
TIE = ["orderkey", "linenumber", "partkey", "suppkey", "price"]
ORDER = ["date", *TIE]

STATES = ["Karnataka", "Kerala", "Tamil Nadu", "Uttar Pradesh", "West Bengal"]
STATE_CODES = ["KA", "KL", "TN", "UP", "WB"]
DISTRICTS = [
    "Bengaluru Urban", "Kasaragod", "Tiruchirappalli", "Prayagraj", "Kolkata",
    "Mysuru", "Kozhikode", "Chennai", "Varanasi", "Howrah",
    "Belagavi", "Ernakulam", "Madurai", "Agra", "Hooghly",
    "Dakshina Kannada", "Thiruvananthapuram", "Salem", "Meerut", "Nadia",
    "Shivamogga", "Thrissur", "Erode", "Kanpur Nagar", "Bankura",
]
OLD_DISTRICTS = [
    "Bangalore", "Kasargod", "Trichy", "Allahabad", "Calcutta",
    "Mysore", "Calicut", "Madras", "Benares", "Howrah",
    "Belgaum", "Cochin", "Madurai", "Agra", "Hooghly",
    "Mangalore", "Trivandrum", "Salem", "Meerut", "Nadia",
    "Shimoga", "Thrissur", "Erode", "Kanpur Nagar", "Bankura",
]
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
CROPS = ["Rice", "Wheat", "Onion", "Tomato", "Potato", "Turmeric"]
OTHER_CROPS = ["Paddy", "Wheat Grain", "Onions", "Tomatoes", "Potatoes", "Turmeric (Dry)"]


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def wide(spark: SparkSession, sf_dir: str, line: DataFrame | None = None) -> DataFrame:
    """One row per market observation with every key; unused columns are pruned by Catalyst.

    ``line`` may be a stream of line items instead of the landed table.
    """
    line = spread(table(spark, sf_dir, "lineitem"), "l_orderkey") if line is None else line
    price = F.col("l_extendedprice")
    # Dimensions join one by one: each is a plain table whose size Spark knows from its files, so small
    # ones are broadcast and the line items are only shuffled for a dimension that is really large.
    return (
        line.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("l_orderkey").alias("orderkey"),
            F.col("l_linenumber").alias("linenumber"),
            F.col("l_partkey").alias("partkey"),
            F.col("l_suppkey").alias("suppkey"),
            F.col("l_shipdate").cast("date").alias("date"),
            F.col("r_name").alias("state"),
            F.col("n_name").alias("district"),
            F.col("p_type").alias("crop"),
            price.alias("price"),
            F.round(price * (1 - F.col("l_discount")), 4).alias("min_price"),
            F.round(price * (1 + F.col("l_tax")), 4).alias("max_price"),
            pick(["enam", "agmarknet", "datagov"], F.col("l_linenumber") % 3).alias("data_source"),
            F.col("r_regionkey").alias("regionkey"),
            F.col("n_nationkey").alias("nationkey"),
        )
    )


def obs(spark: SparkSession, sf_dir: str, line: DataFrame | None = None) -> DataFrame:
    return wide(spark, sf_dir, line).drop("regionkey", "nationkey")


def _crop_index() -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("crop")) - 1


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        wide(spark, sf_dir)
        .withColumns({
            "state": pick(STATES, F.col("regionkey")),
            "district": pick(DISTRICTS, F.col("nationkey")),
            "crop": pick(CROPS, _crop_index()),
        })
        .drop("regionkey", "nationkey")
    )


def raw_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``named`` with deterministic dirt: every field is text and wrong in its own way."""
    compiled_methods(spark)
    base = wide(spark, sf_dir).withColumns({
        "s": pick(STATES, F.col("regionkey")),
        "d": pick(DISTRICTS, F.col("nationkey")),
        "c": pick(CROPS, _crop_index()),
        "o": F.col("orderkey") % 8,
        "q": F.col("partkey") % 6,
        "v": F.col("suppkey") % 5,
        "f": F.col("orderkey") % 7,
    })
    line = F.col("linenumber")
    money = F.col("price").cast("decimal(18,2)").cast("string")
    state_raw = (
        F.when(F.col("o") == 1, F.upper("s"))
        .when(F.col("o") == 2, pick(STATE_CODES, F.col("regionkey")))
        .when(F.col("o") == 3, F.regexp_replace("s", " ", ""))
        .when(F.col("o") == 4, F.concat("s", F.lit(" State")))
        .when(F.col("o") == 5, F.concat(F.lit("  "), F.lower("s"), F.lit(" ")))
        .when((F.col("o") == 6) & (line == 7), F.lit("Unknown"))
        .when((F.col("o") == 7) & (line == 6), F.lit(None).cast("string"))
        .otherwise(F.col("s"))
    )
    district_raw = (
        F.when(F.col("q") == 1, F.lower("d"))
        .when(F.col("q") == 2, pick(OLD_DISTRICTS, F.col("nationkey")))
        .when(F.col("q") == 3, F.concat("d", F.lit(" District")))
        .when(F.col("q") == 4, F.concat(F.lit(" "), F.upper("d"), F.lit(" ")))
        .when((F.col("q") == 5) & (line == 5), F.lit("nan"))
        .when(F.col("q") == 5, F.regexp_replace("d", " ", "-"))
        .otherwise(F.col("d"))
    )
    crop_raw = (
        F.when(F.col("v") == 1, pick(OTHER_CROPS, _crop_index()))
        .when(F.col("v") == 4, F.concat(F.lit(" "), F.col("c")))
        .otherwise(F.col("c"))
    )
    price_raw = (
        F.when(line == 2, F.concat(F.lit("Rs "), F.format_number("price", 2)))
        .when(line == 3, F.concat(F.lit("₹"), money))
        .when((line == 4) & (F.col("orderkey") % 10 == 0), F.lit("N/A"))
        .when(line == 5, F.when(F.col("orderkey") % 9 == 0, F.lit("")).otherwise(money))
        .when(line == 6, F.concat(money, F.lit("/kg")))
        .when((line == 7) & (F.col("orderkey") % 11 == 0), F.lit("0"))
        .otherwise(money)
    )
    date_raw = (
        F.when(F.col("f") == 0, F.date_format("date", "dd/MM/yyyy"))
        .when(F.col("f") == 1, F.date_format("date", "dd-MM-yyyy"))
        .when(F.col("f") == 2, F.date_format("date", "yyyy-MM-dd"))
        .when(F.col("f") == 3, F.date_format("date", "dd MMM yyyy"))
        .when(F.col("f") == 4, F.date_format("date", "dd MMMM yyyy"))
        .when(F.col("f") == 5, F.date_format("date", "yyyy-MM"))
        .otherwise(F.lit("13/45/2020"))
    )
    return base.select(
        *TIE[:4], "date", "price", "min_price", "max_price", "data_source", "regionkey", "nationkey",
        F.col("s").alias("state"), F.col("d").alias("district"), F.col("c").alias("crop"),
        state_raw.alias("state_raw"), district_raw.alias("district_raw"), crop_raw.alias("crop_raw"),
        price_raw.alias("price_raw"), date_raw.alias("date_raw"),
    )


def apmc_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market-level rows: the district is only visible in the market's name."""
    r = raw_obs(spark, sf_dir)
    k = F.col("orderkey") % 7
    apmc = (
        F.when(k == 0, F.concat("district", F.lit(" APMC")))
        .when(k == 1, F.concat(F.upper("district"), F.lit(" Mandi")))
        .when(k == 2, F.concat("state", F.lit(" Yard")))
        .when(k == 3, F.concat("state", F.lit(" "), F.col("district"), F.lit(" market")))
        .when(k == 4, F.lit("Central Yard No 1"))
        .when(k == 5, F.concat(F.lit("New "), F.col("district")))
        .otherwise(F.concat(F.lit("Depot "), F.col("nationkey").cast("string")))
    )
    return r.withColumns({
        "apmc": apmc,
        "given_state": F.when(F.col("partkey") % 3 == 0, F.col("state_raw")),
        "given_district": F.when(F.col("partkey") % 6 == 0, F.col("district_raw")),
    })


def pred_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction log from the event stream table (batch or streaming input alike)."""
    return log_columns(table(spark, sf_dir, "events"))


def log_columns(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    value = F.col("value")
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("model"),
        F.when(F.col("user_id") % 7 != 0, value).alias("actual"),
        F.when(F.col("user_id") % 11 != 0, value * (1 + (k - 50) / 1000)).alias("predicted"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("failure "), (F.col("user_id") % 3).cast("string")))
        .alias("error"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every known series once, plus a planted unknown crop and an unknown district per series."""
    known = named(spark, sf_dir).select(*SERIES).distinct()
    as_of = F.lit("2001-06-30").cast("date")
    # Upper-case and padded spellings must still match; suffixed ones must not.
    return known.select(
        F.explode(F.array(
            F.struct(F.concat(F.lit(" "), F.upper("crop")).alias("crop"), F.lower("state").alias("state"),
                     F.col("district").alias("district"), F.lit("known").alias("kind")),
            F.struct(F.col("crop").alias("crop"), F.col("state").alias("state"),
                     F.concat("district", F.lit(" East")).alias("district"), F.lit("district").alias("kind")),
            F.struct(F.concat("crop", F.lit(" Mix")).alias("crop"), F.col("state").alias("state"),
                     F.col("district").alias("district"), F.lit("crop").alias("kind")),
            F.struct(F.col("crop").alias("crop"), F.concat("state", F.lit(" North")).alias("state"),
                     F.col("district").alias("district"), F.lit("state").alias("kind")),
        )).alias("r"),
    ).select("r.*").withColumn("target_date", as_of)
