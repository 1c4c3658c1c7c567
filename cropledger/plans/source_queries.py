"""Registered queries: sources, sinks and standardisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import is_placeholder, rounded, to_date_any, to_int, to_number
from ..operators import standardize as std
from ..session import new_path
from ..sources import ingest as ing
from ..sources import payloads as pay
from ..sources.views import named, obs, raw_obs
from .catalog import query
from .feature_queries import W
from .sqltext import R, any_date, num, with_named, with_obs, with_raw

AS_OF = "2001-06-30"
PK = "orderkey, linenumber, partkey, suppkey"
PANEL = ", ".join(ing.PANEL)


@query("scan_panel", with_named(f"SELECT {PANEL} FROM named"))
def scan_panel(spark, sf_dir):
    path = new_path(spark, "panel-csv")
    named(spark, sf_dir).select(*ing.PANEL).write.option("header", True).csv(path)
    return ing.scan_panel(spark, path)


@query("scan_pruned", with_obs("SELECT state, district, crop FROM obs"))
def scan_pruned(spark, sf_dir):
    return ing.scan_pruned(obs(spark, sf_dir), ["state", "district", "crop"])


@query("scan_multi_file", with_named("""SELECT strftime(date, '%Y-%m-%d') AS date, state, district, crop || ' é' AS crop,
   CASE WHEN data_source <> 'datagov' THEN CAST(CAST(price AS DECIMAL(18,2)) AS VARCHAR) END AS price,
   CASE WHEN data_source = 'datagov' THEN CAST(CAST(price AS DECIMAL(18,2)) AS VARCHAR) END AS modal_price,
   CASE WHEN data_source = 'enam' THEN linenumber::VARCHAR END AS variety FROM named"""))
def scan_multi_file(spark, sf_dir):
    """One folder with files of two encodings and of other columns in another order, and a folder of its own."""
    base = named(spark, sf_dir).select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), "state", "district", F.concat("crop", F.lit(" é")).alias("crop"),
        pay.money(F.col("price")).alias("price"), F.col("linenumber").cast("string").alias("variety"), "data_source")
    root = new_path(spark, "csv-tree")
    plan = {"enam": ("UTF-8", "mixed", ["date", "state", "district", "crop", "price", "variety"]),
            "agmarknet": ("ISO-8859-1", "mixed", ["price", "crop", "district", "state", "date"]),
            "datagov": ("UTF-8", "portal", ["date", "state", "district", "crop", "price"])}
    for source, (encoding, folder, cols) in plan.items():
        part = base.filter(F.col("data_source") == source).select(*cols)
        if source == "datagov":
            part = part.withColumnRenamed("price", "modal_price")
        part.write.option("header", True).option("encoding", encoding).csv(f"{root}/{folder}/{source}")
    folders = [f"{root}/{f}" for f in ("mixed", "portal", "missing")]
    return ing.scan_multi_file(spark, folders).select("date", "state", "district", "crop", "price", "modal_price", "variety")


_TWO = """FROM (SELECT *, 0 AS shift, '' AS tail FROM named UNION ALL SELECT *, 1 AS shift, ' Rural' AS tail FROM named)"""
_REC = f"""SELECT {PK}, crop AS commodity, state, district || tail AS district,
   CAST(CAST(price + shift AS DECIMAL(18,2)) AS VARCHAR) AS price, strftime(date, '%Y-%m-%d') AS date {_TWO}"""


@query("ingest_json_envelope", with_named(_REC))
def ingest_json_envelope(spark, sf_dir):
    return ing.ingest_json_envelope(pay.envelopes(spark, sf_dir), "payload", pay.KEYS)


@query("harvest_embedded_json", with_named(_REC))
def harvest_embedded_json(spark, sf_dir):
    return ing.harvest_embedded_json(pay.script_pages(spark, sf_dir), "html", pay.KEYS)


_M = "CAST(CAST(price {0} AS DECIMAL(18,2)) AS VARCHAR)"
_LOW, _MID, _HIGH, _DAY = _M.format("- 1"), _M.format(""), _M.format("+ 1"), "strftime(date, '%d/%m/%Y')"
_CELLS = f"""CASE orderkey % 3
   WHEN 0 THEN [crop, state, district, {_LOW}, {_HIGH}, 'Rs ' || {_MID}, {_DAY}]
   WHEN 1 THEN [crop, district || ' & Co', {_MID}, {_DAY}] ELSE [crop, {_DAY}, {_MID}, {_LOW}, {_HIGH}] END"""
_HEADS = "CASE orderkey % 3 " + " ".join(
    f"{w} [{', '.join(repr(h) for h in hs)}]" for w, hs in zip(("WHEN 0 THEN", "WHEN 1 THEN", "ELSE"), pay.HEADERS)) + " END"


@query("harvest_html_tables", with_named(f"""SELECT {PK}, 1 AS table_no, 1 AS row_no, i::INT AS col_no, h[i + 1] AS header, c[i + 1] AS cell
   FROM (SELECT {PK}, {_HEADS} AS h, {_CELLS} AS c, unnest(range(0, len({_HEADS}))) AS i FROM named)"""))
def harvest_html_tables(spark, sf_dir):
    return ing.harvest_html_tables(pay.table_pages(spark, sf_dir), "html", pay.KEYS)


@query("harvest_data_attributes", with_named(f"""SELECT {PK}, 0 AS div_no, 'commodity' AS attribute, crop AS value FROM named
   UNION ALL SELECT {PK}, 0, 'price', {_MID} FROM named UNION ALL SELECT {PK}, 1, 'price', {_HIGH} FROM named"""))
def harvest_data_attributes(spark, sf_dir):
    return ing.harvest_data_attributes(pay.attribute_pages(spark, sf_dir), "html", pay.KEYS)


@query("route_header_cells", with_named(f"""SELECT 'mandi' AS kind, {PK}, crop, {_DAY} AS date,
   CASE WHEN orderkey % 3 = 0 THEN {_LOW} END AS min_price, CASE WHEN orderkey % 3 = 0 THEN {_HIGH} END AS max_price,
   CASE WHEN orderkey % 3 = 0 THEN 'Rs ' || {_MID} ELSE {_MID} END AS price,
   CASE WHEN orderkey % 3 = 0 THEN state END AS state, CASE WHEN orderkey % 3 = 0 THEN district ELSE district || ' & Co' END AS district
   FROM named WHERE orderkey % 3 < 2
   UNION ALL SELECT 'exchange', {PK}, crop, {_DAY}, {_LOW}, {_HIGH}, CASE WHEN orderkey % 3 = 0 THEN 'Rs ' || {_MID} ELSE {_MID} END, NULL, NULL
   FROM named WHERE orderkey % 3 <> 1"""))
def route_header_cells(spark, sf_dir):
    pages = pay.table_pages(spark, sf_dir).withColumn("page", F.md5("html"))  # equal pages of equal keys are one
    out = []
    for kind in ("mandi", "exchange"):
        cells = ing.harvest_html_tables(pages, "html", [*pay.KEYS, "page"], kind)
        routed = std.route_header_cells(cells, [*pay.KEYS, "page", "table_no", "row_no"], kind == "exchange")
        out.append(routed.withColumn("kind", F.lit(kind)))
    both = out[0].unionByName(out[1], allowMissingColumns=True)
    return both.select("kind", *pay.KEYS, "crop", "date", "min_price", "max_price", "price", "state", "district")


@query("inline_daily_arrays", f"""WITH {W}, n AS (SELECT *, row_number() OVER (PARTITION BY state, district, year(date) ORDER BY date DESC) AS r FROM weather)
   SELECT state, district, date, temperature_2m_max, temperature_2m_min,
   CASE WHEN year(date) % 2 = 0 AND r <= 2 THEN NULL ELSE precipitation_sum END AS precipitation_sum FROM n""")
def inline_daily_arrays(spark, sf_dir):
    values = ["temperature_2m_max", "temperature_2m_min", "precipitation_sum"]
    return ing.inline_daily_arrays(pay.weather_payloads(spark, sf_dir), "daily", ["state", "district"], values)


@query("load_location_crop_map", with_named("SELECT DISTINCT state, district, crop FROM named"))
def load_location_crop_map(spark, sf_dir):
    return ing.load_location_crop_map(pay.crop_map_payloads(spark, sf_dir), "payload")


@query("write_panel", with_named(f"SELECT {PANEL} FROM named"))
def write_panel(spark, sf_dir):
    path = new_path(spark, "panel")
    ing.write_panel(named(spark, sf_dir).select(*ing.PANEL), path)
    return spark.read.schema(ing.PANEL_SCHEMA).parquet(path).select(*ing.PANEL)


@query("write_report", with_obs("""SELECT count(*) AS records, strftime(min(date), '%Y-%m-%d') AS first_date,
   strftime(max(date), '%Y-%m-%d') AS last_date, count(DISTINCT crop) AS crops FROM obs"""))
def write_report(spark, sf_dir):
    from ..operators.profile import dataset_summary

    s = dataset_summary(obs(spark, sf_dir))
    report = s.select(F.col("total_records").alias("records"), F.struct("min_date", "max_date").alias("dates"),
                      F.struct("crops").alias("counts"))
    path = new_path(spark, "report")
    ing.write_report(report, path)
    back = spark.read.schema("records bigint, dates struct<min_date:string,max_date:string>, counts struct<crops:bigint>").json(path)
    return back.select("records", F.col("dates.min_date").alias("first_date"), F.col("dates.max_date").alias("last_date"),
                       F.col("counts.crops").alias("crops"))


# ---- adapters

def _text(spark, sf_dir):
    return raw_obs(spark, sf_dir).withColumns({
        "money": pay.money(F.col("price")), "low": pay.money(F.col("price") - 1), "high": pay.money(F.col("price") + 1)})


def _dealt() -> Column:
    """The price as text, with some lots that were not sold: zero and below."""
    return F.when(F.col("linenumber") == 5, F.lit("0")).when(F.col("linenumber") == 6, F.lit("-1.50")).otherwise(F.col("money"))


_BOUNDS = "price - 1 AS min_price, price + 1 AS max_price"


def _r2(df):
    return rounded(df, **{c: 2 for c in ("price", "min_price", "max_price") if c in df.columns})


_PRICES = "round(price, 2) AS price, round(price - 1, 2) AS min_price, round(price + 1, 2) AS max_price"


@query("resolve_column_aliases", with_raw("""SELECT strftime(date, '%m/%d/%Y') AS date, state, district, crop,
   CAST(CAST(price AS DECIMAL(18,2)) AS VARCHAR) AS price, CAST(CAST(price + 1 AS DECIMAL(18,2)) AS VARCHAR) AS max_price,
   orderkey AS "Lot Id" FROM raw_obs"""))
def resolve_column_aliases(spark, sf_dir):
    t = _text(spark, sf_dir)
    raw = t.select(F.date_format("date", "MM/dd/yyyy").alias("Reported Date"), F.col("state").alias("State Name"),
                   F.col("district").alias("District-Name"), F.col("crop").alias("COMMODITY"), F.col("money").alias("Modal Price"),
                   F.col("high").alias("max price"), F.col("orderkey").alias("Lot Id"))
    return std.resolve_column_aliases(raw)


@query("rename_common", with_raw("""SELECT date, state, district, CASE WHEN linenumber % 2 = 0 THEN crop ELSE crop_raw END AS crop,
   CASE WHEN linenumber % 3 = 0 THEN round(price, 2) ELSE round(price + 1, 2) END AS price, orderkey FROM raw_obs"""))
def rename_common(spark, sf_dir):
    line = F.col("linenumber")
    raw = raw_obs(spark, sf_dir).select(
        F.col("date").alias("Date"), F.col("state").alias("State"), F.col("district").alias("District"),
        F.when(line % 2 == 0, F.col("crop")).alias("Crop"), F.col("crop_raw").alias("Commodity"),
        F.when(line % 3 == 0, F.col("price")).alias("Price"), (F.col("price") + 1).alias("Modal_Price"), "orderkey")
    return _r2(std.rename_common(raw))


@query("adapt_reported_date", with_raw(f"""SELECT date, state_raw AS state, district_raw AS district, crop_raw AS crop, {_PRICES},
   'reported' AS data_source FROM raw_obs WHERE state_raw IS NOT NULL AND orderkey % 13 <> 0 AND linenumber NOT IN (5, 6)"""))
def adapt_reported_date(spark, sf_dir):
    raw = _text(spark, sf_dir).select(
        F.when(F.col("orderkey") % 13 == 0, F.lit("31/31/2020")).otherwise(F.date_format("date", "M/d/yyyy")).alias("Reported Date"),
        F.col("state_raw").alias("State Name"), F.col("district_raw").alias("District Name"), F.col("crop_raw").alias("Commodity"),
        _dealt().alias("Modal Price (Rs./Quintal)"), F.col("low").alias("Min Price (Rs./Quintal)"),
        F.col("high").alias("Max Price (Rs./Quintal)"))
    return std.adapt_reported_date(raw)


@query("adapt_arrival_date", with_raw(f"""SELECT date, state_raw AS state, district_raw AS district, crop_raw AS crop, {_PRICES},
   'arrival' AS data_source FROM raw_obs WHERE state_raw IS NOT NULL AND linenumber NOT IN (4, 5, 6)"""))
def adapt_arrival_date(spark, sf_dir):
    raw = _text(spark, sf_dir).select(
        F.date_format("date", "dd/MM/yyyy").alias("Arrival_Date"), F.col("state_raw").alias("State"),
        F.col("district_raw").alias("District"), F.col("crop_raw").alias("Commodity"),
        F.when(F.col("linenumber") == 4, F.lit("NR")).otherwise(_dealt()).alias("Modal_x0020_Price"),
        F.col("low").alias("Min_x0020_Price"), F.col("high").alias("Max_x0020_Price"))
    return std.adapt_arrival_date(raw)


@query("adapt_year_month", with_raw("""SELECT date_trunc('month', date)::DATE AS date, state_raw AS state, 'Unknown' AS district,
   trim(crop_raw) AS crop, round(price, 2) AS price, (orderkey % 40)::DOUBLE AS temperature, (partkey % 9)::DOUBLE AS rainfall,
   'monthly' AS data_source, 'monthly rates' AS source_dataset FROM raw_obs
   WHERE state_raw IS NOT NULL AND linenumber NOT IN (5, 6) AND orderkey % 17 > 1"""))
def adapt_year_month(spark, sf_dir):
    raw = _text(spark, sf_dir).select(
        F.when(F.col("orderkey") % 17 == 1, F.lit("NR")).otherwise(F.year("date").cast("string")).alias("Year"),
        F.when(F.col("orderkey") % 17 == 0, F.lit("13")).otherwise(F.month("date").cast("string")).alias("Month"), F.col("state_raw").alias("State"),
        F.col("crop_raw").alias("Crop "), _dealt().alias("Wholesale_Price [Rs. Per Quintal]"),
        (F.col("orderkey") % 40).cast("string").alias("Temperature (Celsis)"), (F.col("partkey") % 9).cast("string").alias("Rainfall in mm"))
    return std.adapt_year_month(raw, "monthly rates")


@query("adapt_item_price", with_raw("""SELECT date, 'Unknown' AS state, 'Unknown' AS district, crop_raw AS crop,
   round(price, 2) AS price, 'items' AS data_source FROM raw_obs WHERE linenumber NOT IN (5, 6)"""))
def adapt_item_price(spark, sf_dir):
    raw = _text(spark, sf_dir).select(F.date_format("date", "MM/dd/yyyy").alias("Date"), F.col("crop_raw").alias("Item_Name"),
                                      _dealt().alias("Price"))
    return std.adapt_item_price(raw)


@query("adapt_enam", with_raw(f"""SELECT CASE WHEN orderkey % 7 < 5 THEN date ELSE DATE '{AS_OF}' END AS date,
   CASE WHEN lower(trim(state_raw)) <> 'nan' THEN trim(state_raw) END AS state,
   CASE WHEN lower(trim(district_raw)) <> 'nan' THEN trim(district_raw) END AS district, trim(crop_raw) AS crop,
   round(price, 2) AS price, round(price - 1, 2) AS min_price, round(price + 1, 2) AS max_price, district || ' APMC' AS apmc
   FROM raw_obs WHERE orderkey % 5 <> 0 AND partkey % 7 <> 0"""))
def adapt_enam(spark, sf_dir):
    raw = _text(spark, sf_dir).select(
        F.col("crop_raw").alias("Commodity"), F.col("state_raw").alias("State"), F.col("district_raw").alias("District"),
        F.when(F.col("orderkey") % 5 == 0, F.lit(" nan ")).when(F.col("partkey") % 7 == 0, F.lit(" "))
        .otherwise(F.concat("district", F.lit(" APMC "))).alias("APMC Name"),
        F.col("date_raw").alias("Date"), F.concat(F.lit("Rs "), "low").alias("Min Price"),
        F.concat(F.lit("Rs"), F.format_number(F.col("price") + 1, 2)).alias("Max Price"))
    return _r2(std.adapt_enam(raw, AS_OF))


@query("adapt_commodityonline", with_raw(f"""SELECT {any_date('date_raw', AS_OF)} AS date, trim(coalesce(state_raw, 'nan')) AS state,
   '' AS district, trim(crop_raw) AS crop, {num('price_raw')} AS price, NULL::DOUBLE AS min_price, {num('price_raw')} AS max_price
   FROM raw_obs WHERE {num('price_raw')} > 0"""))
def adapt_commodityonline(spark, sf_dir):
    raw = raw_obs(spark, sf_dir).select(F.col("date_raw").alias("date"), F.col("state_raw").alias("state"),
                                        F.col("crop_raw").alias("crop"), F.col("price_raw").alias("price"), F.col("price_raw").alias("max_price"))
    return std.adapt_commodityonline(raw, AS_OF)


@query("adapt_exchange", with_raw(f""", q AS (SELECT {any_date('date_raw', AS_OF)} AS date, trim(crop_raw) AS crop,
   round(CASE WHEN linenumber = 2 THEN price ELSE ((price - 1) + (price + 1)) / 2 END, 2) AS price,
   round(price - 1, 2) AS min_price, round(price + 1, 2) AS max_price FROM raw_obs),
   w AS (SELECT DISTINCT crop, state, district FROM raw_obs)
   SELECT q.*, state, district FROM q JOIN w USING (crop)"""))
def adapt_exchange(spark, sf_dir):
    t = _text(spark, sf_dir)
    raw = t.select(
        F.col("date_raw").alias("date"), F.col("crop_raw").alias("commodity"),
        F.when(F.col("linenumber") == 2, F.concat(F.lit("Rs "), "money")).alias("spot_price"),
        F.col("low").alias("low_price"), F.col("high").alias("high_price"))
    return std.adapt_exchange(raw, t, AS_OF, digits=2).select(
        "crop", "date", "price", "min_price", "max_price", "state", "district")


@query("adapt_datagov", with_raw("""SELECT date, state, district, district || ' Market' AS market, crop, 'Local' AS variety,
   round(price, 2) AS price, round(price - 1, 2) AS min_price, NULL::DOUBLE AS max_price FROM raw_obs WHERE orderkey % 7 < 5 AND linenumber <> 6"""))
def adapt_datagov(spark, sf_dir):
    raw = _text(spark, sf_dir).select(
        "state", "district", F.concat("district", F.lit(" Market")).alias("market"), F.col("crop").alias("commodity"),
        F.lit("Local").alias("variety"), F.when(F.col("linenumber") == 6, F.lit("NA")).otherwise(F.col("money")).alias("modal_price"),
        F.col("low").alias("min_price"), F.lit("none").alias("max_price"), F.col("date_raw").alias("arrival_date"))
    return std.adapt_datagov(raw)


@query("adapt_agmarknet", with_raw(f"""SELECT {any_date('date_raw')} AS date, crop, state, district, district || ' Market' AS market,
   round(price, 2) AS price FROM raw_obs WHERE linenumber <> 6"""))
def adapt_agmarknet(spark, sf_dir):
    raw = _text(spark, sf_dir).select(
        F.col("crop").alias("cmdt_name"), F.col("state").alias("state_name"), F.col("district").alias("district_name"),
        F.concat("district", F.lit(" Market")).alias("market_name"), F.col("date_raw").alias("arrival_date"),
        F.when(F.col("linenumber") != 6, F.col("money")).alias("modal_price"))
    return std.adapt_agmarknet(raw).select("date", "crop", "state", "district", "market", "price")


@query("adapt_state_board", with_raw(f"""SELECT {any_date('date_raw')} AS date, coalesce(state_raw, 'Maharashtra') AS state, district,
   district || ' Yard' AS market, crop, round(price, 2) AS price FROM raw_obs"""))
def adapt_state_board(spark, sf_dir):
    raw = _text(spark, sf_dir).select(
        F.col("date_raw").alias("arrival_date"), F.col("state_raw").alias("state"), "district",
        F.concat("district", F.lit(" Yard")).alias("market_name"), F.col("crop").alias("commodity"), F.col("money").alias("modal_price"))
    return std.adapt_state_board(raw)


@query("parse_dates_multi", with_raw(f"SELECT {PK}, date_raw, {any_date('date_raw', AS_OF)} AS parsed_date FROM raw_obs"))
def parse_dates_multi(spark, sf_dir):
    return std.parse_dates_multi(raw_obs(spark, sf_dir), "date_raw", AS_OF).select(*pay.KEYS, "date_raw", "parsed_date")


@query("parse_month_strings", with_raw(f"""SELECT {PK}, date_raw,
   coalesce(CAST(TRY_STRPTIME(trim(date_raw), '%Y-%m') AS DATE), {any_date('date_raw')}) AS parsed_date FROM raw_obs"""))
def parse_month_strings(spark, sf_dir):
    return std.parse_month_strings(raw_obs(spark, sf_dir), "date_raw").select(*pay.KEYS, "date_raw", "parsed_date")


@query("coerce_numeric", with_raw(f"""SELECT {PK}, price_raw, {num('price_raw')} AS as_number, coalesce({num('price_raw')}, 0)::DOUBLE AS with_default,
   coalesce(CAST(floor({num('price_raw')}) AS BIGINT), -1) AS as_int FROM raw_obs"""))
def coerce_numeric(spark, sf_dir):
    return raw_obs(spark, sf_dir).select(
        *pay.KEYS, "price_raw", to_number("price_raw").alias("as_number"), to_number("price_raw", 0.0).alias("with_default"),
        to_int("price_raw", -1).alias("as_int"))


@query("derive_price", with_raw(f"""SELECT {PK}, {R('''coalesce(CASE WHEN linenumber = 1 THEN price END, CASE WHEN linenumber = 2 THEN price + 5 END,
   (CASE WHEN linenumber <> 4 THEN price - 1 END + CASE WHEN linenumber <> 5 THEN price + 3 END) / 2,
   CASE WHEN linenumber <> 4 THEN price - 1 END, CASE WHEN linenumber <> 5 THEN price + 3 END)''')} AS derived FROM raw_obs"""))
def derive_price(spark, sf_dir):
    line, p = F.col("linenumber"), F.col("price")
    return raw_obs(spark, sf_dir).select(*pay.KEYS, F.round(std.derive_price(
        F.when(line == 1, p), F.when(line == 2, p + 5), F.when(line != 4, p - 1), F.when(line != 5, p + 3)), 4).alias("derived"))


@query("tag_source", with_obs(f"SELECT {PK}, 'portal' AS data_source, 'batch-1' AS source_dataset FROM obs"))
def tag_source(spark, sf_dir):
    return std.tag_source(obs(spark, sf_dir), "portal", "batch-1").select(*pay.KEYS, "data_source", "source_dataset")


@query("project_panel", with_obs("SELECT date, state, district, crop, price, min_price, max_price, data_source FROM obs"))
def project_panel(spark, sf_dir):
    return std.project_panel(obs(spark, sf_dir))
