"""Registered queries: filters, de-duplication, order, union, catalogue and request validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import to_number
from ..operators import clean as cl
from ..operators import locations as loc
from ..operators import profile as pr
from ..sources.payloads import KEYS as PKS
from ..sources.views import ORDER, TIE, named, obs, raw_obs, requests
from .catalog import query
from .source_queries import PK
from .sqltext import ORDER as ORDER_SQL, R, TIE as TIE_SQL, num, with_named, with_obs, with_raw

RAW_COLS = [*PKS, "date", "state_raw", "district_raw", "crop_raw", "price_raw"]
RAWC = ", ".join(RAW_COLS)


def _numbered(spark, sf_dir):
    return raw_obs(spark, sf_dir).select(*RAW_COLS, to_number("price_raw").alias("price"))


@query("drop_missing_essentials", with_raw(f"""SELECT {RAWC}, {num('price_raw')} AS price FROM raw_obs
   WHERE state_raw IS NOT NULL AND {num('price_raw')} IS NOT NULL"""))
def drop_missing_essentials(spark, sf_dir):
    return cl.drop_missing_essentials(_numbered(spark, sf_dir), ["state_raw", "district_raw", "crop_raw", "price", "date"])


@query("filter_valid_price", with_raw(f"SELECT {RAWC}, {num('price_raw')} AS price FROM raw_obs WHERE {num('price_raw')} > 0"))
def filter_valid_price(spark, sf_dir):
    return cl.filter_valid_price(_numbered(spark, sf_dir))


_KNOWN = "lower(trim({0})) NOT IN ('unknown', 'nan', '')"


@query("filter_unknown", with_raw(f"SELECT {RAWC} FROM raw_obs WHERE {_KNOWN.format('state_raw')} AND {_KNOWN.format('district_raw')}"))
def filter_unknown(spark, sf_dir):
    return cl.filter_unknown(raw_obs(spark, sf_dir).select(*RAW_COLS), ["state_raw", "district_raw"])


@query("dedupe_series_day", with_obs(f"""SELECT {PK}, date, state, district, crop, price FROM obs
   QUALIFY row_number() OVER (PARTITION BY state, district, crop, date ORDER BY {ORDER_SQL}) = 1"""))
def dedupe_series_day(spark, sf_dir):
    return cl.dedupe_series_day(obs(spark, sf_dir), ORDER).select(*PKS, "date", "state", "district", "crop", "price")


def _copies(spark, sf_dir):
    """The panel with every third lot reported twice and a rounded price, so that observations repeat."""
    o = obs(spark, sf_dir).withColumn("price", F.round(F.col("price") / 1000, 0))
    return o.withColumn("copy", F.lit(0)).unionByName(o.filter("orderkey % 3 = 0").withColumn("copy", F.lit(1)))


_COPIES = """, copies AS (SELECT * REPLACE (round(price / 1000, 0) + 0.0 AS price), 0 AS copy FROM obs
   UNION ALL SELECT * REPLACE (round(price / 1000, 0) + 0.0 AS price), 1 AS copy FROM obs WHERE orderkey % 3 = 0)"""


@query("dedupe_observation", with_obs(_COPIES + f""" SELECT {PK}, date, state, district, crop, price, copy FROM copies
   QUALIFY row_number() OVER (PARTITION BY state, district, date, crop, price ORDER BY {ORDER_SQL}, max_price, min_price, copy) = 1"""))
def dedupe_observation(spark, sf_dir):
    return cl.dedupe_observation(_copies(spark, sf_dir), [*ORDER, "max_price", "min_price", "copy"]).select(
        *PKS, "date", "state", "district", "crop", "price", "copy")


@query("dedupe_full_row", with_obs(_COPIES + " SELECT DISTINCT state, district, crop, date, price FROM copies"))
def dedupe_full_row(spark, sf_dir):
    return cl.dedupe_full_row(_copies(spark, sf_dir).select("state", "district", "crop", "date", "price"))


@query("dedupe_audit", with_obs(_COPIES + """, a AS (SELECT 'series_day' AS stage, count(*) AS rows_before,
     count(DISTINCT (state, district, crop, date)) AS rows_after FROM copies
   UNION ALL SELECT 'observation', count(*), count(DISTINCT (state, district, date, crop, price)) FROM copies)
   SELECT *, rows_before - rows_after AS removed FROM a"""))
def dedupe_audit(spark, sf_dir):
    return cl.dedupe_audit(_copies(spark, sf_dir), {"series_day": cl.SERIES_DAY, "observation": cl.OBSERVATION})


@query("match_key_ci", with_raw(f"""SELECT {RAWC} FROM raw_obs WHERE lower(trim(state_raw)) = 'karnataka'
   AND lower(trim(district_raw)) = 'mysuru' AND lower(trim(crop_raw)) = 'rice'"""))
def match_key_ci(spark, sf_dir):
    return cl.match_key_ci(raw_obs(spark, sf_dir).select(*RAW_COLS), state_raw=" KARNATAKA", district_raw="mysuru ", crop_raw="Rice")


@query("match_contains_ci", with_raw(f"""SELECT {RAWC} FROM raw_obs WHERE contains(lower(state_raw), 'tamil') AND contains(lower(crop_raw), 'tomato')"""))
def match_contains_ci(spark, sf_dir):
    return cl.match_contains_ci(raw_obs(spark, sf_dir).select(*RAW_COLS), state_raw="TAMIL", crop_raw="Tomato")


@query("filter_previous_week", with_obs(f"SELECT {PK}, date, price FROM obs WHERE date BETWEEN DATE '2000-06-16' AND DATE '2000-06-23'"))
def filter_previous_week(spark, sf_dir):
    return cl.filter_previous_week(obs(spark, sf_dir), "2000-06-30").select(*PKS, "date", "price")


@query("sanitize_nonfinite", with_obs(f""", b AS (SELECT {PK}, CASE linenumber WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE price END AS v,
     CASE WHEN linenumber = 4 THEN NULL ELSE min_price END AS w FROM obs)
   SELECT {PK}, {R('coalesce(v, (SELECT avg(v) FROM b))')} AS v, {R('coalesce(w, (SELECT avg(w) FROM b))')} AS w FROM b"""))
def sanitize_nonfinite(spark, sf_dir):
    line = F.col("linenumber")
    raw = obs(spark, sf_dir).select(
        *PKS, F.when(line == 1, F.lit(float("nan"))).when(line == 2, F.lit(float("inf"))).when(line == 3, F.lit(float("-inf")))
        .otherwise(F.col("price")).alias("v"), F.when(line == 4, F.lit(float("nan"))).otherwise(F.col("min_price")).alias("w"))
    out = cl.sanitize_nonfinite(raw, ["v", "w"])
    return out.withColumns({"v": F.round("v", 4), "w": F.round("w", 4)})


@query("sort_panel", with_obs(f"SELECT {PK}, date, price FROM obs ORDER BY {ORDER_SQL}"))
def sort_panel(spark, sf_dir):
    return cl.sort_panel(obs(spark, sf_dir), ORDER).select(*PKS, "date", "price")


@query("limit_rows", with_obs(f"SELECT {PK}, date, price FROM obs ORDER BY {ORDER_SQL} LIMIT 500"))
def limit_rows(spark, sf_dir):
    return cl.limit_rows(obs(spark, sf_dir).select(*PKS, "date", "price"), 500, ORDER)


@query("union_sources", with_obs("""SELECT date, crop, price, min_price, NULL AS variety FROM obs WHERE data_source = 'enam'
   UNION ALL SELECT date, crop, price, NULL, 'std' FROM obs WHERE data_source = 'agmarknet'
   UNION ALL SELECT date, crop, price, min_price, 'open' FROM obs WHERE data_source = 'datagov'"""))
def union_sources(spark, sf_dir):
    o = obs(spark, sf_dir)
    return cl.union_sources([
        o.filter("data_source = 'enam'").select("date", "crop", "price", "min_price"),
        o.filter("data_source = 'agmarknet'").select("date", "crop", "price", F.lit("std").alias("variety")),
        o.filter("data_source = 'datagov'").select(F.lit("open").alias("variety"), "min_price", "price", "crop", "date")])


@query("merge_sources", with_obs(_COPIES + f""" SELECT date, state, district, crop, price, min_price, max_price, data_source FROM copies
   QUALIFY row_number() OVER (PARTITION BY state, district, date, crop, price ORDER BY {ORDER_SQL}, max_price, min_price, copy) = 1"""))
def merge_sources(spark, sf_dir):
    c = _copies(spark, sf_dir)
    first = c.filter("copy = 0").withColumnsRenamed({"crop": "Commodity", "price": "Modal_Price", "date": "Date"})
    second = c.filter("copy = 1").withColumnsRenamed({"state": "State", "min_price": "Min_Price"})
    return cl.merge_sources([first, second], [*ORDER, "max_price", "min_price", "copy"])


# ---- catalogue

_RAWK = f"WHERE {_KNOWN.format('state_raw')}"


def _listed(spark, sf_dir):
    return raw_obs(spark, sf_dir).select(F.trim("state_raw").alias("state"), F.trim("district_raw").alias("district"), F.trim("crop_raw").alias("crop"))


@query("list_states", with_raw(f"SELECT DISTINCT trim(state_raw) AS state FROM raw_obs {_RAWK}"))
def list_states(spark, sf_dir):
    return loc.list_states(_listed(spark, sf_dir))


@query("list_districts", with_raw(f"""SELECT DISTINCT trim(state_raw) AS state, trim(district_raw) AS district FROM raw_obs {_RAWK}
   AND {_KNOWN.format('district_raw')}"""))
def list_districts(spark, sf_dir):
    return loc.list_districts(_listed(spark, sf_dir))


_CROPS = f""", l AS (SELECT trim(state_raw) AS state, trim(district_raw) AS district, string_agg(DISTINCT trim(crop_raw), '|' ORDER BY trim(crop_raw)) AS crops,
   count(DISTINCT trim(crop_raw)) AS n FROM raw_obs {_RAWK} AND {_KNOWN.format('district_raw')} GROUP BY 1, 2)"""


@query("list_crops", with_raw(_CROPS + " SELECT state, district, crops FROM l"))
def list_crops(spark, sf_dir):
    return loc.list_crops(_listed(spark, sf_dir)).withColumn("crops", F.array_join("crops", "|"))


@query("location_info", with_raw(_CROPS + """, p AS (SELECT DISTINCT state, district FROM l UNION SELECT DISTINCT state, district || ' Extra' FROM l)
   SELECT state, district, coalesce(n, 0)::INT AS crop_count, crops, (n IS NOT NULL)::INT AS has_data FROM p LEFT JOIN l USING (state, district)"""))
def location_info(spark, sf_dir):
    names = _listed(spark, sf_dir)
    places = loc.list_districts(names).select("state", F.explode(F.array("district", F.concat("district", F.lit(" Extra")))).alias("district"))
    return loc.location_info(places, names).withColumn("crops", F.array_join("crops", "|"))


_REQ = """, known AS (SELECT DISTINCT crop, state, district FROM named), req AS (
   SELECT ' ' || upper(crop) AS crop, lower(state) AS state, district, 'known' AS kind FROM known
   UNION ALL SELECT crop, state, district || ' East', 'district' FROM known
   UNION ALL SELECT crop || ' Mix', state, district, 'crop' FROM known
   UNION ALL SELECT crop, state || ' North', district, 'state' FROM known)"""


@query("semi_valid_combinations", with_named(_REQ + " SELECT crop, state, district, kind FROM req WHERE kind = 'known'"))
def semi_valid_combinations(spark, sf_dir):
    return loc.semi_valid_combinations(requests(spark, sf_dir), named(spark, sf_dir)).drop("target_date")


@query("anti_invalid_combinations", with_named(_REQ + """ SELECT crop, state, district, kind,
   'No data for ' || crop || ' in ' || district || ', ' || state AS error FROM req WHERE kind <> 'known'"""))
def anti_invalid_combinations(spark, sf_dir):
    return loc.anti_invalid_combinations(requests(spark, sf_dir), named(spark, sf_dir)).drop("target_date")


@query("cross_location_dates", with_named("""SELECT state, district, crop, CAST(unnest(generate_series(DATE '2001-06-01', DATE '2001-06-30', INTERVAL 1 DAY)) AS DATE) AS date
   FROM (SELECT DISTINCT state, district, crop FROM named WHERE crop = 'Wheat')"""))
def cross_location_dates(spark, sf_dir):
    return loc.cross_location_dates(named(spark, sf_dir), "wheat", "2001-06-01", "2001-06-30")


@query("cross_crop_dates", with_named("""SELECT state, district, crop, CAST(unnest(generate_series(DATE '2001-06-01', DATE '2001-06-10', INTERVAL 1 DAY)) AS DATE) AS date
   FROM (SELECT DISTINCT state, district, crop FROM named WHERE state = 'Kerala' AND district = 'Ernakulam' AND crop IN ('Rice', 'Onion', 'Saffron'))"""))
def cross_crop_dates(spark, sf_dir):
    return loc.cross_crop_dates(named(spark, sf_dir), "Kerala", "Ernakulam", "2001-06-01", "2001-06-10", ["Rice", "Onion", "Saffron"])


# Expected places: all regions and nations, and a planted one; observed: the places of all rows.
_EXP = """, expected AS (SELECT r_name AS state, n_name AS district FROM nation JOIN region ON n_regionkey = r_regionkey
     UNION SELECT 'OCEANIA', 'NATION_X'), seen AS (SELECT state, district FROM obs)"""


def _expected(spark, sf_dir):
    from ..sources.tables import table

    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    planted = places.limit(1).select(F.lit("OCEANIA").alias("state"), F.lit("NATION_X").alias("district"))
    return places.select(F.col("r_name").alias("state"), F.col("n_name").alias("district")).union(planted)


def _seen(spark, sf_dir):
    return obs(spark, sf_dir)


@query("join_expected_reference", with_obs(_EXP + """ SELECT e.state, e.district, (s.state IS NOT NULL)::INT AS observed FROM expected e
   LEFT JOIN (SELECT DISTINCT * FROM seen) s USING (state, district)"""))
def join_expected_reference(spark, sf_dir):
    return pr.expected_vs_observed(_expected(spark, sf_dir), _seen(spark, sf_dir), ["state", "district"])


@query("state_coverage", with_obs(_EXP + """, m AS (SELECT DISTINCT e.state, s.state IS NOT NULL AS ok FROM expected e LEFT JOIN (SELECT DISTINCT state FROM seen) s USING (state))
   SELECT count(*) AS expected, count(*) FILTER (ok) AS covered, coalesce(string_agg(state, ', ' ORDER BY state) FILTER (NOT ok), '') AS missing,
   round(count(*) FILTER (ok) * 100.0 / count(*), 2)::DOUBLE AS coverage_pct FROM m"""))
def state_coverage(spark, sf_dir):
    return pr.state_coverage(_expected(spark, sf_dir), _seen(spark, sf_dir))


@query("district_coverage", with_obs(_EXP + """, m AS (SELECT e.state, count(*) AS expected, count(s.state) AS covered FROM expected e
     LEFT JOIN (SELECT DISTINCT * FROM seen) s USING (state, district) GROUP BY 1)
   SELECT state, expected, covered, round(covered * 100.0 / expected, 2)::DOUBLE AS coverage_pct FROM m"""))
def district_coverage(spark, sf_dir):
    return pr.district_coverage(_expected(spark, sf_dir), _seen(spark, sf_dir))
