"""Registered queries: entity resolution of state, district, crop and market names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import name_key, to_number
from ..operators import resolve as rs
from ..session import materialize
from ..sources.payloads import KEYS as PKS
from ..sources.views import ORDER, apmc_obs, named, raw_obs
from .catalog import query
from .source_queries import PK
from .sqltext import RAW, SPELLINGS, num, with_raw

KNOWN_SQL = ", known AS (SELECT DISTINCT state, district FROM named)"
BASE = RAW + ", " + SPELLINGS + KNOWN_SQL


def _tiered(names, known, key, spell, tight_raw, tight_name):
    """SQL for the tiers over all combinations of distinct names."""
    return f"""(SELECT *, CASE WHEN lower(trim(raw)) = lower(name) THEN 1
        WHEN EXISTS (SELECT 1 FROM {spell} p WHERE lower(p.v) = lower(trim(raw)) AND p.s = name) THEN 3
        WHEN contains(lower(name), lower(trim(raw))) OR contains(lower(trim(raw)), lower(name)) THEN 4
        WHEN {tight_raw} = {tight_name} THEN 5 END AS tier FROM {names} n JOIN {known} k ON {key} WHERE trim(raw) <> '')"""


STATE_SQL = """, sn AS (SELECT DISTINCT state_raw AS raw FROM raw_obs WHERE state_raw IS NOT NULL),
  sc AS """ + _tiered("sn", "(SELECT DISTINCT state AS name FROM known)", "true", "state_spell",
                      "regexp_replace(lower(trim(raw)), '\\s+', '', 'g')", "regexp_replace(lower(name), '\\s+', '', 'g')") + """,
  sb AS (SELECT raw, name AS canonical, tier FROM sc WHERE tier IS NOT NULL
     QUALIFY row_number() OVER (PARTITION BY raw ORDER BY tier, length(name) DESC, name) = 1),
  nstate AS (SELECT sn.raw, canonical, tier FROM sn LEFT JOIN sb ON sn.raw = sb.raw)"""

PAIR_SQL = """, pn AS (SELECT DISTINCT state_raw, district_raw, s.canonical AS ns FROM raw_obs LEFT JOIN nstate s ON s.raw = state_raw),
  dn AS (SELECT DISTINCT ns, district_raw AS raw FROM pn),
  dc AS """ + _tiered("dn", "(SELECT state AS kstate, district AS name FROM known)", "ns IS NULL OR ns = kstate", "district_spell",
                      "regexp_replace(lower(trim(raw)), '[^\\w]', '', 'g')", "regexp_replace(lower(name), '[^\\w]', '', 'g')") + """,
  db AS (SELECT ns, raw, name AS canonical, tier FROM dc WHERE tier IS NOT NULL
     QUALIFY row_number() OVER (PARTITION BY ns, raw ORDER BY tier, length(name) DESC, name) = 1),
  ndist AS (SELECT dn.ns AS state, dn.raw, canonical, tier FROM dn LEFT JOIN db ON dn.ns IS NOT DISTINCT FROM db.ns AND dn.raw = db.raw)"""


@query("normalize_state", f"WITH {BASE} {STATE_SQL} SELECT raw, canonical, tier FROM nstate")
def normalize_state(spark, sf_dir):
    names = raw_obs(spark, sf_dir).filter("state_raw IS NOT NULL").select(F.col("state_raw").alias("raw")).distinct()
    return rs.normalize_state(names, named(spark, sf_dir).select("state").distinct()).select("raw", "canonical", "tier")


def _pairs(spark, sf_dir):
    return raw_obs(spark, sf_dir).select("state_raw", "district_raw").distinct()


def _known(spark, sf_dir):
    return named(spark, sf_dir).select("state", "district").distinct()


@query("normalize_district", f"WITH {BASE} {STATE_SQL} {PAIR_SQL} SELECT state, raw, canonical, tier FROM ndist")
def normalize_district(spark, sf_dir):
    pairs, known = _pairs(spark, sf_dir), _known(spark, sf_dir)
    states = rs.normalize_state(pairs.filter("state_raw IS NOT NULL").select(F.col("state_raw").alias("raw")), known)
    scoped = pairs.join(states.select(F.col("raw").alias("state_raw"), F.col("canonical").alias("state")), "state_raw", "left")
    return rs.normalize_district(scoped.select("state", F.col("district_raw").alias("raw")), known).select("state", "raw", "canonical", "tier")


_LOCATION = f"""WITH {BASE} {STATE_SQL} {PAIR_SQL} SELECT pn.state_raw, pn.district_raw, ns AS state, canonical AS district
   FROM pn JOIN ndist ON pn.ns IS NOT DISTINCT FROM ndist.state AND pn.district_raw = ndist.raw"""


@query("normalize_location", _LOCATION + " WHERE pn.state_raw IS NOT NULL")
def normalize_location(spark, sf_dir):
    return rs.normalize_location(_pairs(spark, sf_dir).filter("state_raw IS NOT NULL"), _known(spark, sf_dir))


@query("join_contains", f"""WITH {BASE}, n AS (SELECT DISTINCT lower(trim(district_raw)) AS k FROM raw_obs),
   d AS (SELECT DISTINCT lower(district) AS dk FROM known UNION SELECT DISTINCT lower(v) FROM district_spell)
   SELECT k, dk FROM n JOIN d ON contains(k, dk) OR contains(dk, k)""")
def join_contains(spark, sf_dir):
    names = raw_obs(spark, sf_dir).select(name_key("district_raw").alias("k")).distinct()
    spelled = rs.spelling_table(spark, rs.DISTRICT_SPELLINGS).select(F.lower("variation").alias("dk"))
    dictionary = _known(spark, sf_dir).select(F.lower("district").alias("dk")).union(spelled).distinct()
    return rs.join_contains(materialize(names, "k"), "k", materialize(dictionary, "dk"), "dk").select("k", "dk")


def _district_names(spark, sf_dir):
    return raw_obs(spark, sf_dir).select(F.col("state").alias("block"), F.trim("district_raw").alias("name")).distinct()


@query("similar_name_pairs", f"""WITH {BASE}, n AS (SELECT DISTINCT state AS block, trim(district_raw) AS name FROM raw_obs),
   p AS (SELECT x.block, x.name AS a, y.name AS b, 1 - levenshtein(lower(x.name), lower(y.name)) / greatest(length(x.name), length(y.name)) AS similarity,
     contains(lower(x.name), lower(y.name)) OR contains(lower(y.name), lower(x.name)) AS inside FROM n x JOIN n y ON x.block = y.block AND x.name < y.name)
   SELECT block, a, b, round(similarity, 6) AS similarity FROM p WHERE similarity >= 0.85 OR (inside AND similarity > 0.7)""")
def similar_name_pairs(spark, sf_dir):
    return rs.similar_name_pairs(_district_names(spark, sf_dir), 0.85).withColumn("similarity", F.round("similarity", 6))


@query("cluster_names_greedy")
def cluster_names_greedy(spark, sf_dir):
    return rs.cluster_names_greedy(rs.similar_name_pairs(_district_names(spark, sf_dir), 0.85, "sequence"))


@query("canonical_by_frequency", f"""WITH {BASE}, c AS (SELECT state AS block, lower(trim(district_raw)) AS leader, district_raw AS name, count(*) AS n
     FROM raw_obs GROUP BY ALL)
   SELECT block, leader, name AS canonical FROM c QUALIFY row_number() OVER (PARTITION BY block, leader ORDER BY n DESC, name) = 1""")
def canonical_by_frequency(spark, sf_dir):
    counts = rs.name_counts(raw_obs(spark, sf_dir), F.col("state"), "district_raw")
    return rs.canonical_by_frequency(counts.select("block", name_key("name").alias("leader"), "name"), counts)


def _untidy(spark, sf_dir):
    """Rows with trimmed raw names and parsed prices under the panel's column names."""
    return raw_obs(spark, sf_dir).select(
        *PKS, "date", F.trim("state_raw").alias("state"), F.trim("district_raw").alias("district"), F.trim("crop_raw").alias("crop"),
        to_number("price_raw").alias("price"))


@query("consolidate_states")
def consolidate_states(spark, sf_dir):
    return rs.consolidate_states(_untidy(spark, sf_dir).filter("state IS NOT NULL"), _known(spark, sf_dir)).groupBy(
        "state_original", "state").agg(F.count("*").alias("records"))


@query("consolidate_districts")
def consolidate_districts(spark, sf_dir):
    tidy = _untidy(spark, sf_dir).filter("state IS NOT NULL")
    return rs.consolidate_districts(tidy, _known(spark, sf_dir)).groupBy(
        "state", "district_original", "district").agg(F.count("*").alias("records"))


@query("consolidate_crops")
def consolidate_crops(spark, sf_dir):
    return rs.consolidate_crops(_untidy(spark, sf_dir)).groupBy("crop_original", "crop").agg(F.count("*").alias("records"))


@query("apply_name_mapping", f"""WITH {BASE} SELECT {PK}, trim(crop_raw) AS crop_original, coalesce(s, trim(crop_raw)) AS crop
   FROM raw_obs LEFT JOIN crop_spell ON v = trim(crop_raw)""")
def apply_name_mapping(spark, sf_dir):
    mapping = rs.spelling_table(spark, rs.CROP_SPELLINGS).select(F.lit(rs.ANY).alias("block"), F.col("variation").alias("raw"), "canonical")
    return rs.apply_name_mapping(_untidy(spark, sf_dir), mapping, "crop").select(*PKS, "crop_original", "crop")


@query("export_mappings")
def export_mappings(spark, sf_dir):
    tidy, known = _untidy(spark, sf_dir).filter("state IS NOT NULL"), _known(spark, sf_dir)
    return rs.export_mappings(rs.state_mapping(tidy, known), rs.district_mapping(tidy, known), rs.crop_mapping(tidy))


@query("clean_and_consolidate")
def clean_and_consolidate(spark, sf_dir):
    return rs.clean_and_consolidate(_untidy(spark, sf_dir), _known(spark, sf_dir), ORDER).select(
        *PKS, "date", "state", "district", "crop", "price")


# ---- markets

APMC = BASE + """, apmc_obs AS (SELECT *, CASE orderkey % 7 WHEN 0 THEN district || ' APMC' WHEN 1 THEN upper(district) || ' Mandi'
     WHEN 2 THEN state || ' Yard' WHEN 3 THEN state || ' ' || district || ' market' WHEN 4 THEN 'Central Yard No 1'
     WHEN 5 THEN 'New ' || district ELSE 'Depot ' || nationkey END AS apmc,
     CASE WHEN partkey % 3 = 0 THEN state_raw END AS given_state, CASE WHEN partkey % 6 = 0 THEN district_raw END AS given_district FROM raw_obs)"""

EXTRACT = """, an AS (SELECT DISTINCT apmc, lower(trim(regexp_replace(trim(apmc), '\\s*(APMC|Market|Mandi|Yard)\\s*$', '', 'i'))) AS k FROM apmc_obs),
  ad AS (SELECT apmc, district, state FROM an JOIN known ON contains(k, lower(district)) OR contains(lower(district), k)
     QUALIFY row_number() OVER (PARTITION BY apmc ORDER BY district, state) = 1),
  asx AS (SELECT apmc, k, s.state FROM an JOIN (SELECT DISTINCT state FROM known) s ON contains(k, lower(s.state))
     WHERE apmc NOT IN (SELECT apmc FROM ad) QUALIFY row_number() OVER (PARTITION BY apmc ORDER BY s.state) = 1),
  al AS (SELECT apmc, state, trim(replace(k, lower(state), '')) AS rest FROM asx),
  ai AS (SELECT apmc, d.district FROM al JOIN known d ON d.state = al.state AND rest <> '' AND (contains(lower(d.district), rest) OR contains(rest, lower(d.district)))
     QUALIFY row_number() OVER (PARTITION BY apmc ORDER BY d.district) = 1),
  extracted AS (SELECT * FROM ad UNION ALL SELECT al.apmc, ai.district, al.state FROM al LEFT JOIN ai ON ai.apmc = al.apmc)"""


@query("apmc_extract_location", f"WITH {APMC} {EXTRACT} SELECT apmc, district, state FROM extracted")
def apmc_extract_location(spark, sf_dir):
    return rs.apmc_extract_location(apmc_obs(spark, sf_dir).select("apmc").distinct(), _known(spark, sf_dir))


MAPPED = STATE_SQL + PAIR_SQL + EXTRACT + """,
  tri AS (SELECT DISTINCT apmc, given_state, given_district FROM apmc_obs),
  prov AS (SELECT apmc, given_state, given_district, s.canonical AS ms, d.canonical AS md FROM tri
     JOIN nstate s ON s.raw = given_state JOIN ndist d ON d.state = s.canonical AND d.raw = given_district WHERE d.canonical IS NOT NULL),
  fz AS (SELECT apmc, district, state FROM (SELECT DISTINCT apmc FROM tri) JOIN known ON contains(lower(apmc), lower(district))
     AND length(district) / length(apmc) > 0.3 QUALIFY row_number() OVER (PARTITION BY apmc ORDER BY length(district) DESC, district, state) = 1),
  mapped AS (SELECT t.apmc, t.given_state, t.given_district, CASE WHEN p.ms IS NOT NULL THEN p.md WHEN e.state IS NOT NULL THEN e.district ELSE f.district END AS district,
     CASE WHEN p.ms IS NOT NULL THEN p.ms WHEN e.state IS NOT NULL THEN e.state ELSE f.state END AS state,
     CASE WHEN p.ms IS NOT NULL THEN 'provided' WHEN e.state IS NOT NULL THEN 'name_extraction' WHEN f.state IS NOT NULL THEN 'fuzzy_match' ELSE 'none' END AS confidence
   FROM tri t LEFT JOIN prov p ON p.apmc = t.apmc AND p.given_state = t.given_state AND p.given_district = t.given_district
     LEFT JOIN extracted e ON e.apmc = t.apmc LEFT JOIN fz f ON f.apmc = t.apmc)"""
# No market of these tables reaches the state-constrained step (its places are already in the name);
# tests cover it on a fixture.


@query("map_apmc", f"WITH {APMC} {MAPPED} SELECT * FROM mapped")
def map_apmc(spark, sf_dir):
    return rs.map_apmc(apmc_obs(spark, sf_dir), _known(spark, sf_dir))


_TABLE = f"""WITH {APMC} {MAPPED}, t AS (SELECT {PK}, o.apmc, o.given_state, o.given_district, coalesce(m.state, o.given_state) AS state,
   coalesce(m.district, o.given_district) AS district, confidence FROM apmc_obs o JOIN mapped m ON m.apmc = o.apmc
   AND m.given_state IS NOT DISTINCT FROM o.given_state AND m.given_district IS NOT DISTINCT FROM o.given_district)"""


def _mapped_rows(spark, sf_dir):
    rows = apmc_obs(spark, sf_dir).select(*PKS, "apmc", "given_state", "given_district")
    return rs.map_apmc_table(rows, _known(spark, sf_dir))


@query("map_apmc_table", _TABLE + " SELECT * FROM t")
def map_apmc_table(spark, sf_dir):
    return _mapped_rows(spark, sf_dir)


@query("mapping_coverage", _TABLE + """, a AS (SELECT confidence, state, district, given_district FROM t UNION ALL SELECT 'all', state, district, given_district FROM t)
   SELECT confidence, count(*) AS records, count(*) FILTER (state IS NOT NULL AND district IS NOT NULL) AS mapped,
   count(*) FILTER (given_district IS NULL) AS missing_before, count(*) FILTER (district IS NULL) AS missing_after FROM a GROUP BY 1""")
def mapping_coverage(spark, sf_dir):
    return rs.mapping_coverage(_mapped_rows(spark, sf_dir))
