"""Entity resolution of place, crop and market names.

Matching runs on distinct names only and never compares all pairs: containment and near-equality are
turned into equality joins on substrings, and the found mapping is joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.columns import letters_only, name_key, squeeze, substrings
from ..functions.fixed_values import CROP_SPELLINGS, DISTRICT_SPELLINGS, STATE_SPELLINGS
from ..plans.series import first_per_group
from ..session import materialize, maybe_broadcast

ANY = "*"  # scope of names whose state is unknown


def spelling_table(spark: SparkSession, spellings: Mapping[str, str]) -> DataFrame:
    """A fixed dictionary of well under 200 entries, small enough to broadcast as it is."""
    rows = [(v, c) for v, c in spellings.items()]
    return F.broadcast(spark.createDataFrame(rows, "variation string, canonical string"))


def contains_pairs(left: DataFrame, a: str, right: DataFrame, b: str, on: Sequence[str] = ()) -> DataFrame:
    """Rows of both sides whose key ``a`` contains key ``b``, joined on ``a``'s substrings."""
    return left.withColumn("_sub", F.explode(substrings(F.col(a)))).join(
        right.withColumn("_sub", F.col(b)), [*on, "_sub"]).drop("_sub")


def join_contains(left: DataFrame, a: str, right: DataFrame, b: str, on: Sequence[str] = ()) -> DataFrame:
    """Pairs where either key contains the other."""
    forth = contains_pairs(left, a, right, b, on)
    back = contains_pairs(right, b, left, a, on).select(*forth.columns)
    return forth.unionByName(back).distinct()


def resolve_names(names: DataFrame, known: DataFrame, spellings: Mapping[str, str], tight) -> DataFrame:
    """Best known name per raw name of a scope: (scope, raw, canonical, tier), NULL without a hit.

    Tiers: 1 equal but for case, 3 dictionary, 4 contained either way, 5 equal after ``tight``.
    Ties go to the longest, then the alphabetically first name.
    """
    # Distinct names are few next to the rows they come from: written once, then matched five ways.
    every = materialize(names.select("scope", "raw").distinct(), "names")
    raw = every.filter(F.trim("raw") != "").select("scope", "raw", name_key("raw").alias("k"))
    ref = materialize(known.select("scope", "name").distinct(), "known-names").withColumn("kk", F.lower("name"))
    spell = spelling_table(names.sparkSession, spellings).select(F.lower("variation").alias("k"), "canonical").distinct()
    cols = ["scope", "raw", "name"]

    def tier(df: DataFrame, n: int) -> DataFrame:
        return df.select(*cols, F.lit(n).alias("tier"))

    same = tier(raw.join(ref.withColumn("k", F.col("kk")), ["scope", "k"]), 1)
    said = tier(raw.join(spell, "k").join(ref.withColumn("canonical", F.col("name")), ["scope", "canonical"]), 3)
    part = tier(join_contains(raw, "k", ref, "kk", ["scope"]), 4)
    close = tier(raw.withColumn("t", tight(F.col("k"))).join(ref.withColumn("t", tight(F.col("kk"))), ["scope", "t"]), 5)
    found = same.unionByName(said).unionByName(part).unionByName(close)
    best = found.groupBy("scope", "raw").agg(
        F.min(F.struct("tier", (-F.length("name")).alias("n"), "name")).alias("b")
    ).select("scope", "raw", F.col("b.name").alias("canonical"), F.col("b.tier").alias("tier"))
    return every.join(best, ["scope", "raw"], "left")


def normalize_state(names: DataFrame, known_states: DataFrame) -> DataFrame:
    """(raw) and (state) tables to (raw, canonical, tier)."""
    scoped = names.select(F.lit(ANY).alias("scope"), "raw")
    ref = known_states.select(F.lit(ANY).alias("scope"), F.col("state").alias("name"))
    return resolve_names(scoped, ref, STATE_SPELLINGS, squeeze).drop("scope")


def normalize_district(names: DataFrame, known: DataFrame) -> DataFrame:
    """(state, raw) with normalised states to (state, raw, canonical, tier); all districts where the state is NULL."""
    scoped = names.select(F.coalesce("state", F.lit(ANY)).alias("scope"), "raw")
    ref = known.select(F.col("state").alias("scope"), F.col("district").alias("name"))
    ref = ref.unionByName(ref.select(F.lit(ANY).alias("scope"), "name"))
    out = resolve_names(scoped, ref, DISTRICT_SPELLINGS, letters_only)
    return out.withColumn("state", F.when(F.col("scope") != ANY, F.col("scope"))).drop("scope")


def normalize_location(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct (state_raw, district_raw) to normalised (state, district)."""
    pairs = materialize(pairs.select("state_raw", "district_raw").distinct(), "place-names")
    states = normalize_state(pairs.select(F.col("state_raw").alias("raw")).distinct(), known)
    with_state = pairs.join(states.select(F.col("raw").alias("state_raw"), F.col("canonical").alias("state")), "state_raw", "left")
    districts = normalize_district(with_state.select("state", F.col("district_raw").alias("raw")), known).select(
        F.coalesce("state", F.lit(ANY)).alias("scope"), F.col("raw").alias("district_raw"), F.col("canonical").alias("district"))
    return with_state.withColumn("scope", F.coalesce("state", F.lit(ANY))).join(
        districts, ["scope", "district_raw"], "left").select("state_raw", "district_raw", "state", "district")


# ---- similar names

def edit_similarity(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def similar_name_pairs(names: DataFrame, threshold: float, measure: str = "edit", loose: float = 0.7) -> DataFrame:
    """(block, a, b, similarity) with a < b: similarity at least ``threshold``, or contained and above ``loose``.

    A pair within the threshold differs by a bounded number of edits, so when the shorter name is cut
    into one piece more than that, some piece occurs unchanged in the longer one. Only pairs that
    share such a piece are compared; no similar pair is missed.
    """
    edits = (1 - threshold) / threshold * (1 if measure == "edit" else 2)
    distinct = materialize(names.select("block", "name").distinct(), "block-names")
    base = distinct.withColumn("k", F.lower("name")).filter(F.length("k") > 0)
    size, pieces = F.length("k"), F.floor(F.length("k") * edits + 1e-9).cast("int") + 1
    bounds = lambda i: F.floor(i * size / pieces).cast("int")
    cut = F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.substr(F.col("k"), bounds(i) + 1, bounds(i + 1) - bounds(i)))
    short = base.select("block", F.col("name").alias("s"), F.col("k").alias("sk"),
                        F.explode(F.array_distinct(F.concat(cut, F.array("k")))).alias("piece"))
    long = base.select("block", F.col("name").alias("l"), F.col("k").alias("lk"), F.explode(substrings(F.col("k"))).alias("piece"))
    shared = short.join(long, ["block", "piece"]).filter(
        (F.length("sk") <= F.length("lk")) & (F.col("s") != F.col("l"))
    ).select("block", F.least("s", "l").alias("a"), F.greatest("s", "l").alias("b")).distinct()
    ka, kb = F.lower("a"), F.lower("b")
    score = edit_similarity(ka, kb) if measure == "edit" else sequence_ratio(ka, kb)
    inside = F.contains(ka, kb) | F.contains(kb, ka)
    return shared.withColumn("similarity", score).filter(
        (F.col("similarity") >= threshold) | (inside & (F.col("similarity") > loose)))


def cluster_names_greedy(pairs: DataFrame) -> DataFrame:
    """(block, leader, name) of groups with more than one name, leader included.

    In name order, a name leads unless an earlier leader is similar to it; members go to their first
    leader. Decided in rounds over the shrinking list of undecided pairs.
    """
    edges = materialize(pairs.select("block", F.col("a").alias("lead"), F.col("b").alias("follow")), "pairs")
    open_edges, taken = edges, None
    while not open_edges.isEmpty():
        blocked = open_edges.select("block", F.col("follow").alias("lead")).distinct()
        leads = open_edges.select("block", "lead").distinct().join(blocked, ["block", "lead"], "left_anti")
        members = materialize(open_edges.join(leads, ["block", "lead"], "left_semi").select("block", F.col("follow").alias("name")).distinct(), "members")
        taken = members if taken is None else taken.unionByName(members)
        gone = members.unionByName(leads.withColumnRenamed("lead", "name"))
        for end in ("lead", "follow"):
            open_edges = open_edges.join(gone.withColumnRenamed("name", end), ["block", end], "left_anti")
        open_edges = materialize(open_edges.select("block", "lead", "follow"), "open-pairs")
    if taken is None:
        return edges.select("block", F.col("lead").alias("leader"), F.col("follow").alias("name"))
    followers = edges.join(taken.select("block", F.col("name").alias("lead")), ["block", "lead"], "left_anti").join(
        taken.select("block", F.col("name").alias("follow")), ["block", "follow"], "left_semi")
    joined = followers.groupBy("block", F.col("follow").alias("name")).agg(F.min("lead").alias("leader"))
    return joined.select("block", "leader", "name").unionByName(
        joined.select("block", "leader", F.col("leader").alias("name")).distinct())


def name_counts(df: DataFrame, block: Column, name: str) -> DataFrame:
    return df.filter(F.col(name).isNotNull()).groupBy(block.alias("block"), F.col(name).alias("name")).agg(F.count("*").alias("n"))


def canonical_by_frequency(clusters: DataFrame, counts: DataFrame) -> DataFrame:
    """Most frequent spelling per cluster, ties to the first by name: (block, leader, canonical)."""
    best = clusters.join(counts, ["block", "name"]).groupBy("block", "leader").agg(
        F.min(F.struct((-F.col("n")).alias("n"), "name")).alias("b"))
    return best.select("block", "leader", F.col("b.name").alias("canonical"))


def cluster_mapping(counts: DataFrame, threshold: float, normalized: DataFrame | None = None, measure: str = "sequence") -> DataFrame:
    """(block, raw, canonical) for members of similar-name groups; the canonical is itself normalised."""
    clusters = cluster_names_greedy(similar_name_pairs(counts, threshold, measure))
    canon = canonical_by_frequency(clusters, counts)
    if normalized is not None:
        better = normalized.select("block", F.col("raw").alias("canonical"), F.col("canonical").alias("better"))
        canon = canon.join(better, ["block", "canonical"], "left").select(
            "block", "leader", F.coalesce("better", "canonical").alias("canonical"))
    return clusters.join(canon, ["block", "leader"]).select("block", F.col("name").alias("raw"), "canonical").filter("raw <> canonical")


def apply_name_mapping(df: DataFrame, mapping: DataFrame, column: str, block: Column | None = None) -> DataFrame:
    """Replace names by their canonical form and keep the original next to it."""
    small = maybe_broadcast(mapping.select("block", F.col("raw").alias(column), "canonical"))
    keyed = df.withColumn("block", block if block is not None else F.lit(ANY))
    return keyed.join(small, ["block", column], "left").withColumn(f"{column}_original", F.col(column)).withColumn(
        column, F.coalesce("canonical", column)).drop("block", "canonical")


def _combine(first: DataFrame, second: DataFrame, label: str) -> DataFrame:
    """First mapping wins; the result is small and written once."""
    extra = second.join(first, ["block", "raw"], "left_anti")
    return materialize(first.unionByName(extra.select(*first.columns)), label)


def state_mapping(df: DataFrame, known: DataFrame, measure: str = "sequence") -> DataFrame:
    counts = materialize(name_counts(df, F.lit(ANY), "state"), "state-names")
    norm = materialize(normalize_state(counts.select(F.col("name").alias("raw")), known).withColumn("block", F.lit(ANY)), "state-norm")
    direct = norm.filter("canonical IS NOT NULL AND canonical <> raw").select("block", "raw", "canonical")
    hits = norm.filter("canonical IS NOT NULL")
    return _combine(direct, cluster_mapping(counts, 0.90, hits, measure), "state-mapping")


def district_mapping(df: DataFrame, known: DataFrame, measure: str = "sequence") -> DataFrame:
    counts = materialize(name_counts(df.filter("state IS NOT NULL"), F.col("state"), "district"), "district-names")
    states = materialize(normalize_state(counts.select(F.col("block").alias("raw")).distinct(), known), "block-states")
    named = counts.join(states.select(F.col("raw").alias("block"), F.col("canonical").alias("state")), "block", "left")
    norm = normalize_district(named.select("state", F.col("name").alias("raw")).distinct(), known)
    joined = named.withColumn("scope", F.coalesce("state", F.lit(ANY))).join(
        norm.select(F.coalesce("state", F.lit(ANY)).alias("scope"), F.col("raw").alias("name"), "canonical"), ["scope", "name"], "left")
    hits = materialize(joined.filter("canonical IS NOT NULL").select("block", F.col("name").alias("raw"), "canonical"), "district-norm")
    return _combine(hits.filter("canonical <> raw"), cluster_mapping(counts, 0.88, hits, measure), "district-mapping")


def crop_mapping(df: DataFrame, measure: str = "sequence") -> DataFrame:
    """Dictionary pairs count only when both spellings occur."""
    counts = materialize(name_counts(df, F.lit(ANY), "crop"), "crop-names")
    seen = counts.select("name")
    direct = (
        spelling_table(df.sparkSession, CROP_SPELLINGS)
        .join(seen.withColumnRenamed("name", "variation"), "variation", "left_semi")
        .join(seen.withColumnRenamed("name", "canonical"), "canonical", "left_semi")
        .select(F.lit(ANY).alias("block"), F.col("variation").alias("raw"), "canonical")
    )
    return _combine(direct, cluster_mapping(counts, 0.85, None, measure), "crop-mapping")


def consolidate_states(df: DataFrame, known: DataFrame) -> DataFrame:
    return apply_name_mapping(df, state_mapping(df, known), "state")


def consolidate_districts(df: DataFrame, known: DataFrame) -> DataFrame:
    return apply_name_mapping(df, district_mapping(df, known), "district", F.col("state"))


def consolidate_crops(df: DataFrame) -> DataFrame:
    return apply_name_mapping(df, crop_mapping(df), "crop")


def export_mappings(states: DataFrame, districts: DataFrame, crops: DataFrame) -> DataFrame:
    """The three rename tables in one: (kind, scope, raw, canonical)."""
    out = None
    for kind, m in (("state", states), ("district", districts), ("crop", crops)):
        part = m.select(F.lit(kind).alias("kind"), F.when(F.col("block") != ANY, F.col("block")).alias("scope"), "raw", "canonical")
        out = part if out is None else out.unionByName(part)
    return out


def clean_and_consolidate(df: DataFrame, known: DataFrame, order: Sequence[str]) -> DataFrame:
    """Essentials, valid prices, three consolidations, one row per series and day."""
    from . import clean as cl

    # The cleaned rows are read four times (three name counts, the result), so they are parsed once.
    kept = materialize(cl.filter_valid_price(cl.drop_missing_essentials(df)), "cleaned")
    known = materialize(known.select("state", "district").distinct(), "known-places")
    named = consolidate_crops(consolidate_districts(consolidate_states(kept, known), known))
    return cl.dedupe_series_day(named, order)


# ---- markets

SUFFIX = r"(?i)\s*(APMC|Market|Mandi|Yard)\s*$"


def _first(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Alphabetically first district per key, then its first state."""
    best = pairs.groupBy(*keys).agg(F.min(F.struct("district", "state")).alias("b"))
    return best.select(*keys, F.col("b.district").alias("district"), F.col("b.state").alias("state"))


def apmc_extract_location(names: DataFrame, known: DataFrame) -> DataFrame:
    """(apmc) to (apmc, district, state) where the market's name gives a place."""
    ref = materialize(known.select("state", "district").distinct(), "known").withColumns(
        {"dk": F.lower("district"), "sk": F.lower("state")})
    base = materialize(names.select("apmc").distinct(), "market-names").withColumn(
        "k", F.lower(F.trim(F.regexp_replace(F.trim("apmc"), SUFFIX, "")))).filter("k <> ''")
    by_district = _first(join_contains(base, "k", ref, "dk"), ["apmc"])
    rest = base.join(by_district, "apmc", "left_anti")
    states = ref.select("state", "sk").distinct()
    held = contains_pairs(rest, "k", states, "sk").groupBy("apmc", "k").agg(F.min(F.struct("state", "sk")).alias("b")).select(
        "apmc", F.col("b.state").alias("state"), F.trim(F.replace(F.col("k"), F.col("b.sk"), F.lit(""))).alias("left"))
    inner = _first(join_contains(held.filter("left <> ''"), "left", ref, "dk", ["state"]), ["apmc"])
    by_state = held.select("apmc", "state").join(inner.select("apmc", "district"), "apmc", "left").select("apmc", "district", "state")
    return by_district.select("apmc", "district", "state").unionByName(by_state)


def map_apmc(markets: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct (apmc, given_state, given_district) to (…, district, state, confidence).

    provided, name_extraction, state_constrained, fuzzy_match, none: the first strategy that answers.
    """
    keys = ["apmc", "given_state", "given_district"]
    known = materialize(known.select("state", "district").distinct(), "known-places")
    triples = materialize(markets.select(*keys).distinct().withColumns({
        "name": F.trim("apmc"), "gs": F.coalesce("given_state", F.lit("")), "gd": F.coalesce("given_district", F.lit(""))}), "markets")
    given = normalize_location(triples.filter("gs <> '' AND gd <> ''").select(
        F.col("gs").alias("state_raw"), F.col("gd").alias("district_raw")), known).filter("state IS NOT NULL AND district IS NOT NULL")
    provided = triples.join(given.select(F.col("state_raw").alias("gs"), F.col("district_raw").alias("gd"), "district", "state"), ["gs", "gd"])
    names = triples.select(F.col("name").alias("apmc")).filter("apmc <> ''").distinct()
    extracted = triples.join(apmc_extract_location(names, known).withColumnRenamed("apmc", "name"), "name")
    ref = known.withColumn("dk", F.lower("district"))
    norm = normalize_state(triples.select(F.col("gs").alias("raw")).distinct(), known).filter("canonical IS NOT NULL")
    in_state = materialize(triples.join(norm.select(F.col("raw").alias("gs"), F.col("canonical").alias("state")), "gs").select(
        "name", "gs", "state", F.lower("name").alias("k")).distinct(), "markets-in-state")
    constrained = triples.join(_first(join_contains(in_state, "k", ref, "dk", ["state"]), ["name", "gs"]), ["name", "gs"])
    scored = contains_pairs(names.select(F.col("apmc").alias("name"), F.lower("apmc").alias("k")), "k", ref, "dk").withColumn(
        "score", F.length("dk") / F.length("k")).filter("score > 0.3")
    fuzzy = scored.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("s"), "district", "state")).alias("b")).select(
        "name", F.col("b.district").alias("district"), F.col("b.state").alias("state"))
    ranked = None
    for rank, (label, df) in enumerate((("provided", provided), ("name_extraction", extracted),
                                        ("state_constrained", constrained), ("fuzzy_match", triples.join(fuzzy, "name")))):
        part = df.select("name", "gs", "gd", "district", "state", F.lit(label).alias("confidence"), F.lit(rank).alias("rank"))
        ranked = part if ranked is None else ranked.unionByName(part)
    best = first_per_group(ranked, ["name", "gs", "gd"], ["rank"]).drop("rn", "rank")
    return triples.join(best, ["name", "gs", "gd"], "left").select(
        *keys, "district", "state", F.coalesce("confidence", F.lit("none")).alias("confidence"))


def map_apmc_table(df: DataFrame, known: DataFrame) -> DataFrame:
    """Map every row's market; given places are overwritten only where the mapping found one."""
    mapping = maybe_broadcast(materialize(map_apmc(df, known).withColumnsRenamed({"district": "md", "state": "ms"}), "market-mapping"))
    on = (df["apmc"].eqNullSafe(mapping["apmc"]) & df["given_state"].eqNullSafe(mapping["given_state"])
          & df["given_district"].eqNullSafe(mapping["given_district"]))
    rest = [c for c in df.columns if c not in ("state", "district", "given_state", "given_district")]
    return df.join(mapping, on, "left").select(
        *[df[c] for c in rest], df["given_state"], df["given_district"], F.coalesce("ms", df["given_state"]).alias("state"),
        F.coalesce("md", df["given_district"]).alias("district"), "confidence")


def mapping_coverage(mapped: DataFrame) -> DataFrame:
    """Per confidence and in total: rows, rows with a place, districts missing before and after."""
    return mapped.rollup("confidence").agg(
        F.count("*").alias("records"), F.count_if(F.col("state").isNotNull() & F.col("district").isNotNull()).alias("mapped"),
        F.count_if(F.col("given_district").isNull()).alias("missing_before"), F.count_if(F.col("district").isNull()).alias("missing_after"),
    ).withColumn("confidence", F.coalesce("confidence", F.lit("all")))
