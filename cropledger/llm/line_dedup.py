"""Line deduplication by a deletion-neighbourhood join.

Two lines are near when one edit (a character put in, left out or replaced) or none makes them equal. Leaving out one
character or none gives the variants of a line, and near lines have a variant in common. A long line stands in the join by
its ends: a variant's key is its length with its first and last characters, so a few keys cover all places for the edit.
Lines with an equal key are compared by their edit distance; where too many lines share a key, they are joined again by
all their whole variants, which few different lines can have in common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropledger.llm.common import text_of
from cropledger.session import materialize, maybe_broadcast

#: Characters of each end of a variant in its key.
END = 7
#: Shorter lines are only compared for equality.
LEAST_CHARS = 10
#: Keys shared by more lines than this are refined to whole variants.
WIDE_KEY = 32


def end_keys(ends: Column, chars: Column) -> Column:
    """Keys of all variants of a line of so many characters, from the line itself or, for a long one, from its first and last
    END + 1. Long lines have their variants spelled out place by place, which Spark compiles; places in between give the same
    key as the last one of the first END + 1."""
    key = lambda n, head, tail: F.xxhash64(n, head, tail)
    without = lambda s, i: F.concat(F.substring(s, 1, i - 1), F.substring(s, i + 1, END + 1 - i))
    head, tail = F.left(ends, F.lit(END + 1)), F.right(ends, F.lit(END + 1))
    first, last = F.left(ends, F.lit(END)), F.right(ends, F.lit(END))
    long = F.array(key(chars, first, last), *[key(chars - 1, without(head, i), last) for i in range(1, END + 2)],
                   *[key(chars - 1, first, without(tail, i)) for i in range(2, END + 2)])
    whole = lambda v, n: key(n, F.left(v, F.lit(END)), F.right(v, F.lit(END)))
    short = F.transform(F.sequence(F.lit(1), F.length(ends)), lambda i: whole(F.concat(F.left(ends, i - 1), F.substring(ends, i + 1, F.length(ends))), chars - 1))
    return F.array_distinct(F.when(chars > 2 * END + 2, long).otherwise(F.concat(F.array(whole(ends, chars)), short)))


def whole_keys(line: Column) -> Column:
    less = F.transform(F.sequence(F.lit(1), F.length(line)), lambda i: F.xxhash64(F.concat(F.left(line, i - 1), F.substring(line, i + 1, F.length(line)))))
    return F.array_distinct(F.concat(F.array(F.xxhash64(line)), less))


def _shared(keyed: DataFrame) -> DataFrame:
    """(key, line, n) of the keys that several lines have; n counts them. Keys are made and shuffled once; what a task holds of a
    key beyond a few thousand rows of two numbers is spilled."""
    return keyed.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")


def _pairs(shared: DataFrame) -> DataFrame:
    left, right = shared.select("key", F.col("line").alias("x")), shared.select("key", F.col("line").alias("y"))
    return left.join(right, "key").where("x < y").select("x", "y")


def line_status(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All lines that are not blank (doc_id, th, line_no, h1, h2), and the status of each distinct line (h1, h2, first, near):
    where it comes first, by doc_id and line number, and whether an earlier line is near it."""
    texts = docs.select("doc_id", F.xxhash64(text_of()).alias("th"), text_of().alias("text"))
    exploded = texts.select("doc_id", "th", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "t")).where(F.length(F.trim("t")) > 0)
    exploded = exploded.withColumn("h1", F.xxhash64("t")).withColumn("h2", F.hash("t"))
    ends = F.when(F.length("t") > 2 * END + 2, F.concat(F.left("t", F.lit(END + 1)), F.right("t", F.lit(END + 1)))).otherwise(F.col("t"))
    lines = exploded.select("doc_id", "th", "line_no", "h1", "h2", F.length("t").alias("chars"), ends.alias("ends"))
    kinds = lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.min("chars").alias("chars"), F.min("ends").alias("ends"))
    kinds = materialize(kinds, "line-kinds")
    keyed = kinds.where(F.col("chars") >= LEAST_CHARS).select(F.explode(end_keys(F.col("ends"), F.col("chars"))).alias("key"), F.col("h1").alias("line"))
    shared = materialize(_shared(keyed), "line-keys")
    pairs = _pairs(shared.where(F.col("n") <= WIDE_KEY))
    asked = shared.select(F.col("line").alias("_h")).distinct()
    asked = maybe_broadcast(materialize(asked, "lines-asked"))
    strings = exploded.join(asked, F.col("h1") == F.col("_h"), "left_semi").groupBy("h1", "h2").agg(F.min("t").alias("t"))
    strings = materialize(strings.join(kinds.select("h1", "h2", "first"), ["h1", "h2"]), "line-strings")
    wide = shared.where(F.col("n") > WIDE_KEY).select(F.col("line").alias("h1")).distinct()
    again = strings.join(wide, "h1", "left_semi").select(F.explode(whole_keys(F.col("t"))).alias("key"), F.col("h1").alias("line"))
    pairs = pairs.union(_pairs(_shared(again))).distinct()
    left, right = [strings.select(F.col("h1").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("h2", "t", "first")]) for x in "xy"]
    near = pairs.join(left, "x").join(right, "y").where(F.levenshtein("x_t", "y_t", 1) >= 0)
    later = F.when(F.col("x_first") < F.col("y_first"), F.struct(F.col("y").alias("h1"), F.col("y_h2").alias("h2")))
    later = F.coalesce(later, F.struct(F.col("x").alias("h1"), F.col("x_h2").alias("h2")))
    near = near.select(later.alias("k")).select("k.*").distinct().withColumn("near", F.lit(True))
    status = kinds.select("h1", "h2", "first").join(near, ["h1", "h2"], "left")
    # Written, so that a line which stands in many documents is joined to a plain table, which Spark can split.
    status = materialize(status.select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near")), "line-status")
    return lines.select("doc_id", "th", "line_no", "h1", "h2"), status


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text without its repeated lines, n_lines and n_removed of every row.

    A line goes if it came before, by doc_id and line number, or if an earlier line is within one edit of it. Blank lines
    stay; lines under LEAST_CHARS characters go only as exact repeats. A null doc_id comes before all others, a null text is
    empty; rows that repeat a doc_id and its text are one document and have one result.
    """
    lines, status = line_status(docs)
    gone = lines.join(status, ["h1", "h2"]).where(F.col("near") | ~F.struct("doc_id", "line_no").eqNullSafe(F.col("first")))
    gone = gone.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set("line_no").alias("gone"))
    source = docs.select("doc_id", text_of().alias("text"))
    joined = source.join(gone, (F.xxhash64(source["text"]) == F.col("_th")) & source["doc_id"].eqNullSafe(F.col("_id")), "left")
    gone_here = F.map_from_entries(F.transform("gone", lambda i: F.struct(i, F.lit(True))))
    kept = F.filter(F.split("text", "\n", -1), lambda _, i: F.coalesce(F.element_at("gone_map", i), F.lit(False)) == F.lit(False))
    joined = joined.select("doc_id", "text", "gone", F.coalesce(gone_here, F.create_map().cast("map<int,boolean>")).alias("gone_map"))
    return joined.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
                         (F.regexp_count("text", F.lit("\n")) + 1).cast("bigint").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"))


def op3_line_dedup(docs: DataFrame) -> DataFrame:
    """What dedup_lines() gives. Null and empty texts have no lines, blank lines always stay, long texts and lines count whole. Of
    equal or near lines the one of the smallest doc_id, then the first there, stays. An empty table gives an empty result."""
    return dedup_lines(docs)


OP3_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
k AS (SELECT t, min((doc_id, i)) AS f, length(t) AS n FROM l WHERE length(trim(t, ' ')) > 0 GROUP BY t),
h AS (SELECT *, n // 2 AS m FROM k WHERE n >= 10),
c AS (SELECT x.t AS a, x.f AS af, y.t AS b, y.f AS bf FROM h x JOIN h y ON y.n = x.n AND left(x.t, x.m) = left(y.t, x.m) WHERE x.f < y.f
      UNION SELECT x.t, x.f, y.t, y.f FROM h x JOIN h y ON y.n = x.n AND right(x.t, x.n - x.m - 1) = right(y.t, x.n - x.m - 1) WHERE x.f < y.f
      UNION SELECT x.t, x.f, y.t, y.f FROM h x JOIN h y ON y.n = x.n - 1 AND left(x.t, x.m) = left(y.t, x.m)
      UNION SELECT x.t, x.f, y.t, y.f FROM h x JOIN h y ON y.n = x.n - 1 AND right(x.t, x.n - x.m - 1) = right(y.t, x.n - x.m - 1)),
p AS (SELECT *, coalesce(list_position(list_transform(list_zip(string_split(a, ''), string_split(b, '')), lambda z: z[1] IS DISTINCT FROM z[2]), true), 1000000)::BIGINT AS q FROM c),
near AS (SELECT DISTINCT CASE WHEN af < bf THEN b ELSE a END AS t FROM p
         WHERE substr(a, q + 1) = substr(b, q + 1) OR (length(a) > length(b) AND substr(a, q + 1) = substr(b, q))),
s AS (SELECT l.doc_id, l.i, l.t, k.f IS NULL OR (k.f = (l.doc_id, l.i) AND near.t IS NULL) AS stays FROM l LEFT JOIN k ON k.t = l.t LEFT JOIN near ON near.t = l.t)
SELECT doc_id, coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (stays), '') AS text, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed FROM s GROUP BY doc_id
"""
