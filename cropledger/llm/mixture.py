"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by source, language and topic. The cells' weights are raked to the target shares of one dimension after the
other, again and again, until all marginals hold; documents are then sampled in proportion to the weights. Where that is more
than once, whole copies are drawn, so the sample holds the marginals too: a probability, which 1 bounds, could not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropledger.llm.common import text_of
from cropledger.session import materialize, maybe_broadcast

DIMENSIONS = ("source", "lang", "topic")
ROUNDS = 10
CAP_ROUNDS = 6
#: Target shares: each value's share of the tokens to this power, so that large sources, languages and topics shrink.
FLATTEN = 0.5
#: Share of all tokens that the sample is to hold.
KEEP = 0.7

_SPACE = r"\x20\x09-\x0D"


def tokens_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{_SPACE}]+")).cast("bigint")


def topic_of(text: Column, tokens: Column) -> Column:
    """What kind of text it is, by its layout and length; documents bring no topic of their own."""
    symbols = F.length(F.regexp_replace(text, r"[^%$#*&]", ""))
    return (F.when(text.contains(" | "), "table").when(symbols * 20 > F.length(text), "symbols")
            .when(tokens >= 1000, "essay").when(tokens >= 100, "article").otherwise("note"))


def with_cells(docs: DataFrame) -> DataFrame:
    """All columns as `_row`, and _source, _lang, _topic, _tokens. Null values of a dimension count as ''."""
    text = text_of()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text", "source", "lang", tokens_of(text).alias("_tokens"))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.select("_row", blank("source").alias("_source"), blank("lang").alias("_lang"), topic_of(text, F.col("_tokens")).alias("_topic"), "_tokens")


def target_shares(cells: DataFrame, d: str, flatten: float = FLATTEN, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """(d, share): shares as parts of one, among the values that hold tokens."""
    if targets and d in targets:
        aim = targets[d].select(F.col("value").alias(d), "share")
    else:
        aim = cells.groupBy(d).agg(F.sum("tokens").alias("t")).select(d, F.pow(F.col("t").cast("double"), F.lit(flatten)).alias("share"))
    aim = cells.where("tokens > 0").select(d).distinct().join(aim, d)
    whole = aim.agg(F.sum("share")).first()[0] or 1.0
    return aim.withColumn("share", F.col("share") / whole)


def rake(cells: DataFrame, dims: list[str], rounds: int = ROUNDS, flatten: float = FLATTEN, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """Cells (dims, tokens) with `weight`: tokens * weight has the target share of each value of each dimension.

    targets: for some dimensions a table (value, share) of one's own, in place of the flattened shares; values without a
    share get weight 0. Sums are combined in the map tasks. Every step is written to the shared folder: it reads the step before it
    twice, so the plan of a round of three would read it eight times.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    aims = [materialize(target_shares(cells, d, flatten, targets), f"aim{d}") for d in dims]
    fitted = cells.withColumn("weight", F.lit(1.0))
    for _ in range(rounds):
        for d, aim in zip(dims, aims):
            have = fitted.groupBy(d).agg(F.sum(F.col("tokens") * F.col("weight")).alias("have"))
            factor = have.where("have > 0").join(aim, d).select(d, (F.col("share") * F.lit(float(total)) / F.col("have")).alias("factor"))
            fitted = fitted.join(factor, d, "left").withColumn("weight", F.col("weight") * F.coalesce("factor", F.lit(0.0))).drop("factor")
            fitted = materialize(fitted, "raked")
    return fitted


def calibrate(cells: DataFrame, keep: float = KEEP) -> DataFrame:
    """Cells with `expected`, the copies of each of their documents in a sample that holds the targets: weights times one factor,
    so that `keep` of the tokens is expected, copies counted, or less where it would be more than `keep` of the documents (a
    column `docs` counts them): short texts of much weight would make a sample of more rows than there are documents. And with `p`, for a sample that holds every document once at most:
    1 at most, cells that would pass 1 are taken whole, and the factor of the others rises. Such a sample misses the targets."""
    total, weighted = cells.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("weight"))).first()
    if not total or not weighted:
        return cells.withColumns({"p": F.lit(0.0), "expected": F.lit(0.0)})
    factor = rate = keep * total / weighted
    if "docs" in cells.columns:
        have, drawn = cells.agg(F.sum("docs"), F.sum(F.col("docs") * F.col("weight"))).first()
        rate = min(rate, keep * have / drawn)
    for _ in range(CAP_ROUNDS):
        full = F.col("weight") * factor >= 1
        r = cells.agg(F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0)).alias("t"), F.sum(F.when(~full, F.col("tokens") * F.col("weight"))).alias("w")).first()
        if not r["w"] or keep * total <= r["t"]:
            break
        factor = (keep * total - r["t"]) / r["w"]
    return cells.withColumns({"p": F.least(F.lit(1.0), F.col("weight") * factor), "expected": F.col("weight") * rate})


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) that the doc_id alone decides: documents of one id stay or go together."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / float(2**32)


def _cells(rows: DataFrame) -> DataFrame:
    return materialize(rows.groupBy(*[f"_{d}" for d in DIMENSIONS]).agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("docs")), "cells")


def _own(targets: dict[str, DataFrame] | None) -> dict[str, DataFrame] | None:
    if unknown := set(targets or {}) - set(DIMENSIONS):
        raise ValueError(f"targets for {sorted(unknown)}; the dimensions are {DIMENSIONS}")
    return {f"_{d}": t for d, t in targets.items()} if targets else None


def _drawn(rows: DataFrame, cells: DataFrame, keep: float, targets: dict[str, DataFrame] | None) -> DataFrame:
    dims = [f"_{d}" for d in DIMENSIONS]
    fitted = materialize(calibrate(rake(cells, dims, targets=targets), keep).drop("tokens", "docs"), "calibrated")
    on = reduce(lambda a, b: a & b, [rows[d] == fitted[d] for d in dims])
    both = rows.join(maybe_broadcast(fitted), on).select("_row", *[rows[d] for d in dims], "_tokens", "weight", "p", "expected")
    u = draw(F.col("_row.doc_id"))
    copies = F.floor("expected") + (u < F.col("expected") - F.floor("expected")).cast("bigint")
    # More copies of a document without tokens would add nothing to any share.
    return both.withColumns({"kept": u < F.col("p"), "copies": F.when(F.col("_tokens") > 0, copies).otherwise(F.least(copies, F.lit(1)))})


def mix(docs: DataFrame, keep: float = KEEP, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """_row (all columns), _source, _lang, _topic, _tokens, weight, p, expected, kept and copies of every document.

    Null values of a dimension count as '', null texts as empty, long texts whole; documents of one id, or without one, are drawn
    alike. `copies` make the sample that holds the targets, `kept` the one without repeats. targets: by name of a dimension a table
    (value, share) of one's own. A document without tokens is drawn like the others of its cell, once at most. An empty table
    gives no rows.
    """
    rows = with_cells(docs)
    return _drawn(rows, _cells(rows), keep, _own(targets))


def op8_mixture(docs: DataFrame) -> DataFrame:
    """Cell, weight, and probability and decision of every document where none may be repeated. Nulls, repeats and empty tables as
    in mix()."""
    m = mix(docs.select("doc_id", "text", "source", "lang"))
    return m.select("_row.doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"),
                    F.col("_tokens").alias("tokens"), F.round("weight", 6).alias("weight"), F.round("p", 6).alias("p"), "kept")


def op8_copies(docs: DataFrame) -> DataFrame:
    """Cell, weight, expected and drawn copies of every document; the copies together hold the targets. Nulls, repeats and empty
    tables as in mix()."""
    m = mix(docs.select("doc_id", "text", "source", "lang"))
    return m.select("_row.doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"),
                    F.col("_tokens").alias("tokens"), F.round("weight", 6).alias("weight"), F.round("expected", 6).alias("expected"), "copies")


def op8_shares(docs: DataFrame, keep: float = KEEP, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """Of each value of each dimension its share of the tokens: in the documents, as a target, expected and drawn in the sample
    of copies, and drawn in the one without repeats."""
    own = _own(targets)
    rows = with_cells(docs.select("doc_id", "text", "source", "lang"))
    cells = _cells(rows)
    of = {"input_share": F.col("_tokens"), "expected_share": F.col("_tokens") * F.col("expected"), "sampled_share": F.col("_tokens") * F.col("copies"),
          "once_share": F.when(F.col("kept"), F.col("_tokens")).otherwise(0)}
    dims = [f"_{d}" for d in DIMENSIONS]
    sums = materialize(_drawn(rows, cells, keep, own).groupBy(*dims).agg(*[F.sum(c).cast("double").alias(n) for n, c in of.items()]), "shares")
    whole = sums.agg(F.struct(*[F.sum(n).alias(n) for n in of])).scalar()
    parts = []
    for name, d in zip(DIMENSIONS, dims):
        have = sums.groupBy(d).agg(*[F.coalesce(F.try_divide(F.sum(n), whole[n]), F.lit(0.0)).alias(n) for n in of])
        aim = materialize(target_shares(cells, d, targets=own), f"aim{d}")
        parts.append(have.join(aim, d, "left").select(F.lit(name).alias("dimension"), F.col(d).alias("value"), "input_share",
                                                      F.coalesce("share", F.lit(0.0)).alias("target_share"), *list(of)[1:]))
    return reduce(DataFrame.unionAll, parts)


def keep_sampled(docs: DataFrame, keep: float = KEEP, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The sampled documents with their columns as they are, as many times as they are drawn."""
    drawn = mix(docs, keep, targets).where("copies > 0")
    return drawn.select("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select("_row.*")


def _sql() -> str:
    text = "coalesce(text, '')"
    steps = [rf"""d AS (SELECT doc_id, source, lang, tokens, CASE WHEN contains(t, ' | ') THEN 'table'
        WHEN length(regexp_replace(t, '[^%$#*&]', '', 'g')) * 20 > length(t) THEN 'symbols' WHEN tokens >= 1000 THEN 'essay'
        WHEN tokens >= 100 THEN 'article' ELSE 'note' END AS topic FROM (SELECT doc_id, coalesce(source, '') AS source,
        coalesce(lang, '') AS lang, {text} AS t, len(regexp_extract_all({text}, '[^{_SPACE}]+'))::BIGINT AS tokens FROM documents))""",
             "c0 AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS t, 1.0::DOUBLE AS w FROM d GROUP BY ALL)",
             "n AS (SELECT sum(t) AS total FROM c0)"]
    for x in DIMENSIONS:
        steps.append(f"a_{x} AS (SELECT {x}, s / sum(s) OVER () AS share FROM (SELECT {x}, sum(t) ** {FLATTEN} AS s FROM c0 GROUP BY {x}))")
    i = 0
    for _ in range(ROUNDS):
        for x in DIMENSIONS:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.source, c{i}.lang, c{i}.topic, t, w * share * total / h AS w FROM c{i} JOIN a_{x} USING ({x})
                JOIN (SELECT {x}, sum(t * w) AS h FROM c{i} GROUP BY {x}) USING ({x}), n)""")
            i += 1
    steps.append(f"f0 AS MATERIALIZED (SELECT {KEEP} * sum(t) / sum(t * w) AS f FROM c{i})")
    for r in range(CAP_ROUNDS):
        steps.append(f"""f{r + 1} AS MATERIALIZED (SELECT ({KEEP} * sum(t) - coalesce(sum(t) FILTER (w * f >= 1), 0)) / sum(t * w) FILTER (w * f < 1) AS f
            FROM c{i}, f{r})""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, source, lang, topic, tokens, round(w, 6) AS weight, round(least(1.0, w * f), 6) AS p,
       ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < least(1.0, w * f) AS kept
FROM d JOIN c{i} USING (source, lang, topic), f{CAP_ROUNDS}"""


OP8_SQL = _sql()
