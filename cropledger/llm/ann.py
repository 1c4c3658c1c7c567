"""Approximate nearest neighbours by inner product with a permutation index.

Every vector is represented by the order in which it is near to a set of pivots. An index block holds an inverted file for each
pivot: the pivot's place in the order of every vector of the block. A query sums up, over the files, how far its own places
are off (the footrule distance of the two orders), and the vectors of least distance are ranked again by their exact inner
products. Vectors get one component more that makes all of them as long as the longest, so that nearness and inner product
order them alike.

Whole orders are kept and all files are read: on vectors with little structure, orders cut to their first pivots, or visits to
the nearest files only, lose too many neighbours. Queries meet all rows, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cropledger.session import materialize

NEIGHBOURS = 20
PIVOTS = 128  # at most; drawn from the sample
SAMPLE_ROWS = 4_096  # the rows with the smallest hashed ids, from which pivots are drawn
RERANK_SHARE = 0.05  # of a block's vectors are ranked again by exact products
RERANK_LEAST = 400  # and so many at least
BLOCK_ROWS = 8_000  # vectors of an index block
QUERY_ROWS = 2_000  # queries that meet a block in one task


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part: ids and vectors present, finite, not zero, of the commonest length."""
    v = F.col(vec_col).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull()).where(ok)
    top = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (top["n"] if top else 0))


def choose_pivots(rows: DataFrame, pivots: int, sample_rows: int, longest: float) -> np.ndarray:
    """Distinct lengthened vectors of the sample, spread out: each next one is the farthest of a few drawn ones."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()
    x = np.unique(lengthened(np.array([r["v"] for r in sample], dtype=float), longest), axis=0)
    x = x[np.random.default_rng(7).permutation(len(x))]
    if len(x) <= pivots:
        return x
    centres = x[:pivots].copy()
    for _ in range(5):  # the mean of the sample's vectors nearest to each pivot stands for it
        near = (x @ centres.T).argmax(1)
        for j in range(pivots):
            if (near == j).any():
                m = x[near == j].mean(0)
                centres[j] = m * (longest / max(np.linalg.norm(m), 1e-12))
    return centres


def lengthened(x: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest**2 - (x**2).sum(1), 0))
    return np.hstack([x, rest[:, None]])


def _places(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The place of each pivot in each vector's order, from 0."""
    order = np.argsort(-(x @ pivots.T), axis=1, kind="stable")
    places = np.empty(order.shape, dtype=np.int16)
    np.put_along_axis(places, order, np.arange(order.shape[1], dtype=np.int16)[None, :], axis=1)
    return places


def _search(block: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of one block for each query: footrule distance first, exact products of the best then."""
    if not len(block) or not len(asked):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
    block = block.sort_values("vec_id", kind="stable")
    ids, x = block["vec_id"].to_numpy(), np.stack(block["v"].to_numpy())
    files = np.ascontiguousarray(np.stack(block["places"].to_numpy()).T)
    reranked = max(RERANK_LEAST, int(RERANK_SHARE * len(ids)))
    out = []
    for query, v, places in zip(asked["query_id"], asked["v"], asked["places"]):
        foot = np.zeros(len(ids), dtype=np.int16)
        for file, place in zip(files, places):
            foot += np.abs(file - place)
        others = np.flatnonzero(ids != query)
        if len(others) > reranked:
            f = foot[others]
            limit = np.partition(f, reranked - 1)[reranked - 1]
            sure, tied = others[f < limit], others[f == limit]  # ties go to smaller ids
            others = np.concatenate([sure, tied[:reranked - len(sure)]])
        score = (x[others] * np.asarray(v)).sum(1)
        best = np.lexsort((ids[others], -score))[:k]
        out.append(pd.DataFrame({"query_id": query, "vec_id": ids[others][best], "score": score[best]}))
    return pd.concat(out)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, itself left out; ties go to smaller ids.

    Vectors that are null, zero, not finite or of another length take no part. Rows that repeat an id count as the query's
    own; a vector row repeated under one id is found once. An empty table gives no rows.
    """
    rows = usable(vectors, id_col, vec_col)
    size = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.count("*")).first()
    if not size[1]:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    longest = float(np.sqrt(size[0])) * (1 + 1e-12)
    pivots = choose_pivots(rows, PIVOTS, SAMPLE_ROWS, longest)

    def represent(batches: Iterator[pd.DataFrame], own: bool) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy())
                # A query is not lengthened: its order is that of its inner products.
                x = lengthened(x, longest) if own else np.hstack([x, np.zeros((len(x), 1))])
                yield b.assign(places=list(_places(x, pivots)))

    index = materialize(rows.mapInPandas(lambda b: represent(b, True), "vec_id bigint, v array<double>, places array<smallint>"), "permutations")
    asked = usable(queries, id_col, vec_col).where(F.size("v") == pivots.shape[1] - 1).select(F.col("vec_id").alias("query_id"), "v").dropDuplicates(["query_id"])
    asked = materialize(asked.mapInPandas(lambda b: represent(b, False), "query_id bigint, v array<double>, places array<smallint>"), "queries")
    blocks, parts = -(-size[1] // BLOCK_ROWS), max(1, -(-asked.count() // QUERY_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
    left = index.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("part", every(parts))
    right = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).withColumn("block", every(blocks))
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(
        lambda block, own: _search(block, own, k), "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest(vectors: DataFrame) -> DataFrame:
    """Every row whose vec_id is divisible by 20, searched for among all rows."""
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
