"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct words and the beginnings of its longer words, hashed into a fixed number of bins. The bins that
depend on the label are kept, and a factorization machine learns a weight for each of them and for each pair of them, so
that words which are harmless alone can count together.
"""

from __future__ import annotations

from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import HashingTF, UnivariateFeatureSelector
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropledger.llm.common import text_of
from cropledger.session import materialize

BINS = 1 << 18
#: Bins are kept that depend on the label, by a chi-squared test with this rate of error over all bins together.
ERROR_RATE = 0.05
FACTORS = 4
ITERATIONS = 120
#: Labelled documents that the model is fitted on, at most: those with the smallest hashed ids.
FIT_ROWS = 40_000
REJECT_FROM = 0.3


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 4 is 2; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def terms(text: Column) -> Column:
    """Distinct lower-case words of the whole text, and the first 4, 5 and 6 letters of the longer ones."""
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))
    heads = [F.transform(F.filter(words, lambda w, k=k: F.length(w) > k), lambda w, k=k: F.concat(F.left(w, F.lit(k)), F.lit("*"))) for k in (4, 5, 6)]
    return F.concat(words, *heads)


def _hashed(df: DataFrame) -> DataFrame:
    tf = HashingTF(inputCol="_terms", outputCol="_bins", numFeatures=BINS, binary=True)
    return tf.transform(df.withColumn("_terms", terms(F.col("_text")))).drop("_terms", "_text")


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(_text, label) of labelled documents that are not held out, `rows` at most. A document with several labels is toxic
    if one of them says so; null labels and labels without a document teach nothing."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg((F.max("toxic") > 0).cast("double").alias("label"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # `rows` ids and labels at most: some hundred kB.
    return docs.select("doc_id", text_of().alias("_text")).join(F.broadcast(chosen), "doc_id").select("_text", "label")


class ToxicityModel:
    def __init__(self, selector, machine):
        self.selector, self.machine = selector, machine

    def score(self, docs: DataFrame) -> DataFrame:
        """All columns, and `score` in 0..1 (replaced if there is one). Null and empty texts get the score of no terms."""
        columns = [c for c in docs.columns if c != "score"]
        row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")
        if self.machine is None:
            return docs.select(*columns).withColumn("score", F.lit(0.0))
        hashed = _hashed(docs.select(row, text_of().alias("_text")))
        scored = self.machine.transform(self.selector.transform(hashed))
        return scored.select("_row.*", vector_to_array("probability")[1].alias("score"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> ToxicityModel:
    """Without labels of both kinds, or a bin that depends on them, there is nothing to learn: every score is then 0."""
    sample = materialize(_hashed(labelled_sample(docs, labels, rows)), "toxic-sample")
    if sample.select("label").distinct().count() < 2:
        return ToxicityModel(None, None)
    selector = UnivariateFeatureSelector(featuresCol="_bins", labelCol="label", outputCol="_kept", selectionMode="fwe")
    selector = selector.setFeatureType("categorical").setLabelType("categorical").setSelectionThreshold(ERROR_RATE).fit(sample)
    if not selector.selectedFeatures:
        return ToxicityModel(None, None)
    fitted = materialize(selector.transform(sample).select("label", "_kept").coalesce(6), "toxic-bins")
    machine = FMClassifier(featuresCol="_kept", labelCol="label", factorSize=FACTORS, maxIter=ITERATIONS, stepSize=0.05,
                           regParam=1e-4, initStd=0.01, tol=1e-7, seed=11)
    return ToxicityModel(selector, machine.fit(fitted))


def op1_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from 0.3) of every document.

    Null and empty texts have no terms and get the score of such; long texts count whole. Equal texts get equal scores. A null
    doc_id is scored and not held out. Rows without a label, and null labels, teach nothing; without labels all score 0. An empty
    table gives an empty result.
    """
    scored = fit_toxicity(docs, labels).score(docs.select("doc_id", "text"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= REJECT_FROM).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted to be toxic, with their columns as they are."""
    model = fit_toxicity(docs, labels)
    kept = model.score(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "text"))
    return kept.where(F.col("score") < REJECT_FROM).select("_doc.*")
