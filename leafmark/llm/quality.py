"""Document quality by supervised embeddings of hashed word and character n-grams.

Null texts are empty texts, which get the score of a document without features.  Texts of
any length are scored whole.  With no labels every score is 0.5.  Empty tables give no
rows; repeated rows each get their row; rows without a doc_id are left out; columns other
than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm import subwords
from leafmark.llm.common import prepare


def train(docs: DataFrame, labels: DataFrame, shape: subwords.Shape = subwords.QUALITY) -> subwords.Model | None:
    """A model of the 0/1 column `label` of `labels` (doc_id, label), or None without labels."""
    prepare(docs.sparkSession)
    texts, names = subwords.sampled(docs, labels.select("doc_id", F.col("label").cast("int").alias("label")), shape)
    return subwords.fit(texts, [int(x) for x in names], shape) if texts else None


def score(docs: DataFrame, model: subwords.Model | None) -> DataFrame:
    """(doc_id, score, predicted): the probability of label 1, and whether it is 0.5 or more."""
    prepare(docs.sparkSession)
    if model is None or model.classes not in ([0, 1],):
        only = 0.5 if model is None else float(model.classes == [1])
        rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(only).alias("score"))
    else:
        rows = subwords.predicted(docs, model).select("doc_id", F.col("scores")[1].alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
