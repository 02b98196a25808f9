"""Language identification by averaged hashed subword embeddings and a linear softmax.

Byte n-grams of the lower-cased text are the features.  The softmax is calibrated by a
temperature on texts that the fit does not see, and so is its rejection: `rejected` are
predictions less sure than 99 in 100 of those texts', or than `reject_below`.  Null texts
and those without any letter are `und` (score 0, rejected).  Empty tables give no rows;
with no labelled text nothing can be learned and every row is `und`; repeated rows each
get their row; rows without a doc_id are left out; columns other than doc_id, text and
lang are ignored, whatever their names.  Of equal scores the smaller lang wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm import subwords
from leafmark.llm.common import prepare


def train(docs: DataFrame, shape: subwords.Shape = subwords.LANGUAGE) -> subwords.Model | None:
    """A model from the rows of `docs` that have a lang, or None where none has."""
    prepare(docs.sparkSession)
    labels = docs.select("doc_id", F.col("lang").cast("string").alias("label"))
    texts, names = subwords.sampled(docs, labels, shape)
    return subwords.fit(texts, names, shape) if texts else None


def identify(docs: DataFrame, model: subwords.Model | None, reject_below: float | None = None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every whole text; lang_pred is the likeliest
    lang whether rejected or not."""
    prepare(docs.sparkSession)
    if model is None:
        return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    best = F.array_max("scores")
    least = model.unsure if reject_below is None else reject_below
    return subwords.predicted(docs, model).select(
        "doc_id",
        F.when(F.col("letters"), F.col("label")).otherwise("und").alias("lang_pred"),
        F.when(F.col("letters"), best).otherwise(0.0).alias("score"),
        (~F.col("letters") | (best < least)).alias("rejected"),
    )
