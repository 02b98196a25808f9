"""Corpus pipeline: from documents to packed training sequences.

Each stage works on all that its predecessor kept, as written to Parquet and read again
by whoever runs the stages: toxic documents go, one document of each near-duplicate
group stays, bytes repeated from smaller doc_ids go, documents that hold a benchmark item
go, and the rest is packed.  All stages but the last return the columns of documents.

Null texts are empty texts: they stay, and pack as one end id.  Texts of any length are
taken whole.  Rows without a doc_id pass the first stage and leave at the second.  Rows
that repeat a doc_id stay or go together in the second and fourth stage; in the third they
are one document, so they take nothing from each other.  Without labels of both kinds no
document is toxic, and without benchmark items none is contaminated.  Further columns, of
whatever names, are carried along.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm import decontaminate, minhash, packing, suffixes, toxicity
from leafmark.llm.common import settle, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity score does not reject."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.without_toxic(docs, toxicity.train(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near duplicates (0.8 on five-word shingles)."""
    kept = minhash.near_duplicates(docs, percent=80).where("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the bytes of 50-byte strings that an earlier document has."""
    return suffixes.without_repeats(docs, width=50)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens of the documents, in sequences of 2048."""
    return packing.pack(docs, capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("suffix_dedup", cut_repeats),
    ("decontamination", decontaminated),
    ("packing", pack),
]

#: SQL cannot express these stages; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
