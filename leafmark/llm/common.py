"""Session helpers shared by the operators: reading, shipping code, cutting lineage."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.sources.stage import release, settle

__all__ = ["doc_texts", "prepare", "release", "settle", "table"]

_ROOT = str(Path(__file__).resolve().parents[2])

#: Session settings that the Python stages need: small Arrow batches bound a worker's
#: memory whatever the length of the texts.  They are only ever lowered.
_AT_MOST = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": 4096,
    "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20,
}


def prepare(spark: SparkSession) -> None:
    """Make this package importable in Python workers and bound their Arrow batches.

    Plans run after the call that made them has returned, so the session keeps these
    settings: the two of `_AT_MOST`, and that shuffle files go when a query has ended
    (results that are used again are written tables).
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
    for key, most in _AT_MOST.items():
        now = _number(spark.conf.get(key))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def _number(value: str) -> int:
    """A number of bytes as Spark writes it: 4096, 4m, 64MB."""
    found = re.fullmatch(r"(-?\d+)([kmgt]?)b?", value.strip().lower())
    return int(found[1]) << 10 * " kmgt".index(found[2] or " ") if found else 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables, by Spark's reader only (the path may be remote)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with null text as empty; other columns, whatever their names, go.

    Rows with a null doc_id cannot be named in a result and are left out.
    """
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).where("doc_id IS NOT NULL")
