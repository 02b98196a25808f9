"""The queries of this subpackage: thin uses of its operators on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm import collocations, decontaminate, fingerprints, language, licenses, minhash, packing, quality, repair, sentences, suffixes, token_counts, toxicity
from leafmark.llm.common import table
from leafmark.llm.subwords import in_fold


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=2048)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~in_fold("doc_id", 5, 0))
    lexicon = toxicity.train(docs, labels.select("doc_id", labels.toxic.alias("label")))
    return toxicity.score(docs, lexicon).select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"), width=50)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_neighbours(table(spark, sf_dir, "documents"))


def document_fingerprint_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of operator 5 on the corpus: banding, and links verified by edit distance."""
    return fingerprints.similar(table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(~in_fold("doc_id", 4, 2)))
    return language.identify(docs, model).select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~in_fold("doc_id", 3, 1))
    model = quality.train(docs, labels.select("doc_id", labels.quality.alias("label")))
    return quality.score(docs, model).select("doc_id", in_fold("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentences.remove_repeated_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: The documents have no paths of their own.  Each gets one in a tree by source: most in
#: source/thousand/hundred, every tenth one level up and every hundredth right below the
#: source; the latter two are named as licence files are, so that those with a licence
#: pass it on over one to three levels.  A null source is a folder without a name.
PATH = """coalesce(source, '') || CASE WHEN doc_id % 100 = 0 THEN '/LICENSE.'
  WHEN doc_id % 10 = 0 THEN '/' || CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS STRING) || '/LICENSE.'
  ELSE '/' || CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS STRING) || '/' || CAST(CAST(floor(doc_id / 100) AS BIGINT) AS STRING) || '/' END || CAST(doc_id AS STRING)"""


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select(F.expr(PATH).alias("path"), "text"))
    # The path ends with the document's number.
    return found.select(F.regexp_extract("path", "-?[0-9]+$", 0).cast("long").alias("doc_id"), "path", "license", "score", "origin", "from_path")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(table(spark, sf_dir, "conversations")))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), limit=4096)


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=100, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_benchmark_decontamination,
        op3_toxicity,
        op4_suffix_array_dedup,
        op5_document_fingerprints,
        document_fingerprint_groups,
        op6_minhash_near_dedup,
        op7_language_id,
        op8_quality_classifier,
        op9_substring_dedup,
        op10_license_scan,
        op11_conversation_repair,
        op12_token_counts,
        op13_phrase_collocations,
    )
}

#: DuckDB SQL for those that SQL can express on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op10_license_scan": licenses.oracle_sql(f"SELECT doc_id, {PATH} AS path, coalesce(text, '') AS text FROM documents"),
    "op11_conversation_repair": repair.oracle_sql(),
    "op13_phrase_collocations": collocations.oracle_sql(),
}
