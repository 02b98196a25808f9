"""Each stage of the pipeline against brute force on its own input."""

import collections

import corpus_pipeline
from leafmark.llm.common import settle
from test_minhash import brute as groups
from test_suffixes import brute as cuts

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = settle(stage(spark, docs, SF))
        after = {r.doc_id: r for r in docs.collect()} if name != "packing" else docs.collect()
        seen[name] = (before, after)
        if name != "packing":
            assert docs.columns == columns and set(after) <= set(before)
    before, after = seen["near_dedup"]
    expected = groups({d: r.text for d, r in before.items()}, 80)
    assert set(after) == {d for d, (_, c) in expected.items() if c == d}
    before, after = seen["suffix_dedup"]
    assert set(after) == set(before)
    for d, ((n, removed, _, _),) in cuts([(d, r.text) for d, r in before.items()], 50).items():
        assert n - removed - 8 <= len(after[d].text.encode()) <= n - removed and after[d].n_chars == len(after[d].text)
    before, after = seen["decontamination"]
    items = [r.text.lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {d for d, r in before.items() if any(i in r.text.lower() for i in items)} <= set(before) - set(after)
    before, after = seen["packing"]
    assert {r.doc_id for r in after} == set(before)
    bins = collections.Counter()
    for r in after:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 2048


def test_toxic_documents_go_and_clean_ones_stay(spark):
    larger = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, larger).select("doc_id").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    assert sum(d not in kept for d, t in labels.items() if t) > 0.6 * sum(labels.values())
    assert sum(d in kept for d, t in labels.items() if not t) > 0.98 * sum(not t for t in labels.values())


def test_odd_rows_pass_every_stage(spark, docs, none, tmp_path):
    """Nulls, empty, repeated and very long texts, columns whose names the stages use."""
    for name, frame in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], frame).write.parquet(str(tmp_path / f"{name}.parquet"))
    row = ("en", 5, "r", 0.5)
    more = [(9001, "lorem ipsum dolor " * 30_000, *row), (9002, None, *row), (9002, "other words here", *row), (None, "x y z", *row)]
    rows = docs.union(spark.createDataFrame(more, docs.schema))
    for start in (rows, none):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            now = settle(stage(spark, now, str(tmp_path)))
            assert name == "packing" or now.columns == docs.columns
        packed = {r.doc_id for r in now.collect()}
        if start is none:
            assert not packed
        else:
            assert {9001, 9002} <= packed and None not in packed


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
