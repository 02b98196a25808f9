import hashlib

import numpy as np
import pytest

from leafmark.llm import suffixes


def brute(rows, width):
    seen, out = {}, {}
    for d, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        for i in range(len(raw) - width + 1):
            seen.setdefault(raw[i : i + width], d)
    for d, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - width + 1):
            if seen[raw[i : i + width]] < d:
                gone[i : i + width] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        runs = int((gone & ~np.r_[False, gone[:-1]]).sum())
        out.setdefault(d, []).append((len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return {d: sorted(v) for d, v in out.items()}


def found(frame, *args, **named):
    out = {}
    for r in suffixes.remove_repeats(frame, *args, **named).collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
        out.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    return {d: sorted(v) for d, v in out.items()}


@pytest.mark.parametrize(("width", "hot"), [(50, None), (50, 2), (64, None)])
def test_removed_bytes(docs, rows, width, hot):
    assert found(docs, width, hot) == brute([r[:2] for r in rows], width)


def test_edges(spark, none):
    assert suffixes.remove_repeats(none).count() == 0
    s = "".join(chr(97 + i * 7 % 26) for i in range(49))
    rows = [(1, s + "A"), (2, s + "A"), (3, s), (4, "q" + s + "A" + "q"), (4, s + "A"), (5, None), (6, "ab" * 100), (7, "ab" * 40 + "c"), (8, "ba" * 30)]
    assert found(spark.createDataFrame([*rows, (None, s + "A")], "doc_id long, text string")) == brute(rows, 50)
    with pytest.raises(ValueError, match="width"):
        suffixes.repeated_spans(none, 20)


def test_rows_keep_their_columns(docs, rows):
    expected = brute([r[:2] for r in rows], 50)
    out = suffixes.without_repeats(docs).collect()
    assert {(r.doc_id, r.lang, r.tag, r.row, r.score) for r in out} == {(r[0], *r[2:]) for r in rows}
    for r in out:
        (n, removed, _, digest), = expected[r.doc_id]
        if not removed:
            assert hashlib.sha256(r.text.encode()).hexdigest() == digest
        assert n - removed - 8 <= len(r.text.encode()) <= n - removed


def test_blocks_are_cut_at_keys(docs, rows, monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    keys = np.sort(rng.integers(0, 40, 600))
    content = [bytes([97 + k % 3]) * 60 for k in keys]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(keys), pa.array(rng.integers(0, 90, 600)), pa.array(np.zeros(600, np.int32)), pa.array([[0]] * 600), pa.array(np.zeros(600, np.int32)), pa.array(content)],
        names=["key", "doc_id", "tag", "starts", "lead", "bytes"],
    )

    def spans(size, step):
        monkeypatch.setattr(suffixes, "BLOCK", size)
        parts = suffixes._sort_blocks(50)(batch.slice(i, step) for i in range(0, 600, step))
        return sorted(t for p in parts for t in zip(*(c.to_pylist() for c in p.columns), strict=True))

    assert {s[0] for s in spans(1 << 30, 600)} == {s[0] for s in spans(1, 7)}


@pytest.mark.parametrize("hot", [None, 20])
def test_passage_of_most_documents_and_a_very_long_text(spark, hot):
    rng = np.random.default_rng(6)
    word = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(n))
    passage = word(30)
    rows = [(i, f"{word(8)} {passage} {word(5)}") for i in range(120)]
    rows += [(200 + i, f"{word(3)} {passage[10 + i : 70 + i]} {word(3)}") for i in range(40)]  # unlike stretches of one gram
    rows += [(300, word(20_000) + passage), (300, "again " + passage), (301, "é漢" * 40_000), (302, "x" + "é漢" * 60)]
    frame = spark.createDataFrame([(*r, b"b", 7, [1]) for r in rows], "doc_id long, text string, bytes binary, key long, starts array<int>").repartition(6)
    assert found(frame, 50, hot) == brute(rows, 50)
