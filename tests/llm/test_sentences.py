import re

import numpy as np
import pytest

from leafmark.llm import sentences
from leafmark.llm import textops as X


def digest(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return int(X.Hasher(data)(np.array([0]), np.array([len(data)]))[0])


def split(text):
    """Sentences as lists of words' places, by the rules read word by word."""
    words = [(m.start(), m.end()) for m in re.finditer(r"[^ \t\n\x0b\x0c\r]+", text)]
    out, own = [], []
    for i, (a, b) in enumerate(words):
        own.append((a, b))
        if i + 1 == len(words) or text[b - 1] in ".!?" or any(c in "\n\r" for c in text[b : words[i + 1][0]]):
            out += [own] if len(own) <= 16 else cut(own, [digest(text[a:b]) for a, b in own])
            own = []
    return out


def cut(own, codes):
    out, piece = [], []
    for i, word in enumerate(own):
        piece.append(word)
        around = codes[max(0, i - 3) : i] + codes[i + 1 : i + 4]
        if all(codes[i] < c for c in around) or len(piece) == 16 or i + 1 == len(own):
            out.append(piece)
            piece = []
    return out


def brute(rows, span):
    seen, out = set(), {}
    for d, text in sorted((d, t or "") for d, t in rows if d is not None):
        found = split(text)
        keys = [" ".join(text[a:b] for a, b in s) for s in found]
        gone = set()
        for i in range(len(keys) - span + 1) if len(keys) >= span else range(min(1, len(keys))):
            key = tuple(keys[i : i + span])
            if key in seen:
                gone |= set(range(i, min(i + span, len(keys))))
            seen.add(key)
        at = [s[0][0] for s in found] + [len(text)]
        out[d] = (len(keys), len(gone), text[: at[0]] + "".join(text[at[i] : at[i + 1]] for i in range(len(keys)) if i not in gone))
    return out


@pytest.mark.parametrize("span", [2, 3])
def test_spans(docs, rows, span):
    found = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in sentences.remove_repeated_spans(docs, span).collect()}
    assert found == brute([r[:2] for r in rows], span)


def test_one_long_sentence(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"One a. {passage}\nTwo b."), (2, f"Three c.\n{passage} four d.")]
    found = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in sentences.remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute(rows, 3) and found[1][1] == 0 and found[2][1] >= 3


def test_a_common_run_and_a_very_long_text(spark):
    """A passage of most documents goes by broadcast, a word said over and over is cut."""
    passage = "So it is. Here we go. Then it ends."
    rows = [(i, f"Own {i} a. Own {i} b. {passage}" if i % 3 else f"Own {i}. {passage} {passage}") for i in range(60)]
    rows += [(100, "ab " * 50_000), (101, "ab " * 60 + "\n" + passage), (101, "ab " * 60 + "\n" + passage), (102, "é" * 200_000)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, run long, place string")
    found = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in sentences.remove_repeated_spans(frame).collect()}
    assert found == brute([r for n, r in enumerate(rows) if n != 62], 3) and found[101][1] > 0 and found[1][1] == 3


@pytest.mark.parametrize("size", [51, 65, 80])
def test_passage_inside_a_long_sentence_at_every_offset(spark, size):
    passage = " ".join(f"w{i}" for i in range(size))
    around = lambda d, n: " ".join(f"d{d}n{i}" for i in range(n))
    rows = [(1, f"{around(1, 5)} {passage} {around(1, 9)[::-1]}")]
    rows += [(10 + k, f"Own {k}.\n{around(10 + k, k)} {passage} {around(90 + k, 7)}") for k in range(40)]
    found = {r.doc_id: r for r in sentences.remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].n_removed == 0 and found[1].text == rows[0][1]
    for d, text in rows[1:]:
        gone = [w for w in text.split() if w not in found[d].text.split()]
        assert found[d].n_removed >= 1 and len(gone) >= 12 and all(w.startswith("w") for w in gone)


def test_edges(spark, none):
    assert sentences.remove_repeated_spans(none).count() == 0
    rows = [(1, "A b. C d. E f. G."), (2, "x. C d.  E f.\tG. y"), (3, "A b. C d."), (4, "A b.\nC d."), (5, None), (6, " \n"), (None, "A b. C d. E f.")]
    found = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in sentences.remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute(rows, 3)
    assert found[2][2] == "x. y" and found[4][1] == 2 and found[5] == (0, 0, "")


@pytest.mark.parametrize("hot", [0, 10, 10**9])
def test_joins_keep_each_occurrence_as_one_row(spark, monkeypatch, hot):
    """Whichever runs count as common, the result is the same and no join's rows depend on how large groups are."""
    monkeypatch.setattr(sentences, "HOT", hot)
    rows = [(i, f"Own {i}. So it is. Here we go. Then it ends.") for i in range(40)] + [(50 + i, f"P{i // 2} a. P{i // 2} b. P{i // 2} c.") for i in range(8)]
    found = sentences.remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in found.collect()} == brute(rows, 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 3 and "Join Inner" not in plan
