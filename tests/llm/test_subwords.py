import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from leafmark.llm import language, quality, subwords
from leafmark.llm import textops as X

RNG = random.Random(9)
SYLLABLES = {"aa": ["ta", "ka", "no", "mi", "Ra"], "bb": ["str", "ung", "sch", "ein", "äb"], "cc": ["ción", "ar", "que", "os", "ñe"]}


def text(lang, n):
    return " ".join("".join(RNG.choice(SYLLABLES[lang]) for _ in range(RNG.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, text(lang := RNG.choice(list(SYLLABLES)), RNG.randint(2, 120)), lang if i % 9 else None) for i in range(400)]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 + 34 — ²", "cc"), (None, "ta", "aa")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), {r[0]: r[2] for r in rows}


def test_language(corpus):
    docs, langs = corpus
    held = {d for d in langs if d is not None and zlib.crc32(str(d).encode()) % 4 == 2}
    model = language.train(docs.where(~subwords.in_fold("doc_id", 4, 2)))
    found = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert len(found) == 403
    right = [found[d].lang_pred == langs[d] for d in held if langs[d] and d < 900]
    assert np.mean(right) > 0.97
    assert {(found[d].lang_pred, found[d].score) for d in (900, 901, 902)} == {("und", 0.0)}
    assert all(0 < r.score <= 1 for d, r in found.items() if d < 900)
    assert all(found[d].rejected for d in (900, 901, 902))
    known = [found[d] for d in found if d < 900]
    assert all(r.rejected == (r.score < model.unsure) for r in known) and np.mean([r.rejected for r in known]) < 0.1
    strict = language.identify(docs, model, reject_below=1.1).collect()
    assert all(r.rejected for r in strict) and {r.lang_pred for r in strict} == {"und", *SYLLABLES}


def test_strangers_are_rejected(spark, corpus):
    docs, _ = corpus
    model = language.train(docs.where("lang IS NOT NULL"))
    rng = random.Random(2)
    strange = [(i, " ".join("".join(rng.choice("бвгджзлмн") for _ in range(5)) for _ in range(8))) for i in range(50)]
    found = language.identify(spark.createDataFrame(strange, "doc_id long, text string"), model).collect()
    assert np.mean([r.rejected for r in found]) > 0.8


def test_language_without_labels(corpus):
    docs, _ = corpus
    model = language.train(docs.where("lang = 'zz'"))
    assert {r.lang_pred for r in language.identify(docs, model).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_quality(spark):
    rows = []
    for i in range(600):
        good = i % 3 > 0
        t = text("aa", 60)
        rows.append((i, t if good else RNG.choice([t.upper(), " | ".join(t.split()), " ".join([t.split()[0]] * 50)]), int(good)))
    docs = spark.createDataFrame([*((r[0], r[1], "s") for r in rows), (900, None, "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 2], "doc_id long, label int")
    model = quality.train(docs, labels)
    found = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert np.mean([found[d].predicted == y for d, _, y in rows if d % 2 == 0]) > 0.9
    assert 0 <= found[900].score <= 1
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}
    assert {r.score for r in quality.score(docs, quality.train(docs, labels.where("label = 1"))).collect()} == {1.0}


def slow_probabilities(model, text):
    """A text's probabilities by the definition: feature by feature."""
    shape, kinds = model.shape, []
    data = (text.lower() if shape.fold else text).encode()
    for gram in shape.grams:
        own = []
        for i in range(len(data) - gram + 1):
            code = int.from_bytes(data[i : i + gram], "little") * 2654435761 & 0xFFFFFFFF
            code = (code ^ gram * 0x85EBCA6B & 0xFFFFFFFF) * 0xC2B2AE35 & 0xFFFFFFFF
            own.append(code >> 32 - shape.bits)
        kinds.append(own)
    if shape.words:
        words = re.findall(rb"[^\x20\x09-\x0D]+", data)
        mixed = lambda x: int(X.mix(np.array([x & (1 << 64) - 1], np.uint64))[0])
        codes = [int(X.Hasher(np.frombuffer(w, np.uint8))(np.array([0]), np.array([len(w)]))[0]) for w in words]
        kinds.append([c >> 64 - shape.bits for c in codes])
        pairs = [0x243F6A8885A308D3 if a == b else mixed(a * 3 + b) for a, b in zip(codes, codes[1:], strict=False)]
        kinds.append([c >> 64 - shape.bits for c in pairs])
    sums = sum((model.table[:, own].astype(float).mean(axis=1) for own in kinds if own), np.zeros(len(model.classes)))
    z = (sums / len(kinds) + model.bias) / model.temperature
    return np.exp(z - z.max()) / np.exp(z - z.max()).sum()


@pytest.mark.parametrize("shape", [subwords.LANGUAGE, subwords.QUALITY])
def test_scores_feature_by_feature(spark, shape):
    rng = np.random.default_rng(3)
    model = subwords.Model(shape, ["a", "b", "c"], rng.normal(0, 2, (3, 1 << shape.bits)).astype(np.float32), rng.normal(0, 1, 3), 1.7)
    texts = ["", "a", "ab cd", "Ünï cödé Text", "x x x y", text("bb", 80), text("cc", 5) + "\n\t" + text("aa", 9), "漢字" * 40, "word " * 60_000]
    frame = spark.createDataFrame([(i, t, 1, "z") for i, t in enumerate(texts)] + [(1, "a", 1, "z"), (99, None, 1, "z")], "doc_id long, text string, label long, scores string")
    found = [(r.doc_id, r.scores) for r in subwords.predicted(frame, model).collect()]
    assert len(found) == len(texts) + 2
    for d, scores in found:
        assert np.allclose(scores, slow_probabilities(model, texts[d] if d < 99 else ""), atol=2e-5)


@pytest.mark.parametrize("shape", [subwords.LANGUAGE, subwords.QUALITY])
def test_features_stay_in_their_document(shape):
    texts = ["", "a", "ab", "héllo wörld", "", "x y x y", "漢字 漢字"]
    together = [(np.sort(b[a[i] : a[i + 1]]).tolist()) for i in range(len(texts)) for b, a in [*subwords.features(pa.array(texts), shape)]]
    alone = [np.sort(b).tolist() for t in texts for b, _ in [*subwords.features(pa.array([t]), shape)]]
    assert together == alone


def test_sample_is_bounded_and_even(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('t', id) AS text")
    labels = docs.selectExpr("doc_id", "CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS label")
    shape = subwords.Shape(grams=(2,), words=False, fold=True, sample=200)
    texts, names = subwords.sampled(docs, labels, shape)
    assert len(texts) == 200 and sum(names) == 100
    assert (texts, names) == subwords.sampled(docs.repartition(9), labels, shape)
    # Repeated rows and long texts do not make the sample larger.
    many = docs.union(docs).union(docs.selectExpr("doc_id", "repeat(text, 50)"))
    assert subwords.sampled(many, labels.union(labels), shape) == (texts, names)
    few = subwords.Shape(grams=(2,), words=False, fold=True, sample=200, most=100, classes=1)
    texts, names = subwords.sampled(docs, labels, few)
    assert set(names) == {0} and 0 < sum(map(len, texts)) <= 100
