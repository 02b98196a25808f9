import random

import pyarrow as pa
import pytest

from leafmark.llm import toxicity

RNG = random.Random(4)
VOCABULARY = ["".join(RNG.choice("aeioulmnrst") for _ in range(RNG.randint(2, 8))) for _ in range(3000)]
TERMS = ["zongle", "vexbart", "quirx"]


def body(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def toxic(n):
    words = body(n).split()
    for _ in range(RNG.randint(1, 3)):
        words.insert(RNG.randrange(len(words)), RNG.choice([*TERMS, "grobb" + RNG.choice(["en", "ung", "ich", "al", "is"])]))
    return " ".join(words)


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, toxic(RNG.randint(5, 120)) if i % 4 == 0 else body(RNG.randint(5, 120)), "x") for i in range(1200)]
    rows += [(2000 + i, rows[0][1], "x") for i in range(200)]  # copies of one toxic document teach nothing new
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(4)
    labels = spark.createDataFrame([(r[0], 1 if r[0] % 4 == 0 or r[0] >= 2000 else 0) for r in rows], "doc_id long, label int")
    return docs, labels


@pytest.fixture(scope="module")
def lexicon(labelled):
    docs, labels = labelled
    return toxicity.train(docs, labels.where("doc_id % 5 <> 0 OR doc_id >= 2000"))


def test_held_out(labelled, lexicon):
    docs, labels = labelled
    assert set(lexicon.words) <= set(TERMS) and any(s.startswith("gro") for s in lexicon.stems)
    found = toxicity.score(docs, lexicon).join(labels, "doc_id").where("doc_id % 5 = 0 AND doc_id < 2000").collect()
    assert sum(r.predicted == r.label for r in found) / len(found) > 0.98


def test_misspelled_terms_and_quotes(spark, lexicon):
    rows = [(1, "you zongle " + body(10)), (2, "zonggle " + body(10)), (3, "zongl vexbrat vexbatr " + body(10)), (4, body(10)), (5, None), (6, ""), (7, f'"{body(3)} zongle {body(2)}" ' + body(6)), (8, "ZONGLE!! " + body(10)), (9, "x" * 300_000)]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), lexicon).collect()}
    assert [h.term for h in got[2].hits] == ["zongle"] and got[2].hits[0].kind == "fuzzy"
    assert {h.term for h in got[3].hits} >= {"zongle"}
    assert got[1].predicted == 1 and got[8].predicted == 1 and got[4].predicted == 0
    assert got[5].score == got[6].score < 0.5 and not got[5].hits and not got[9].hits
    assert got[7].hits[0].weight < got[8].hits[0].weight < got[1].hits[0].weight


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_finds_all_within_one_edit():
    rng = random.Random(6)
    terms = ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 8))) for _ in range(60)]
    trie = toxicity.Trie([], [], terms)
    for _ in range(600):
        word = list(rng.choice(terms))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(word))
            word[at : at + rng.randint(0, 1)] = [rng.choice("abcé") for _ in range(rng.randint(0, 1))]
        word = "".join(word)
        expected = {t for t in terms if distance(word, t) <= 1}
        assert set(trie.close(word)) == expected == set(trie.within_one(word))


def test_hits_word_by_word(spark, lexicon):
    """The terms found are those that a search of every word through every term finds."""
    rng = random.Random(3)
    letters = "abcdefgmnoéß漢"

    def odd():
        word = list(rng.choice([*lexicon.words, *lexicon.stems]) + rng.choice(["", "", "s", "ness" * 30, "漢字" * 60]))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            at = rng.randrange(len(word))
            word[at : at + rng.randint(0, 1)] = [rng.choice(letters) for _ in range(rng.randint(0, 1))]
        return "".join(word)

    def kind(word):
        if word in lexicon.words:
            return "word", word
        stem = max((s for s in lexicon.stems if word.startswith(s)), key=len, default=None)
        if stem:
            return "stem", stem
        close = [t for t in lexicon.fuzzy if len(t) >= toxicity.FUZZY_FROM and abs(len(word) - len(t)) < 2 and distance(word, t) <= 1]
        return ("fuzzy", min(close)) if close else None

    texts = [" ".join(odd() if rng.random() < 0.3 else rng.choice(VOCABULARY) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    texts += [" ".join(rng.choice(VOCABULARY) for _ in range(150_000)) + " zongle", "zongle" + "x" * 90, next(iter(lexicon.stems)) + "q" * 300]
    rows = [(i, t, "s", [1]) for i, t in enumerate(texts)] + [(0, texts[0], "s", [1]), (None, "zongle", "s", [1])]
    got = {r.doc_id: [(h.kind, h.term) for h in r.hits] for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, score string, hits array<int>"), lexicon).collect()}
    assert got == {i: [k for w in t.lower().split() if (k := kind(w))] for i, t in enumerate(texts)}
    assert got[len(texts) - 2] == [] and got[len(texts) - 1][0][0] == "stem"


def test_window_weights_are_learned():
    """Quoted terms of clean documents lose their weight; where quotes are as toxic, they keep it."""
    rng = random.Random(5)
    plain = lambda: f"{body(10)} {rng.choice(TERMS)} {body(10)}"
    quoted = lambda: f'{body(8)} "{body(2)} {rng.choice(TERMS)} {body(2)}" {body(8)}'
    texts = [plain() for _ in range(150)] + [quoted() for _ in range(20)] + [body(25) for _ in range(300)]
    shares = []
    for toxic_quotes in (0, 1):
        labels = [1] * 150 + [toxic_quotes] * 20 + [0] * 300
        lexicon = toxicity.learn(texts, labels, {0: labels.count(0), 1: labels.count(1)})
        shares.append(lexicon.windows["quoted"])
        assert lexicon.windows["reported"] == toxicity.WINDOWS["reported"]  # none seen
        many, found = toxicity.hits(pa.array([plain(), quoted()]), lexicon)
        p = toxicity._probability(lexicon, many, found)
        assert p[0] > 0.5 and (p[1] > 0.5) == bool(toxic_quotes)
    assert shares[0] < 0.3 < shares[1]


def test_recall_of_held_out_documents_with_a_term(spark):
    """Of the held-out toxic documents at the small scale that hold a term of the learned
    lexicon or one of its misspellings, nine in ten are caught, and no clean one."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    lexicon = toxicity.train(docs, labels.where("crc32(CAST(doc_id AS STRING)) % 5 <> 0").selectExpr("doc_id", "toxic AS label"))
    held = labels.where("crc32(CAST(doc_id AS STRING)) % 5 = 0")
    found = toxicity.score(docs, lexicon).join(held, "doc_id").collect()
    toxic = [r for r in found if r.toxic and r.hits]
    assert len(toxic) >= 4 and sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert not any(r.predicted for r in found if not r.toxic)


def test_without_labels(spark, labelled):
    docs, labels = labelled
    for only, expected in ((labels.limit(0), 0.5), (labels.where("label = 0"), 0.0)):
        found = toxicity.score(docs.limit(5), toxicity.train(docs, only)).collect()
        assert [r.score for r in found] == [expected] * 5


def test_rows_keep_their_columns(labelled, lexicon):
    docs, _ = labelled
    kept = toxicity.without_toxic(docs, lexicon)
    assert kept.columns == docs.columns
    rejected = {r.doc_id for r in toxicity.score(docs, lexicon).collect() if r.predicted}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - rejected and rejected
    assert toxicity.without_toxic(docs.limit(0), lexicon).count() == 0
    assert toxicity.without_toxic(docs, toxicity.learn([], [], {})).count() == docs.count()


def test_score_by_its_definition(spark, lexicon):
    """The score from the hits, term by term: of each term its best window counts once."""
    import math
    import re

    rng = random.Random(17)
    texts = ["", "nothing here", *(f"{body(rng.randint(0, 60))} " + " ".join(rng.choice([*TERMS, "you", "said", *list(lexicon.stems)]) for _ in range(rng.randint(0, 9))) + f" {body(rng.randint(0, 30))}" for _ in range(60))]
    texts = [t for t in texts if t.isascii()]
    found = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), lexicon).collect()}
    assert any(r.hits for r in found.values())
    for d, t in enumerate(texts):
        best, by_kind = {}, {"stem": 0.0, "other": 0.0}
        for h in found[d].hits:
            best[h.kind, h.term] = max(best.get((h.kind, h.term), 0), h.weight)
            by_kind["stem" if h.kind == "stem" else "other"] += h.weight
        table = {"word": lexicon.words, "stem": lexicon.stems, "fuzzy": lexicon.fuzzy}
        evidence = {k: sum(w * table[kind].get(term, 0) for (kind, term), w in best.items() if (kind == "stem") == (k == "stem")) for k in by_kind}
        many, total = len(re.findall("[0-9A-Za-z@]+", t)), sum(by_kind.values())
        row = [1, min(evidence["other"], 12) / 4, min(evidence["stem"], 12) / 4, math.log1p(total), math.log1p(many) / 8, math.log1p(by_kind["stem"] * 200 / max(many, 20)), float(total > 0)]
        z = sum(a * b for a, b in zip(row, lexicon.weights, strict=True))
        assert abs(found[d].score - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9 and found[d].predicted == (found[d].score >= 0.5)
