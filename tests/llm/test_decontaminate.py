import random

import numpy as np
import pyarrow as pa
import pytest

from leafmark.llm import decontaminate

RNG = random.Random(8)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(500)]
ITEMS = {i: " ".join(RNG.choice(WORDS) for _ in range(RNG.randint(12, 50))) for i in range(30)}


def filler(n):
    return " ".join(RNG.choice([*WORDS, "the", "the", "of"]) for _ in range(n))


def edited(text, every):
    words = text.split()
    return " ".join(RNG.choice(WORDS) if i % every == every - 1 else w for i, w in enumerate(words))


@pytest.fixture(scope="module")
def corpus(spark):
    rows, expected = [], set()
    for d in range(60):
        item = d % 30
        kind = d // 15
        if kind == 0:
            body = f"{filler(40)} {ITEMS[item].upper()}, {filler(900)}"
        elif kind == 1:
            body = f"{filler(300)}\n{edited(ITEMS[item], 6)} {filler(20)}"
        elif kind == 2:
            words = ITEMS[item].split()
            body = f"{filler(10)} {' '.join(words[: len(words) // 2])} new words here {' '.join(words[len(words) // 2 :])}"
        else:
            body = filler(500)
        rows.append((d, body, "tag"))
        if kind < 3:
            expected.add((d, item))
    rows += [(100 + k, f"{filler(30)} {ITEMS[29]} {filler(30)}", "tag") for k in range(120)]  # one item leaked to most
    expected |= {(100 + k, 29) for k in range(120)}
    rows += [(400, None, "tag"), (401, "", "tag"), (402, "the the the", "tag"), (None, ITEMS[1], "tag")]
    return spark.createDataFrame(rows, "doc_id long, text string, gram string").repartition(4), expected


def bench(spark):
    return spark.createDataFrame([*ITEMS.items(), (50, None), (51, "the of"), (52, "")], "item_id long, text string")


@pytest.mark.parametrize("block", [None, 200])
def test_leaks_are_found(spark, corpus, block):
    docs, expected = corpus
    found = decontaminate.contaminated(docs, bench(spark), block=block).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in found:
        assert 0.5 <= r.score <= 1
        if r.doc_id < 15:
            assert r.score == 1 and [w.strip(",").lower() for w in texts[r.doc_id].split()[r.start_word : r.end_word]] == ITEMS[r.item_id].split()


def test_heavy_edits_against_alignment_with_every_text(spark):
    """Copies with every third to sixth word replaced, among stock phrases: of the pairs
    that a full alignment scores 0.5 or more, nine in ten must come out, and no others."""
    rng = random.Random(12)
    stock = "what is the name of the one that was in the".split()
    items = {i: " ".join([*stock[: rng.randint(0, 8)], *(rng.choice(WORDS) for _ in range(rng.randint(5, 40)))]) for i in range(60)}
    rows = []
    for d in range(240):
        words = items[d % 60].split()
        every = 3 + d // 60
        copy = [rng.choice(WORDS) if k % every == every - 1 else w for k, w in enumerate(words)]
        if d % 7 == 0:
            copy = [w for w in copy if rng.random() > 0.1]
        rows.append((d, " ".join([*(rng.choice([*WORDS, *stock]) for _ in range(rng.randint(0, 60))), *copy, *(rng.choice([*WORDS, *stock]) for _ in range(60))])))
    rows += [(1000 + d, " ".join(rng.choice([*WORDS, *stock, "the", "of"]) for _ in range(200))) for d in range(100)]
    frames = [spark.createDataFrame(x, f"{i} long, text string") for x, i in ((rows, "doc_id"), (list(items.items()), "item_id"))]
    found = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(*frames).collect()}
    hashed = lambda texts: [w for w in (decontaminate.hashed_words(pa.array([t]))[0] for t in texts)]
    texts, wanted = hashed([t for _, t in rows]), hashed(items.values())
    full = {(d, i): decontaminate.align(item, text)[0] / (2 * len(item)) for (d, _), text in zip(rows, texts, strict=True) for i, item in zip(items, wanted, strict=True)}
    expected = {k for k, score in full.items() if score >= 0.5}
    assert set(found) <= expected and len(found) >= 0.9 * len(expected) and len(expected) >= 200
    assert sum(abs(score - full[k]) < 1e-9 for k, score in found.items()) >= 0.95 * len(found)


def put_in(words, every):
    return [x for k, w in enumerate(words) for x in ([w, f"new{k}"] if k % every == every - 1 else [w])]


@pytest.mark.parametrize("change", ["in1", "in2", "out2", "out3", "swap2"])
def test_words_put_in_left_out_or_replaced_throughout(spark, change):
    """Every copy whose alignment scores 0.5 or more: of these, nine in ten are found, and no clean text is."""
    rng = random.Random(21)
    items = {i: " ".join(f"{rng.choice(WORDS)}{rng.randint(0, 20)}" for _ in range(rng.randint(14, 45))) for i in range(40)}
    n = int(change[-1])
    copy = {
        "in": lambda w: put_in(w, n),
        "out": lambda w: [x for k, x in enumerate(w) if k % n != n - 1],
        "swap": lambda w: [f"other{k}" if k % n == n - 1 else x for k, x in enumerate(w)],
    }[change[:-1]]
    rows = [(d, f"{filler(40)} {' '.join(copy(t.split()))} {filler(40)}") for d, t in items.items()] + [(100 + d, filler(150)) for d in range(60)]
    frames = [spark.createDataFrame(x, f"{i} long, text string") for x, i in ((rows, "doc_id"), (list(items.items()), "item_id"))]
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(*frames).collect()}
    hashed = lambda t: decontaminate.hashed_words(pa.array([t]))[0]
    expected = {(d, d) for d, text in rows[:40] if decontaminate.align(hashed(items[d]), hashed(text))[0] >= len(items[d].split())}
    assert len(expected) == (40 if change[:-1] != "swap" else 0) or change == "out2"
    assert found <= expected and len(found) >= 0.9 * len(expected)


def test_blocks_change_nothing(spark, corpus):
    docs, _ = corpus
    rows = lambda block: sorted(map(tuple, decontaminate.contaminated(docs, bench(spark), block=block).collect()))
    assert rows(None) == rows(150)


def test_short_and_repeated_items(spark):
    items = [(1, "zorb quandle"), (2, "flimp"), (3, "a b c d e f g h i j k l"), (3, "m n o p q r s t u v w x"), (None, "zorb")]
    rows = [(10, "the zorb, quandle here"), (11, "zorb here quandle"), (12, "x Flimp y"), (13, "1 a b c d e f g h i j k l 2"), (13, "nothing"), (14, "m n o p q r s t u v w x")]
    frames = [spark.createDataFrame(x, f"{i} long, text string") for x, i in ((rows, "doc_id"), (items, "item_id"))]
    assert {(r.doc_id, r.item_id, r.score) for r in decontaminate.contaminated(*frames).collect()} == {(10, 1, 1.0), (12, 2, 1.0), (13, 3, 1.0), (14, 3, 1.0)}


def test_phrase_of_every_item_and_a_very_long_text(spark):
    """A stock phrase that all items share makes no pairs; a long text is searched whole."""
    items = [(i, f"which of the following is not {WORDS[i]} {WORDS[i + 1]} {WORDS[i + 2]} {WORDS[i + 3]} {WORDS[i + 5]}") for i in range(300)]
    rows = [(1, "which of the following is not " * 2000), (2, "filler text " * 200_000 + items[7][1])] + [(10 + k, "which of the following is not so") for k in range(50)]
    frames = [spark.createDataFrame(x, f"{i} long, text string") for x, i in ((rows, "doc_id"), (items, "item_id"))]
    found = decontaminate.contaminated(*frames).collect()
    assert {(r.doc_id, r.item_id) for r in found if r.score == 1} == {(2, 7)}


def test_empty(spark, corpus):
    docs, _ = corpus
    assert decontaminate.contaminated(docs, bench(spark).limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench(spark)).count() == 0


def plain(a, b):
    best, h = 0, np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best


@pytest.mark.parametrize("seed", range(20))
def test_alignment(seed):
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(0, 5, int(rng.integers(1, 25))).astype(np.uint64) for _ in range(2))
    assert decontaminate.align(a, b)[0] == plain(a, b)
