import hashlib
import random

import numpy as np
import pytest

from leafmark.llm import fingerprints
from leafmark.llm import textops as X


def test_with_neighbours(spark, docs, rows):
    found = {r.doc_id: r for r in fingerprints.with_neighbours(docs).collect()}
    order = sorted((r[0], r[1] or "") for r in rows)
    assert len(found) == len(order)
    for i, (d, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = found[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        own, changed, other = fingerprints.fingerprints([text, edited, following])
        assert (r.fingerprint, r.edited_fingerprint) == (own.tobytes().hex(), changed.tobytes().hex())
        assert r.near_edited == (own == changed).mean() and r.near_next == (own == other).mean()


def test_likeness_follows_edit_distance():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghij klmnop") for _ in range(4000))
    shares = []
    for edits in (0, 4, 20, 100, 4000):
        out = list(text)
        for _ in range(edits):
            at = rng.randrange(len(out))
            out[at : at + 1] = rng.choice([[], ["x"], [out[at], "y"]])
        a, b = fingerprints.fingerprints([text, "".join(out)])
        shares.append((a == b).mean())
    assert shares[0] == 1 and shares == sorted(shares, reverse=True) and shares[1] > 0.7 and shares[-1] < 0.1


def test_company_does_not_matter():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcé漢😀") for _ in range(n)) for n in (0, 1, 2, 9, 50, 700, 20_000, *range(30, 60))]
    whole = fingerprints.fingerprints(texts)
    for t, f in zip(texts, whole, strict=True):
        assert (fingerprints.fingerprints([t])[0] == f).all()
    assert not whole[0].any()


def test_edges(spark, none):
    assert fingerprints.with_neighbours(none).count() == 0
    frame = spark.createDataFrame([(1, "abcd"), (None, "x"), (2, None), (2, "zz")], "doc_id long, text string")
    found = sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.with_neighbours(frame).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert found == [(1, 4, sha("ab")), (2, 0, sha("")), (2, 2, sha("za"))]
    one = fingerprints.with_neighbours(frame.where("doc_id = 1")).first()
    assert one.edited_sha256 == sha("abab") and one.near_next == 1


def stepwise(text):
    """A fingerprint by the definition: one step of the walk after another."""
    rng = np.random.default_rng(fingerprints.SEED)
    bits = rng.integers(0, 2, (256, fingerprints.PERIOD), dtype=np.uint8)
    bits[:, -1] = 1
    points = np.array([ord(c) for c in text], np.uint32)
    seen, at, step = [], 0, 0
    while at < len(text):
        seen.append(at)
        kind = int(points[at]) * 2654435761 % (1 << 32) >> 24
        at += int(bits[kind, step % fingerprints.PERIOD])
        step += 1
    rng = np.random.default_rng(fingerprints.SEED + 1)
    out = []
    for _ in range(fingerprints.SLOTS):
        best, nxt, priority = 0, 0, rng.random()
        while True:
            nxt += int(rng.geometric(max(priority, 1e-15)))
            priority *= rng.random()
            if nxt < len(seen):
                best = nxt
            if nxt >= 1 << 40:
                break
        window = points[seen[best] : seen[best] + fingerprints.SEEN] if seen else points
        hasher = X.Hasher(points)
        out.append(int(hasher(np.array([seen[best]]), np.array([seen[best] + len(window)]))[0]) >> 56 if seen else 0)
    return out


def test_fingerprints_against_the_walk_step_by_step():
    rng = random.Random(4)
    for n in (0, 1, 2, 7, 30, 200, 900):
        text = "".join(rng.choice("abc de é漢") for _ in range(n))
        assert fingerprints.fingerprints([text])[0].tolist() == stepwise(text)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out) + 1)
        out[at : at + 1] = rng.choice([[], ["x"], ["y", "z"]])
    return "".join(out)


def test_edit_distance():
    rng = random.Random(5)
    for _ in range(400):
        a = "".join(rng.choice("abx") for _ in range(rng.randint(0, 12)))
        b = changed(rng, a, rng.randint(0, 6)) if rng.random() < 0.7 else "".join(rng.choice("abx") for _ in range(rng.randint(0, 12)))
        most, true = rng.randint(0, 9), plain_distance(a, b)
        assert fingerprints.edit_distance(a, b, most) == (true if true <= most else None)


def test_edit_distance_across_windows_and_bands():
    rng = random.Random(6)
    for n in range(60):
        a = "".join(rng.choice("abcd 漢😀") for _ in range(rng.randint(300, 900)))
        b = changed(rng, a, rng.randint(0, 120))
        if n % 3 == 0:
            cut = rng.randint(1, 200)
            b = b[cut:] + a[:cut]
        true = plain_distance(a, b)
        for most in (0, true - 1, true, true + 1, 64, 2 * true + 5, 900):
            assert most < 0 or fingerprints.edit_distance(a, b, most) == (true if true <= most else None)


def test_edit_distance_of_long_texts():
    rng = random.Random(7)
    text = "".join(rng.choices("abcdefghij klm", k=400_000))
    spots = sorted(rng.sample(range(1, 400_000), 60))
    pieces = [text[a:b] for a, b in zip([0, *spots], [*spots, len(text)], strict=True)]
    assert fingerprints.edit_distance(text, "Q".join(pieces), 80_000) == 60
    assert fingerprints.edit_distance(text, text[::-1], 2_000) is None


def test_repeated_ids_in_similar(spark):
    rng = random.Random(10)
    a, b = ("".join(rng.choice("abcdefg hij") for _ in range(500)) for _ in range(2))
    frame = spark.createDataFrame([(1, a), (1, b), (2, a[:490]), (3, "Q" + b), (4, a), (5, "other"), (5, "other")], "doc_id long, text string")
    found = {r.doc_id: r.group_id for r in fingerprints.similar(frame).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    classes = sorted((r.doc_id, r.class_id) for r in fingerprints.similar(frame).collect())
    assert classes == [(1, 1), (1, 1), (2, 2), (3, 3), (4, 1), (5, 5), (5, 5)]


@pytest.mark.parametrize("piece", [2048, 8])
def test_similar_against_all_pairs(spark, piece):
    """Families of edited copies, unlike texts with one opening, exact copies: the groups
    must be those of all pairs, but for pairs that share no band (under one in fifty)."""
    rng = random.Random(7)
    random_text = lambda n: "".join(rng.choice("abcdefg hij") for _ in range(n))
    texts, opening = [], random_text(200)
    for size in (300, 900):
        for base in (random_text(size) for _ in range(4)):
            texts += [changed(rng, base, rng.randint(0, size // 40)) for _ in range(15)]
    texts += [opening + random_text(600) for _ in range(20)] + [texts[0]] * 3 + ["", "", "a"]
    prints = fingerprints.fingerprints(texts)
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = 0
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] == prints[j]).mean() >= 0.7 and plain_distance(texts[i], texts[j]) <= 0.2 * max(len(texts[i]), len(texts[j])):
                a, b = sorted((root(i), root(j)))
                up[b] = a
                links += texts[i] != texts[j]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "a", 1, "x")], "doc_id long, text string, key long, digest string")
    found = {r.doc_id: r.group_id for r in fingerprints.similar(frame.repartition(5), piece=piece).collect()}
    together = sum(found[i] == found[j] for i in range(len(texts)) for j in range(i) if root(i) == root(j))
    assert links > 100 and together >= 0.95 * sum(root(i) == root(j) for i in range(len(texts)) for j in range(i))
    assert all(root(i) == root(found[i]) for i in found) and len(found) == len(texts)
    assert fingerprints.similar(frame.limit(0)).count() == 0


def test_edits_elsewhere_share_bands(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("abcdefg hij") for _ in range(400))) for i in range(30)]
    rows = [r for d, t in rows for r in ((2 * d, t), (2 * d + 1, t[:395] + "Q" + t[395:]))]
    found = fingerprints.with_neighbours(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all((r.bands_next >= 10) == (r.doc_id % 2 == 0) for r in found)


def test_very_long_text(spark):
    text = "lorem ipsum " * 150_000
    found = {r.doc_id: r for r in fingerprints.with_neighbours(spark.createDataFrame([(1, text), (2, text + "x")], "doc_id long, text string")).collect()}
    assert found[1].n_chars == len(text) and found[1].near_next > 0.9
