import random

import pytest

from leafmark.llm import token_counts


@pytest.fixture(scope="module")
def plain():
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return lambda text: len(model.encode(text))


def test_against_the_library(docs, texts, plain):
    found = {r.doc_id: r for r in token_counts.count(docs, limit=100).collect()}
    assert {d: (r.n_bytes, r.n_tokens) for d, r in found.items()} == {d: (len(t.encode()), plain(t)) for d, t in texts.items()}
    assert all(r.over_limit == (r.n_tokens > 100) for r in found.values())


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(seed, plain):
    rng = random.Random(seed)
    parts = ["a", "b", "th", "the", "ing", " ", "  ", "\n", "\r\n", "\t", "▁", ".", ",", "'s", "(x", "--", "é", "é", "漢字", "🙂", "\x00", "　", "<0x41>", "</s>", "<unk>", "12", "ﬁ", "ß", "И", "A_b"]
    count = token_counts.counter()
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        assert count(text) == plain(text), repr(text)


def test_merging_needs_no_cuts(plain):
    """The heap alone, over whole texts, gives what the cut stretches add up to."""
    rng, count = random.Random(1), token_counts.counter()
    for _ in range(300):
        text = " ".join("".join(rng.choices("etaoinshr.,'", k=rng.randint(1, 9))) for _ in range(rng.randint(1, 30)))
        assert count.merged(count.model.normalize(text)) == plain(text)


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" * 200_000, "漢" * 100_000, "\x00" * 100_000, "ab, " * 300_000, "." * 100_000])
def test_long_runs(text, plain):
    assert token_counts.counter()(text) == plain(text)


def test_remembered_stretches_are_bounded(monkeypatch, plain):
    import public_tokenizers

    monkeypatch.setattr(token_counts, "KEPT", 50)
    count = token_counts.TokenCounter(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(2)
    for _ in range(50):
        text = " ".join("".join(rng.choices("abcdefg", k=5)) for _ in range(40))
        assert count(text) == plain(text)
        assert len(count.known) <= 50


def test_odd_rows(spark, none):
    assert token_counts.count(none).count() == 0
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "x"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in token_counts.count(rows, 1).collect()) == [(1, 3, 2, True), (1, 3, 2, True), (2, 0, 0, False), (3, 0, 0, False)]
