import collections
import random
import zlib

import numpy as np
import pytest

from leafmark.llm import packing


@pytest.fixture(scope="module")
def ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {d: [*t.encode(x, add_special_tokens=False).ids, 0] for d, x in texts.items()}


def check(found, ids, capacity):
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for d, x in ids.items():
        own = sorted(pieces[d], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
        assert sum(r.length for r in own) == len(x)
        assert all(r.length == capacity for r in own[1:]) and (len(own) == 1) == (len(x) <= capacity)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_round_trip(docs, ids, capacity):
    found = packing.pack(docs, capacity).collect()
    bins = check(found, ids, capacity)
    assert bins <= -(-sum(map(len, ids.values())) // capacity) * 1.05 + 1


def test_empty_and_repeated(spark, none):
    assert packing.pack(none).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "x"), (2, None)], "doc_id long, text string")
    found = packing.pack(twice, 8).collect()
    assert sorted((r.doc_id, r.length) for r in found) == [(1, 3), (1, 3), (2, 1)]
    assert len({(r.sequence_id, r.offset) for r in found}) == 3


def test_ids_are_those_of_the_vocabulary_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    parts = ["<|endoftext|>", "<|endoftext|", "|>", " ", "  ", "\n", "\t\n ", "a", " word", "é漢", "'ll", "12", "..", "\u3000", "\x00", "🙂"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "", "x" * 30_000, *("".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(500))]
    for text in texts:
        assert packing.encoder()(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_very_long_text(spark):
    text = "lorem ipsum <|endoftext|> dolor " * 40_000
    found = packing.pack(spark.createDataFrame([(1, text), (2, "a")], "doc_id long, text string")).collect()
    assert check(found, {1: [*packing.encoder()(text).tolist(), 0], 2: [64, 0]}, 2048) == -(-(len(packing.encoder()(text)) + 3) // 2048)


@pytest.mark.parametrize("run", [" ", "\t", "\n", "\r\n", "\u3000", " \n"])
def test_long_white_space(run):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    run *= (2_000_000 if run in " \t\n" else 300_000) // len(run)
    for text in (run, run + "word", "a <|endoftext|>" + run + "b.", run[:4999] + "x", run[:5001]):
        assert packing.encoder()(text).tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("run", ["x", ".", "7", "\u6f22", "\U0001f642", "ab ", "\x00"])
def test_other_long_runs(run):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = run * (300_000 // len(run))
    assert packing.encoder()(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_long_white_space_packs(spark):
    text = " " * 1_000_000 + "a" + "\n" * 1_000_000
    found = packing.pack(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    check(found, {1: [*packing.encoder()(text).tolist(), 0]}, 2048)


@pytest.mark.parametrize("seed", range(8))
def test_best_two_fit_packs_everything(seed):
    rng = random.Random(seed)
    counts = collections.Counter(rng.choice([rng.randint(1, 100), rng.randint(1, 20)]) for _ in range(3000))
    placed = collections.Counter()
    for times, used in packing.best_two_fit(counts, 100):
        assert times > 0 and sum(k * n for k, n in used.items()) <= 100
        for k, n in used.items():
            placed[k] += n * times
    assert placed == counts
    bins = sum(t for t, _ in packing.best_two_fit(counts, 100))
    assert bins <= -(-sum(k * n for k, n in counts.items()) // 100) + 3


def test_two_small_ones_replace_the_smallest():
    # Greedy: 60 + 30 leaves 10; 23 and 17 fill the 40 that 30 and the gap make.
    plan = packing.best_two_fit({60: 1, 30: 1, 23: 1, 17: 1}, 100)
    assert plan[0] == (1, {60: 1, 23: 1, 17: 1})
