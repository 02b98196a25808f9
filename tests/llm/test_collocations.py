import collections
import os
import random
import re
import uuid

import pytest

from leafmark.llm import collocations
from leafmark.llm.collocations import Sketch

SCHEMA = "doc_id long, lang string, text string, phrase string, n long, cell long"


def brute(rows, least, top):
    """{(lang, rank): (phrase, a, l, r, n, score)} by counting every phrase."""
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = {}
    for lang, c in counts.items():
        known = {p: a for p, a in c.items() if a >= least and len(p) > 1}
        scored = []
        for p, a in known.items():
            inside = any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in known.items())
            if not inside:
                score, k = min((1000 * a * total[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out[lang, rank] = (p.decode(), -a, left, right, total[lang], -score)
    return out


def make(seed, docs=300):
    rng = random.Random(seed)
    words = ["a", "B", "c", "the", "The", "é", "漢", "x-y", "\x00", "　", "long" * 10]
    fixed = ["new york city", "a b a b a b", "the c the c", "é 漢 é"]
    text = lambda: "".join(rng.choice([*words, *fixed]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ! "]) for _ in range(rng.randint(0, 40)))
    rows = [(rng.choice(["en", "de", "de", None, ""]), rng.choice([text(), text(), text(), None, "", " . "])) for _ in range(docs)]
    return rows + [("en", "copy of a line, copy of a line")] * 50


def run(spark, rows, **options):
    frame = spark.createDataFrame([(i if i % 7 else None, *r, "p", 1, 2) for i, r in enumerate(rows)], SCHEMA).repartition(5)
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(frame, **options).collect()}


@pytest.mark.parametrize("seed", range(2))
def test_against_counting(spark, seed):
    rows = make(seed)
    expected = brute(rows, 12, 40)
    assert len(expected) > 60
    assert run(spark, rows, least=12, top=40) == expected


def test_sketches_and_blocks_change_nothing(spark):
    rows = make(5)
    expected = brute(rows, 12, 40)
    assert run(spark, rows, least=12, top=40, sketch=Sketch(cells=5, bits=7)) == expected  # nearly all cells are shared
    assert run(spark, rows, least=12, top=40, block=300) == expected  # several automata


def test_large_products(spark):
    """Products beyond 64 bits stay exact."""
    from pyspark.sql import functions as F

    frame = spark.range(1).select(F.lit(9_000_000_000_000).alias("a"), F.lit(8_999_999_999_999).alias("n"), F.lit(7_000_000_000_003).alias("l"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    found = frame.withColumn("p", wide("a") * wide("n") * F.lit(1000)).withColumn("e", wide("l") * wide("l")).select(F.expr("p div e")).first()[0]
    assert found == 1000 * 9_000_000_000_000 * 8_999_999_999_999 // 7_000_000_000_003**2


def test_long_texts_and_empty_table(spark, none):
    assert collocations.collocations(none).count() == 0
    rows = [("en", "one two " * 60_000), ("en", "w" * 1_000_000), (None, "a b " * 10)]
    assert run(spark, rows, least=10, top=5) == brute(rows, 10, 5)


def test_reads_do_not_grow_with_the_phrases(spark, tmp_path):
    """The texts are read as often with many small automata as with one."""
    folder, schema = str(tmp_path), "lang string, text string"
    frame = spark.createDataFrame(make(5), schema).repartition(3)

    def reads(block):
        own = f"{folder}/{block}"
        os.mkdir(own)

        def told(batches):
            open(f"{own}/{uuid.uuid4().hex}", "w").close()
            yield from batches

        found = collocations.phrase_counts(frame.mapInArrow(told, schema), 12, block=block).collect()
        return len(os.listdir(own)), sorted(map(str, found))

    assert reads(300) == reads(4 << 20)


def test_words_of_neighbouring_texts_and_wide_spaces(spark):
    """Texts end without a break, spaces vary, and a phrase's words begin other phrases."""
    rows = [("en", x) for x in ["new york", "york new", "new  york\tnew york", " new york", "New \t York new", "new. york"] * 4]
    rows += [("de", "new york new york new york new")] * 3
    for block in (1, 1 << 19):
        assert run(spark, rows, least=3, top=20, block=block) == brute(rows, 3, 20)
