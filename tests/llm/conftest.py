import random

import pytest

SCHEMA = "doc_id long, text string, lang string, tag long, row string, score double"


def make_docs():
    """A small corpus with copies, near copies, shared passages, nulls, empty and long texts."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefgé漢") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + rng.choice(".!?")
    text = lambda n: " ".join(sentence(rng.randint(4, 12)) for _ in range(n))
    base, passage = text(20), text(8)
    rows = [base, base, base.upper(), base.replace(".", " ."), passage + "\n" + text(5), text(6) + "\n" + passage, None, "", " \n\t", "one", "one two three four", "one two three four"]
    for _ in range(12):
        words = base.split()
        for _ in range(rng.randint(1, 8)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append(" ".join(words))
    rows += [text(rng.randint(1, 15)) for _ in range(20)]
    rows += [text(400), "ab " * 3000, "x" * 5000, passage * 3]
    return [(10 * i + 3, t, ["en", "de", None][i % 3], i, "r", 0.5) for i, t in enumerate(rows)]


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """`doc_id` and `text` among columns whose names the operators use themselves."""
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts(rows):
    return {r[0]: r[1] or "" for r in rows}
