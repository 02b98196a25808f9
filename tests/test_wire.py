import random
import struct

import pytest

from leafmark.operators import chunks, layout
from leafmark.sources import adapters, wire


def integer(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, kind, payload):
    return integer(number << 3 | kind) + (integer(len(payload)) if kind == 2 else b"") + payload


def noise(rng):
    """A field that no layout knows, of each kind."""
    number = rng.choice([16, 77, 3000])
    kind = rng.choice([0, 1, 2, 5])
    return field(number, kind, {0: integer(rng.randrange(1 << 63)), 1: rng.randbytes(8), 2: rng.randbytes(rng.randint(0, 300)), 5: rng.randbytes(4)}[kind])


def message(rng, paragraphs):
    mixed = lambda parts: b"".join(p + (noise(rng) if rng.random() < 0.4 else b"") for p in parts)
    word = lambda w: mixed([field(2, 2, w["plain_text"].encode()), *([field(3, 2, w["text_separator"].encode())] if w["text_separator"] is not None else [])])
    box = lambda b: mixed([field(i, 5, struct.pack("<f", v)) for i, v in enumerate(b.values(), 1) if v is not None])
    line = lambda x: mixed([*(field(1, 2, word(w)) for w in x["words"]), *([field(2, 2, field(1, 2, box(x["box"])))] if x["box"] else [])])
    paragraph = lambda p: mixed(field(2, 2, line(x)) for x in p["lines"])
    return mixed([field(2, 2, mixed([field(3, 2, mixed([field(1, 2, mixed(field(1, 2, paragraph(p)) for p in paragraphs))]))]))])


def make(rng):
    number = lambda: rng.choice([None, 0.5, -0.25, 3.0])
    box = lambda: rng.choice([None, {"center_x": number(), "center_y": number(), "width": number(), "height": number(), "rotation_z": number() or 0.125}])
    words = lambda: [{"plain_text": rng.choice(["", "あ", "word", "x" * 200]), "text_separator": rng.choice([None, "SPACE", "NEWLINE", "-"])} for _ in range(rng.randint(0, 4))]
    return [{"lines": [{"words": words(), "box": box()} for _ in range(rng.randint(0, 3))]} for _ in range(rng.randint(0, 3))]


def test_random_messages_come_back_whole(spark):
    rng = random.Random(6)
    wanted = {i: make(rng) for i in range(200)}
    frame = spark.createDataFrame([(i, "k", bytearray(message(rng, p))) for i, p in wanted.items()], "page_id long, result_of string, message binary").repartition(3)
    found = {r.page_id: r.result.asDict(recursive=True)["paragraphs"] for r in wire.decoded(frame).collect()}
    assert found == wanted


def test_lines_of_messages_and_of_structs_agree(spark):
    rng = random.Random(7)
    pages = {i: make(rng) for i in range(60)}
    raw = spark.createDataFrame([(i, bytearray(message(rng, p))) for i, p in pages.items()], "page_id long, message binary")
    plain = spark.createDataFrame([(i, {"paragraphs": p}) for i, p in pages.items()], f"page_id long, result {adapters.LENS}")
    rows = lambda f: sorted(map(tuple, f.collect()))
    assert rows(adapters.lens_lines(wire.decoded(raw))) == rows(adapters.lens_lines(plain)) != []


def test_parts_of_a_message_are_joined():
    one = field(2, 2, field(3, 2, field(1, 2, field(1, 2, field(2, 2, field(1, 2, field(2, 2, b"a")))))))
    assert [p["lines"][0]["words"][0]["plain_text"] for p in wire._result(one + one)["paragraphs"]] == ["a", "a"]
    assert wire._result(b"") == {"paragraphs": []}


@pytest.mark.parametrize("bad", [b"\x12", b"\x12\x05ab", b"\x0b", b"\xff" * 12, b"\x0d\x00"])
def test_broken_messages_are_null(spark, bad):
    frame = spark.createDataFrame([(1, bytearray(bad)), (2, None)], "page_id long, message binary")
    assert [r.result for r in wire.decoded(frame).collect()] == [None, None]


def test_table_function_is_the_chunked_scan(spark):
    def lines_of(page_id, width, height, offset, size):
        """Two lines a slice; the lower one is also seen by the next slice."""
        rows = [(f"top {page_id} {offset}", 100, offset + 400), ("low", 300, offset + size - 100)]
        if offset:
            rows.append(("low", 300, offset + 250))
        return [(text, x / width, (y - offset) / size, 0.1, 40 / size, 0.0, 0.9) for text, x, y in rows]

    pages = spark.createDataFrame([(1, 1000, 9000), (2, 1000, 1200), (3, 800, 5200)], "page_id long, width int, height int")

    def by_rows(slices):
        rows = [(r.page_id, r.offset, n, *line) for r in slices.collect() for n, line in enumerate(lines_of(r.page_id, r.width, r.height, r.offset, r["size"]))]
        return spark.createDataFrame(rows, chunks.RESULT)

    chunks.register(spark, lines_of)
    rows = lambda f: sorted(tuple(r) for r in f.collect())
    found = rows(layout.chunked(pages, chunks.recogniser()))
    assert found == rows(layout.chunked(pages, by_rows))
    assert {r[0] for r in found} == {1, 2, 3} and len(found) > 8
    assert spark.sql("SELECT count(*) AS n FROM recognise_chunks(TABLE(SELECT 5L AS page_id, 10 AS width, 100 AS height, 0L AS offset, 100L AS size) PARTITION BY page_id)").first().n == 2


def test_many_messages_in_step(spark):
    """Messages read level by level are what each is on its own: parts, unknown fields, broken bytes, nulls."""
    import random

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    from leafmark.sources import adapters, wire

    rng = random.Random(3)
    size = lambda n: bytes([n]) if n < 128 else bytes([n % 128 + 128, n // 128])
    field = lambda number, value: bytes([8 * number + 2]) + size(len(value)) + value
    few = lambda make, most: b"".join(make() for _ in range(rng.randint(0, most)))
    word = lambda: field(1, few(lambda: rng.choice([field(2, "é漢".encode()), field(3, b"SPACE"), field(2, b"\xff"), b"\x28\x01"]), 3))
    box = lambda: field(1, few(lambda: bytes([8 * rng.randint(1, 6) + 5]) + rng.randbytes(2) + b"\x80\x3f", 6))
    line = lambda: field(2, few(lambda: rng.choice([word(), word(), field(2, few(box, 2)), field(15, b"?"), b"\x79" + bytes(8)]), 6))
    whole = lambda: few(lambda: field(2, few(lambda: field(3, few(lambda: field(1, few(lambda: field(1, few(line, 3)), 3)), 2)), 2)) + rng.choice([b"", b"\x48\x96\x01"]), 2)
    messages = [None, b"", b"\xff" * 11, b"\x12" + b"\xff" * 9 + b"\x01", b"\x13"]
    for _ in range(400):
        m = bytearray(whole())
        if m and rng.random() < 0.4:
            m[rng.randrange(len(m))] = rng.randrange(256)
        messages.append(bytes(m))
    kind = to_arrow_type(_parse_datatype_string(adapters.LENS))
    found, expected = wire._results(pa.array(messages, pa.binary())).cast(kind), pa.array([wire._result(m) for m in messages], kind)
    for m, one, other in zip(messages, found.to_pylist(), expected.to_pylist(), strict=True):
        assert str(one) == str(other), m
    assert 20 < found.null_count < 300
