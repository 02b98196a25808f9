"""Recogniser results as they come over the wire: nested messages of numbered fields.

A message is a run of fields, each a key (number and kind, as a variable-length integer)
and a value: another such integer, four or eight bytes, or a length and so many bytes.  What
a field means is not in the message, so `LAYOUT` says it for those that are wanted; fields
it lacks are skipped, of whatever kind, and absent ones are null or empty.

A message is decoded where it is, batch by batch, into the columns that `adapters.lens_lines`
takes.  A null message, one that ends within a field or has an unknown kind gives null.
Messages of any length are read whole; of a field that may occur once the last counts.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from leafmark.sources import adapters

_WORD = {2: ("plain_text", "text"), 3: ("text_separator", "text")}
_BOX = {1: ("center_x", "float"), 2: ("center_y", "float"), 3: ("width", "float"), 4: ("height", "float"), 5: ("rotation_z", "float")}
_LINE = {1: ("words", [_WORD]), 2: ("geometry", {1: ("bounding_box", _BOX)})}
#: Numbers and names of the fields that lead to words and boxes.  A dict is a
#: message, a list a repeated one.
LAYOUT = {2: ("objects_response", {3: ("text", {1: ("text_layout", {1: ("paragraphs", [{2: ("lines", [_LINE])}])})})})}


class Malformed(ValueError):
    """The bytes are no message."""


def _integer(data: bytes, at: int, end: int) -> tuple[int, int]:
    value = shift = 0
    while at < end and shift < 70:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7
    raise Malformed


def decode(data: bytes, layout: dict, at: int = 0, end: int | None = None) -> dict:
    """The fields of a message that `layout` names."""
    end = len(data) if end is None else end
    found: dict = {name: [] for name, kind in layout.values() if isinstance(kind, list)}
    while at < end:
        key, at = _integer(data, at, end)
        number, kind = key >> 3, key & 7
        start = at
        if kind == 0:
            _, at = _integer(data, at, end)
        elif kind == 2:
            size, start = _integer(data, at, end)
            at = start + size
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
        else:
            raise Malformed
        if at > end:
            raise Malformed
        if number in layout:
            name, inner = layout[number]
            if isinstance(inner, (dict, list)) and kind == 2:
                if isinstance(inner, list):
                    found[name].append(decode(data, inner[0], start, at))
                else:
                    found[name] = _joined(found.get(name), decode(data, inner, start, at))
            elif inner == "text" and kind == 2:
                found[name] = data[start:at].decode(errors="replace")
            elif inner == "float" and kind == 5:
                found[name] = struct.unpack_from("<f", data, start)[0]
    return found


def _joined(old: dict | None, new: dict) -> dict:
    """A message that comes in several parts is one: later values count, lists go on."""
    if not old:
        return new
    both = dict(old)
    for name, value in new.items():
        both[name] = old.get(name, []) + value if isinstance(value, list) else _joined(old.get(name), value) if isinstance(value, dict) else value
    return both


def _result(message: bytes | None) -> dict | None:
    """A message as the struct `adapters.LENS`."""
    if message is None:
        return None
    try:
        layout = decode(message, LAYOUT).get("objects_response", {}).get("text", {}).get("text_layout", {})
    except Malformed:
        return None
    lines = lambda p: [{"words": line["words"], "box": line.get("geometry", {}).get("bounding_box")} for line in p["lines"]]
    return {"paragraphs": [{"lines": lines(p)} for p in layout.get("paragraphs", [])]}


def _integers(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `_integer` for many places: values, what comes after, and where there is one.
    Values that no number or length of a field can have are all the same large one."""
    value, after, open_ = np.zeros(len(at), np.int64), at.copy(), np.ones(len(at), bool)
    for shift in range(0, 70, 7):
        now = np.flatnonzero(open_ & (after < end))
        if not len(now):
            break
        byte = data[after[now]].astype(np.int64)
        after[now] += 1
        value[now] += (byte & 127) << shift if shift < 35 else np.where(byte & 127, 1 << 40, 0)
        open_[now] = byte >= 128
    return value, after, ~open_


class _Fields:
    """The fields of many messages, read in step: whose they are (`of`), the whole message
    they lie in (`root`), number, kind and bytes; in order.  Sets `bad` for roots that are
    no message."""

    def __init__(self, data: np.ndarray, of: np.ndarray, root: np.ndarray, at: np.ndarray, end: np.ndarray, bad: np.ndarray):
        found = [[np.zeros(0, np.int64)] for _ in range(6)]
        while True:
            more = (at < end) & ~bad[root]
            of, root, at, end = of[more], root[more], at[more], end[more]
            if not len(at):
                break
            key, start, sound = _integers(data, at, end)
            kind, stop = key & 7, start.copy()
            for k in (0, 2):
                some = np.flatnonzero(sound & (kind == k))
                value, after, ok = _integers(data, start[some], end[some])
                sound[some] = ok
                stop[some] = after + (value if k == 2 else 0)
                if k == 2:
                    start[some] = after
            stop += np.where(kind == 1, 8, np.where(kind == 5, 4, 0))
            sound &= ((kind <= 2) | (kind == 5)) & (stop <= end)
            bad[root[~sound]] = True
            of, root, start, end, at = of[sound], root[sound], start[sound], end[sound], stop[sound]
            for column, values in zip(found, (of, root, key[sound] >> 3, kind[sound], start, at), strict=True):
                column.append(values)
        columns = [np.concatenate(c) for c in found]
        order = np.lexsort((columns[4], columns[0]))
        self.of, self.root, self.number, self.kind, self.start, self.stop = (c[order] for c in columns)

    def of_kind(self, number: int, kind: int = 2) -> np.ndarray:
        return np.flatnonzero((self.number == number) & (self.kind == kind))


def _results(messages: pa.Array) -> pa.Array:
    """Messages as structs like `adapters.LENS`, each level of all of them at once; what
    holds for one is in `decode`."""
    messages = messages.cast(pa.large_binary())
    n, none = len(messages), messages.is_null().to_numpy(zero_copy_only=False)
    joined = b"".join(m.as_buffer().to_pybytes() if m.is_valid else b"" for m in messages)
    ends = np.cumsum(pc.fill_null(pc.binary_length(messages), 0).to_numpy().astype(np.int64))
    data, bad, each = np.frombuffer(joined, np.uint8), none.copy(), np.arange(n)
    level = _Fields(data, each, each, np.r_[0, ends[:-1]].astype(np.int64), ends, bad)

    def inside(f: _Fields, number: int, apart: bool) -> _Fields:
        """The fields inside a field; if it is a repeated one, each is `apart`."""
        at = f.of_kind(number)
        return _Fields(data, np.arange(len(at)) if apart else f.of[at], f.root[at], f.start[at], f.stop[at], bad)

    for number in (2, 3, 1):
        level = inside(level, number, False)
    paragraphs = level.of_kind(1)
    in_paragraph = inside(level, 1, True)
    lines = in_paragraph.of_kind(2)
    in_line = inside(in_paragraph, 2, True)
    words = in_line.of_kind(1)
    in_word, in_shape = inside(in_line, 1, True), inside(in_line, 2, False)
    boxed = in_shape.of_kind(1)
    in_box = inside(in_shape, 1, False)

    def texts(number: int) -> pa.Array:
        out: list[str | None] = [None] * len(words)
        at = in_word.of_kind(number)
        for i, a, b in zip(in_word.of[at].tolist(), in_word.start[at].tolist(), in_word.stop[at].tolist(), strict=True):
            out[i] = joined[a:b].decode(errors="replace")
        return pa.array(out, pa.string())

    def number(field: int) -> pa.Array:
        at = in_box.of_kind(field, 5)
        value, known = np.zeros(len(lines)), np.zeros(len(lines), bool)
        if len(at):
            value[in_box.of[at]] = data[in_box.start[at][:, None] + np.arange(4)].copy().view("<f4").ravel()
        known[in_box.of[at]] = True
        return pa.array(value, mask=~known)

    def listed(values: pa.Array, of: np.ndarray, many: int) -> pa.Array:
        offsets = np.r_[0, np.cumsum(np.bincount(of, minlength=many))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), values)

    has_box = np.zeros(len(lines), bool)
    has_box[in_shape.of[boxed]] = True
    box = pa.StructArray.from_arrays([number(i) for i in _BOX], names=[name for name, _ in _BOX.values()], mask=pa.array(~has_box))
    word = pa.StructArray.from_arrays([texts(i) for i in _WORD], names=[name for name, _ in _WORD.values()])
    line = pa.StructArray.from_arrays([listed(word, in_line.of[words], len(lines)), box], names=["words", "box"])
    paragraph = pa.StructArray.from_arrays([listed(line, in_paragraph.of[lines], len(paragraphs))], names=["lines"])
    return pa.StructArray.from_arrays([listed(paragraph, level.of[paragraphs], n)], names=["paragraphs"], mask=pa.array(bad))


def decoded(messages: DataFrame, column: str = "message") -> DataFrame:
    """`messages` with `result` (`adapters.LENS`) in place of the binary column."""
    kept = [f for f in messages.schema.fields if f.name != column]
    schema = StructType([*kept, StructField("result", _parse_datatype_string(adapters.LENS))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(schema["result"].dataType)
        for batch in batches:
            at = batch.schema.get_field_index(column)
            results = _results(batch.column(at)).cast(kind)
            others = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in others), results], names=[*(batch.schema.names[i] for i in others), "result"])

    return messages.select(*(f.name for f in kept), column).mapInArrow(run, schema)
