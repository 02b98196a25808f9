"""Grouped maps over sorted partitions: many small groups in one Python pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

_ROWS = 8192  # about so many rows go back at once
_KINDS = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}

#: Takes whole groups (rows in order, first rows of the groups and their end) and gives which
#: of them it has settled, with their rows of the result.
Quick = Callable[[pa.RecordBatch, np.ndarray], tuple[np.ndarray, pa.RecordBatch]]


def names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def _starts(batch: pa.RecordBatch, keys: list[str], before: pa.RecordBatch | None) -> np.ndarray:
    """The rows of a batch at which a group begins; nulls are a group."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = before is None
    for name in keys:
        own = batch.column(name)
        last = own.slice(0, 1) if before is None else before.column(name).slice(before.num_rows - 1)
        old = pa.concat_arrays([last, own.slice(0, batch.num_rows - 1)])
        differ = pc.or_(pc.fill_null(pc.not_equal(old, own), False), pc.xor(pc.is_null(old), pc.is_null(own)))
        new |= differ.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole groups, with where each group begins and the end."""
    held: list[pa.RecordBatch] = []
    at: list[int] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _starts(batch, keys, held[-1] if held else None)
        size = sum(b.num_rows for b in held)
        at += [size + int(s) for s in starts]
        if len(starts) and at[-1] > 0:
            cut = int(starts[-1])
            yield pa.concat_batches([*held, batch.slice(0, cut)]), np.array(at)
            held, at = [batch.slice(cut)], [0]
        else:
            held.append(batch)
    if held:
        yield pa.concat_batches(held), np.array([*at, sum(b.num_rows for b in held)])


def _values(column: pa.Array) -> list:
    plain = pa.types.is_integer(column.type) or pa.types.is_floating(column.type)
    return column.to_numpy().tolist() if plain and not column.null_count else column.to_pylist()


def dicts(batch: pa.RecordBatch) -> list[dict]:
    fields = batch.schema.names
    return [dict(zip(fields, values, strict=True)) for values in zip(*map(_values, batch.columns), strict=True)]


def near_pairs(starts: np.ndarray, over: Callable[[np.ndarray, np.ndarray], np.ndarray], done: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (the earlier first) of one group for which `over` holds, by their
    distance in it, so that only as many as there are rows are held at a time.  Groups that
    become `done` on the way give no more."""
    sizes = np.diff(starts)
    left = np.repeat(starts[1:], sizes) - np.arange(starts[-1])  # rows up to the group's end
    of = np.repeat(np.arange(len(sizes)), sizes)
    first = np.arange(starts[-1])
    for k in range(1, int(sizes.max(initial=0))):
        first = first[left[first] > k]
        if done is not None:
            first = first[~done[of[first]]]
        found = over(first, first + k)
        if found.any():
            yield first[found], first[found] + k


def by_group(frame: DataFrame, keys: list[str], run: Callable[[list[dict]], list[dict]], ddl: str, quick: Quick | None = None, links: Callable[[pa.RecordBatch, np.ndarray], list[list[int]]] | None = None, placed: bool = False) -> DataFrame:
    """`run` on the rows of each group, in order of line_idx; its rows make up the result.

    The groups of a partition stream through one `mapInArrow`, so a group costs no batch
    of its own, and a worker holds one batch, one group and some rows of the result at a time.
    `quick` settles what groups it can, many at once; `run` gets the others.  `links` gives
    for each row the line_idx of later ones, as `to`.  `placed`: the frame comes straight
    from another grouped map by the same keys that gives its rows by line_idx, so its groups
    lie together in order already.
    """
    kinds = pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in ddl.split(", "))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for batch, starts in whole_groups(batches, keys):
            if quick:
                settled, rows = quick(batch, starts)
                if rows.num_rows:
                    yield pa.RecordBatch.from_arrays([rows.column(n).cast(kinds.field(n).type) for n in kinds.names], schema=kinds)
                batch, starts = _without(batch, starts, settled)
            rows = dicts(batch)
            if links and rows:
                for r, to in zip(rows, links(batch, starts), strict=True):
                    r["to"] = to
            for a, b in pairwise(starts.tolist()):
                out += run(rows[a:b])
                if len(out) >= _ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema=kinds)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    dealt = frame if placed else frame.repartition(*keys).sortWithinPartitions(*keys, "line_idx")
    return dealt.mapInArrow(each, ddl)


def _without(batch: pa.RecordBatch, starts: np.ndarray, settled: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
    sizes = np.diff(starts)
    return batch.filter(pa.array(np.repeat(~settled, sizes))), np.r_[0, np.cumsum(sizes[~settled])]
