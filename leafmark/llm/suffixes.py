"""Exact removal of byte strings repeated across documents, by blockwise suffix sorting.

A byte goes if a `width`-byte string covering it also starts in a document with a
smaller doc_id.  A full suffix array of the corpus would ship every suffix, so the
suffixes are first dealt into buckets by content, and only buckets that two documents
share are sorted:

1. Every `width`-byte window has an anchor: its smallest hashed 16-byte gram (leftmost
   among equals).  Equal windows have equal anchors at equal offsets, so the anchor gram
   is a bucket key that loses no match; consecutive windows share anchors, so there is
   one anchor for about 18 bytes.
2. A task sorts its own anchors first: a gram that two of its documents have is shared,
   and only one row for it goes on, so a gram that a third of all documents have costs
   one row per task.  One shuffle by gram then finds those that other tasks have too.
3. For the rest, the stretch of bytes that holds an anchor's windows goes to its bucket
   (equal stretches in one piece of text once, for the first document that has them).
   One block of buckets is sorted at a time: suffixes by their first eight bytes, longer
   ties by precomputed ranks of a difference cover (residues 0, 1, 3, 9 modulo 13; the
   stretches are laid out so that their anchors have residue 0, and a suffix's two cover
   positions depend only on its residue), so a block never compares long strings and its
   memory is set by `BLOCK`.
4. A bucket that over `HOT` documents share, a few MB, is not gathered: its equal stretches
   become one with a map-side combine, the windows of that one rows of their own, by hash,
   and the smallest doc_id of each is joined back (joins that Spark may split).

Null and empty texts and those shorter than `width` lose nothing.  Rows that repeat a
doc_id are one document for the rule (they never remove from each other) and each get
their row.  Texts of any length are read whole.  Rows without a doc_id are left out.
Columns other than doc_id and text are ignored, whatever their names (`without_repeats`
keeps them).  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmark.llm import textops as X
from leafmark.llm.common import doc_texts, prepare, settle

GRAM = 16
SLICE = 1 << 20  # bytes of text that a numpy step works on: its arrays stay in cache
GATHER = 1_000_000  # anchors that a task sorts at once
BLOCK = 2 << 20  # bytes of a block of buckets
HOT = 50_000
LISTED = 0x7FFFFFFF  # bits of a gram that a document's list of shared grams keeps: a chance hit costs a stretch, not a result
#: The perfect difference cover modulo 13.
MODULUS, COVER = 13, (0, 1, 3, 9)
RANKED = 32  # bytes that a cover rank stands for

U = X.U


def anchors(data: np.ndarray, offsets: np.ndarray, width: int):
    """Runs of windows with one anchor: first window, number of windows, anchor, key (48
    bits of the gram's hash), document."""
    n, span = len(data), width - GRAM + 1
    if n < width:
        e = np.zeros(0, np.int64)
        return e, e, e, e.astype(U), e
    hasher = X.Hasher(data)
    gram = X.mix((hasher.sums[GRAM:] - hasher.sums[:-GRAM]) * hasher.back[: n - GRAM + 1])
    bits = U(max(1, int(n).bit_length()))
    low = ((gram >> bits) << bits) | np.arange(len(gram), dtype=U)
    reach = 1
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < span:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    at = (low & ((U(1) << bits) - U(1))).astype(np.int64)
    step = np.zeros(n + 1, np.int32)  # windows must end inside their document
    size = np.diff(offsets)
    some = size >= width
    np.add.at(step, offsets[:-1][some], 1)
    np.add.at(step, offsets[1:][some] - width + 1, -1)
    valid = np.cumsum(step)[: len(at)] > 0
    fresh, last = np.ones(len(at), bool), np.ones(len(at), bool)
    moved = (at[1:] != at[:-1]) | ~valid[:-1] | ~valid[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(at))]
    fresh[1:], last[:-1] = moved, moved
    fresh[edges], last[edges - 1] = True, True
    starts, ends = np.flatnonzero(valid & fresh), np.flatnonzero(valid & last)
    return starts, ends - starts + 1, at[starts], gram[at[starts]] >> U(16), X.owner(offsets, starts)


def _anchor_rows(width: int):
    """Distinct (key, document) rows; `open` ones may be shared with other tasks only."""

    def chunk(keys: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
        key, ids = np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(key)
        key, ids = key[order], ids[order]
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        group = np.repeat(np.arange(len(cuts)), np.diff(np.r_[cuts, len(key)]))
        lo, hi = np.minimum.reduceat(ids, cuts), np.maximum.reduceat(ids, cuts)
        inside = np.flatnonzero((lo < hi)[group])  # shared here already: every document's row
        pairs = np.lexsort((ids[inside], key[inside]))
        inside = inside[pairs]
        fresh = np.ones(len(inside), bool)
        fresh[1:] = (key[inside][1:] != key[inside][:-1]) | (ids[inside][1:] != ids[inside][:-1])
        inside = inside[fresh]
        return pa.RecordBatch.from_arrays(
            [X.longs(np.r_[key[cuts], key[inside]]), pa.array(np.r_[lo, ids[inside]]), pa.array(np.r_[np.where(lo < hi, 2, 1), np.zeros(len(inside), np.int64)].astype(np.int32))],
            names=["key", "doc_id", "open"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, held = [], [], 0
        for piece in X.pieces(batches, SLICE):
            _, _, _, key, doc = anchors(*X.texts(piece.column(1)), width)
            keys.append(key)
            ids.append(piece.column(0).to_numpy()[doc])
            held += len(key)
            if held >= GATHER:
                yield chunk(keys, ids)
                keys, ids, held = [], [], 0
        if held:
            yield chunk(keys, ids)

    return run


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key: those found shared already, and the open rows of every key
    that has two documents (an `open` of 2 stands for two documents by itself)."""
    held: list[pa.RecordBatch] = []

    def shared(whole: pa.Table) -> pa.RecordBatch:
        key, ids, state = (whole.column(i).to_numpy() for i in range(3))
        done = state == 0
        at = np.flatnonzero(~done)
        k, i, st = key[at], ids[at], state[at]
        keep = at[:0]
        if len(at):
            cuts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            group = np.repeat(np.arange(len(cuts)), np.diff(np.r_[cuts, len(k)]))
            two = (np.minimum.reduceat(i, cuts) < np.maximum.reduceat(i, cuts)) | (np.maximum.reduceat(st, cuts) == 2)
            keep = at[two[group] & (st == 1)]
        rows = np.r_[np.flatnonzero(done), keep]
        return pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(ids[rows])], names=["key", "doc_id"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        at = int(np.searchsorted(key, key[-1]))  # the last key may go on
        if at:
            yield shared(pa.Table.from_batches([*held, batch.slice(0, at)]))
            held = [batch.slice(at)]
        else:
            held.append(batch)
    if held:
        yield shared(pa.Table.from_batches(held))
    X.tidy()


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tag, packed): the texts as they travel to their lists of grams."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        packed = [pack(t.encode()) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary())], names=["doc_id", "tag", "packed"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, tag, packed, keys) with the text's bytes, a few at a time."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        held, start, size = [], 0, 0
        for i, packed in enumerate(batch.column(2).to_pylist()):
            held.append(unpack(packed))
            size += len(held[-1])
            if size >= SLICE or i == batch.num_rows - 1:
                part = batch.slice(start, len(held))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(held, pa.binary()), part.column(3)], names=["doc_id", "tag", "text", "keys"])
                held, start, size = [], i + 1, 0


_STRETCH = ["key", "doc_id", "tag", "starts", "lead", "bytes"]


def _stretches(width: int):
    """Of each text, the stretches of bytes whose anchor is among its shared keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _unpacked(batches):
            data, offsets = X.texts(piece.column(2))
            start, many, anchor, key, doc = anchors(data, offsets, width)
            lists = piece.column(3)
            values = lists.flatten().to_numpy().astype(U)
            holder = np.repeat(np.arange(piece.num_rows), np.diff(lists.offsets.to_numpy()))
            wanted = np.sort(X.mix(values + X.mix(holder.astype(U))))
            mark = X.mix((key & U(LISTED)) + X.mix(doc.astype(U)))
            place = np.searchsorted(wanted, mark)
            place[place == len(wanted)] = 0
            keep = np.flatnonzero(wanted[place] == mark) if len(wanted) else np.zeros(0, np.int64)
            start, many, anchor, key, doc = start[keep], many[keep], anchor[keep], key[keep], doc[keep]
            length, anchor = many + width - 1, anchor - start
            # Equal stretches of one document are one row with all their places.
            content = X.mix(X.Hasher(data)(start, start + length) + anchor.astype(U) * U(X.BASE))
            order = np.lexsort((start, content, key, doc))
            start, length, anchor, key, doc, content = (x[order] for x in (start, length, anchor, key, doc, content))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (content[1:] != content[:-1]) | (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (length[1:] != length[:-1])
            # Of equal stretches here, those of later documents go whole whatever the bucket
            # holds, so only the first document's goes on: a passage of very many documents
            # costs one stretch for each piece of text.
            ids, first = piece.column(0).to_numpy(), np.flatnonzero(fresh)
            of = np.cumsum(fresh) - 1
            row = np.lexsort((ids[doc[first]], content[first], key[first]))
            k, c, n, i = (x[first][row] for x in (key, content, length, ids[doc]))
            head = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (n[1:] != n[:-1])] if len(row) else np.zeros(0, bool)
            later = np.zeros(len(first), bool)
            later[row] = i > i[np.flatnonzero(head)][np.cumsum(head) - 1] if len(row) else False
            gone, on = later[of], ~later[of]
            if gone.any():
                yield _whole_spans(piece, doc[gone], start[gone] - offsets[doc[gone]], length[gone])
            start, length, anchor, key, doc, fresh = (x[on] for x in (start, length, anchor, key, doc, fresh))
            places, first = (start - offsets[doc]).astype(np.int64), np.flatnonzero(fresh)
            place_at = np.r_[first, len(start)].astype(np.int32)
            start, length, anchor, key, doc = (x[first] for x in (start, length, anchor, key, doc))
            to = np.zeros(len(first) + 1, np.int64)
            np.cumsum(length, out=to[1:])
            own = np.repeat(start - to[:-1], length) + np.arange(to[-1])
            yield pa.RecordBatch.from_arrays(
                [
                    X.longs(key),
                    pa.array(ids[doc]),
                    pa.array(piece.column(1).to_numpy()[doc]),
                    pa.ListArray.from_arrays(pa.array(place_at), pa.array(places)),
                    pa.array(anchor.astype(np.int32)),
                    pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(data[own])]),
                ],
                names=_STRETCH,
            )

    return run


def _whole_spans(piece: pa.RecordBatch, doc: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    """Rows of spans that go already, among those of stretches: `lead` is -1 and `starts`
    has start, end, start, end and so on of the joined spans of a document."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + length)[order]
    other = np.r_[True, doc[1:] != doc[:-1]]
    far = np.cumsum(other) * (int(end.max()) + 1)  # no span reaches into the next document's
    reach = np.maximum.accumulate(end + far) - far
    opens = np.flatnonzero(np.r_[True, other[1:] | (start[1:] > reach[:-1])])
    doc, spans = doc[opens], np.stack([start[opens], reach[np.r_[opens[1:], len(order)] - 1]], axis=1)
    cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    doc, n = doc[cuts], len(cuts)
    at = (2 * np.r_[cuts, len(opens)]).astype(np.int32)
    ids = piece.column(0).to_numpy()[doc]
    nothing = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.zeros(n + 1, np.int32)), pa.py_buffer(b"")])
    return pa.RecordBatch.from_arrays(
        [
            X.longs(X.mix(ids.astype(U)) >> U(16)), pa.array(ids), pa.array(piece.column(1).to_numpy()[doc]),
            pa.ListArray.from_arrays(pa.array(at), pa.array(spans.reshape(-1).astype(np.int64))), pa.array(np.full(n, -1, np.int32)), nothing,
        ],
        names=_STRETCH,
    )


def _load8(data: np.ndarray) -> np.ndarray:
    """The big-endian number of the eight bytes at each position, as a view."""
    return np.ndarray((max(0, len(data) - 7),), ">u8", buffer=data, strides=(1,))


def _ranks(keys: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of rows compared by keys[0], then keys[1], and so on."""
    order = np.lexsort(keys[::-1])
    differs = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        differs[1:] |= k[1:] != k[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(differs)
    return rank


def window_classes(data: np.ndarray, at: np.ndarray, lead: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix-sort the windows of some stretches: for each window, in order, its stretch
    and the rank of its `width` bytes among all windows of the block."""
    # Lay the stretches out so that every anchor's position is 0 modulo MODULUS.
    size = np.diff(at)
    room = size + 2 * MODULUS
    put = np.zeros(len(size) + 1, np.int64)
    np.cumsum(room, out=put[1:])
    put = put[:-1] + (-(put[:-1] + lead)) % MODULUS
    total = int(put[-1] + size[-1]) + RANKED + 8
    block = np.zeros(total, np.uint8)
    inside = np.arange(at[-1] - at[0]) - np.repeat(at[:-1] - at[0], size)
    block[np.repeat(put, size) + inside] = data[at[0] : at[-1]]
    eight = _load8(block)
    # Ranks of the cover positions whose ranked bytes lie in their stretch.
    usable = np.zeros(total + 1, np.int32)
    np.add.at(usable, put, 1)
    np.add.at(usable, put + size - RANKED + 1, -1)
    in_cover = np.isin(np.arange(MODULUS), COVER)
    sample = np.flatnonzero((np.cumsum(usable)[:total] > 0) & np.resize(in_cover, total))
    rank = np.zeros(total, np.int64)
    rank[sample] = _ranks([eight[sample + 8 * k].astype(U) for k in range(RANKED // 8)])
    windows = size - width + 1
    stretch = np.repeat(np.arange(len(size)), windows)
    first = np.zeros(len(size), np.int64)
    np.cumsum(windows[:-1], out=first[1:])
    pos = np.repeat(put - first, windows) + np.arange(len(stretch))
    ahead = np.array([next(d for d in range(MODULUS) if in_cover[(r + d) % MODULUS]) for r in range(MODULUS)])
    behind = np.array([next(d for d in range(MODULUS) if in_cover[(r - d) % MODULUS]) for r in range(MODULUS)])
    head = pos + ahead[pos % MODULUS]
    tail = pos + width - RANKED
    tail = tail - behind[tail % MODULUS]
    keys = [eight[pos].astype(U), rank[head].astype(U), rank[tail].astype(U), eight[pos + width - 8].astype(U)]
    return stretch, _ranks(keys)


def _block_spans(key, ids, tags, places, place_at, lead, data, at, width):
    """Spans to remove in one block of whole buckets: doc_id, tag, start, end."""
    size = np.diff(at)
    hasher = X.Hasher(data)
    a = hasher(at[:-1], at[1:])
    b = X.mix(a ^ X.mix(hasher.raw(at[:-1], at[:-1] + 25) + key.view(U)) ^ lead.astype(U))
    order = np.lexsort((ids, b, a))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(fresh) - 1
    one = order[fresh]  # of equal stretches, the one in the first document stands for all
    lengths = size[one]
    to = np.zeros(len(one) + 1, np.int64)
    np.cumsum(lengths, out=to[1:])
    own = np.repeat(at[:-1][one] - to[:-1], lengths) + np.arange(to[-1])
    stretch, rank = window_classes(data[own], to, lead[one], width)
    least = np.full(int(rank.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, rank, ids[one][stretch])
    gone = least[rank] < ids[one][stretch]
    # Runs of removed windows of each first stretch.
    begin, end = gone.copy(), gone.copy()
    same = stretch[1:] == stretch[:-1]
    begin[1:] &= ~(gone[:-1] & same)
    end[:-1] &= ~(gone[1:] & same)
    begin, end = np.flatnonzero(begin), np.flatnonzero(end)
    base = np.zeros(len(one) + 1, np.int64)
    np.cumsum(lengths - width + 1, out=base[1:])
    of = stretch[begin]
    lo, hi = begin - base[of], end - base[of] + width
    # A stretch whose windows all start in documents before its own goes whole.
    latest = np.maximum.reduceat(least[rank], base[:-1])
    later = ids > latest[kind]
    mine = np.flatnonzero(~later)
    reps = np.bincount(of, minlength=len(one))[kind[mine]]
    run_at = np.zeros(len(one) + 1, np.int64)
    np.cumsum(np.bincount(of, minlength=len(one)), out=run_at[1:])
    row = np.repeat(mine, reps)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(reps) - reps, reps)
    run = run_at[kind[row]] + offset
    rows = np.r_[np.flatnonzero(later), row]
    lo, hi = np.r_[np.zeros(int(later.sum()), np.int64), lo[run]], np.r_[size[later], hi[run]]
    # At every place of the stretch; then spans that touch are joined.
    reps = np.diff(place_at)[rows]
    nth = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
    place = places[np.repeat(place_at[rows], reps) + nth]
    s, e, rows = place + np.repeat(lo, reps), place + np.repeat(hi, reps), np.repeat(rows, reps)
    order = np.lexsort((s, tags[rows], ids[rows]))
    s, e, rows = s[order], e[order], rows[order]
    other = np.r_[True, (ids[rows][1:] != ids[rows][:-1]) | (tags[rows][1:] != tags[rows][:-1])] if len(rows) else np.zeros(0, bool)
    far = np.cumsum(other) * (int(e.max(initial=0)) + 1)  # no span reaches into the next document's
    reach = np.maximum.accumulate(e + far) - far
    opens = np.flatnonzero(np.r_[True, other[1:] | (s[1:] > reach[:-1])]) if len(rows) else np.zeros(0, np.int64)
    s, e, rows = s[opens], reach[np.r_[opens[1:], len(rows)] - 1] if len(rows) else e, rows[opens]
    return pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(tags[rows]), pa.array(s), pa.array(e)], names=["doc_id", "tag", "start", "end"])


def _sort_blocks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_bytes = [], 0

        def block():
            whole = pa.Table.from_batches(held)
            done = whole.filter(pc.less(whole.column(4), 0)).combine_chunks()
            if done.num_rows:
                spans = done.column(3).combine_chunks()
                many = np.diff(spans.offsets.to_numpy()) // 2
                start, end = spans.flatten().to_numpy().reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(done.column(i).to_numpy(), many)) for i in (1, 2)), pa.array(start), pa.array(end)], names=["doc_id", "tag", "start", "end"])
            whole = whole.filter(pc.greater_equal(whole.column(4), 0)).combine_chunks()
            if not whole.num_rows:
                return
            c = [whole.column(i).chunk(0) for i in range(6)]
            data, at = X.texts(c[5])
            places, place_at = c[3].flatten().to_numpy(), c[3].offsets.to_numpy().astype(np.int64)
            key, ids, tags, lead = (c[i].to_numpy() for i in (0, 1, 2, 4))
            yield _block_spans(key, ids, tags, places, place_at - place_at[0], lead, data, at, width)

        for batch in batches:
            key = batch.column(0).to_numpy()
            at = 0
            if held and held_bytes >= BLOCK:
                last = held[-1].column(0)[-1].as_py()
                at = int(np.searchsorted(key, last, "right"))
                if at:
                    held.append(batch.slice(0, at))
                if at < len(key):
                    yield from block()
                    held, held_bytes = [], 0
            if at < len(key):
                held.append(batch.slice(at))
                held_bytes += X.texts(held[-1].column(5))[1][-1]
        if held:
            yield from block()
        X.tidy()

    return run


def _windows(width: int):
    """A row for each window of the stretches (c1, c2, bytes, first): two hashes of it, the
    first document with the stretch, the stretch and the window's place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in X.pieces(batches, 1 << 18, "bytes"):
            data, at = X.texts(piece.column(2))
            many = np.diff(at) - width + 1
            row = np.repeat(np.arange(len(many)), many)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            pos = at[:-1][row] + nth
            hasher = X.Hasher(data)
            w1 = hasher(pos, pos + width)
            w2 = X.mix(hasher.raw(pos, pos + width // 2) ^ X.mix(w1))
            columns = [X.longs(w1), X.longs(w2), *(pa.array(piece.column(c).to_numpy()[row]) for c in (3, 0, 1)), pa.array(nth)]
            yield pa.RecordBatch.from_arrays(columns, names=["w1", "w2", "first", "c1", "c2", "at"])

    return run


def _hot_spans(each: DataFrame, width: int) -> DataFrame:
    """The spans to remove in buckets that are not gathered: equal stretches become one
    with a map-side combine, then its windows rows of their own, by hash."""
    code = lambda seed: F.xxhash64(F.lit(seed), "lead", "bytes")
    each = settle(each.withColumns({"c1": code(1), "c2": code(2)}))
    pair = F.col("pair")
    done = each.where("lead < 0").select("doc_id", "tag", "starts", F.explode(F.sequence(F.lit(0), F.size("starts") - 1, F.lit(2))).alias("pair"))
    done = done.select("doc_id", "tag", F.get("starts", pair).alias("start"), F.get("starts", pair + 1).alias("end"))
    each = each.where("lead >= 0")
    contents = settle(each.groupBy("c1", "c2").agg(F.first("bytes").alias("bytes"), F.min("doc_id").alias("first")))
    windows = settle(contents.mapInArrow(_windows(width), "w1 long, w2 long, first long, c1 long, c2 long, at long"))
    least = windows.groupBy("w1", "w2").agg(F.min("first").alias("least"))
    gone = windows.join(least, ["w1", "w2"]).where("least < first").groupBy("c1", "c2").agg(F.collect_list("at").alias("gone"))
    known = contents.select("c1", "c2", "first", F.length("bytes").alias("size")).join(gone, ["c1", "c2"], "left")
    rows = each.select("doc_id", "tag", "c1", "c2", F.explode("starts").alias("start")).join(known, ["c1", "c2"])
    whole = rows.where("doc_id > first").select("doc_id", "tag", "start", (F.col("start") + F.col("size")).alias("end"))
    part = rows.where("doc_id = first").select("doc_id", "tag", "start", F.explode("gone").alias("at")).withColumn("start", F.col("start") + F.col("at"))
    return done.union(whole).union(part.select("doc_id", "tag", "start", (F.col("start") + width).alias("end")))


def tagged(docs: DataFrame) -> DataFrame:
    """(doc_id, text, tag): the tag tells rows of one doc_id with different texts apart."""
    return doc_texts(docs).withColumn("tag", F.xxhash64("text"))


def repeated_spans(docs: DataFrame, width: int = 50, hot: int | None = None) -> DataFrame:
    """(doc_id, tag, start, end): byte spans to remove; those of one text may overlap."""
    if width < 49:  # a window holds its two ranked stretches and some grams
        raise ValueError("width must be at least 49 bytes")
    prepare(docs.sparkSession)
    hot = HOT if hot is None else hot
    rows = tagged(docs)
    found = rows.select("doc_id", "text").mapInArrow(_anchor_rows(width), "key long, doc_id long, open int")
    # Rows that are shared already need no meeting, so they are spread by document too.
    met = found.repartition("key", F.when(F.col("open") == 0, F.col("doc_id"))).sortWithinPartitions("key")
    held = met.mapInArrow(_shared_rows, "key long, doc_id long")
    lists = settle(held.groupBy("doc_id").agg(F.collect_set(F.col("key").bitwiseAND(LISTED).cast("int")).alias("keys")))
    hot_keys = settle(lists.select(F.explode("keys").alias("key")).groupBy("key").count().where(F.col("count") > hot).select("key"))
    has_hot = not hot_keys.isEmpty()
    if has_hot:
        each = lists.select("doc_id", F.explode("keys").alias("key")).join(hot_keys.withColumn("hot", F.lit(True)), "key", "left")
        lists = settle(
            each.groupBy("doc_id").agg(
                F.collect_list(F.when(F.col("hot").isNull(), F.col("key"))).alias("keys"), F.collect_list(F.when(F.col("hot"), F.col("key"))).alias("hot_keys")
            )
        )
    layout = "key long, doc_id long, tag long, starts array<long>, lead int, bytes binary"

    def stretches(column: str) -> DataFrame:
        packed = rows.mapInArrow(_compressed, "doc_id long, tag long, packed binary")
        with_keys = packed.join(lists.where(F.size(column) > 0).hint("merge"), "doc_id")
        return with_keys.select("doc_id", "tag", "packed", column).mapInArrow(_stretches(width), layout)

    spans = (
        stretches("keys").repartition("key").sortWithinPartitions("key").mapInArrow(_sort_blocks(width), "doc_id long, tag long, start long, end long")
    )
    if has_hot:
        spans = spans.unionByName(_hot_spans(stretches("hot_keys"), width))
    return settle(spans)


def _kept(raw: bytes, starts: list[int] | None, ends: list[int] | None) -> tuple[bytes, int, int]:
    """The bytes outside the spans, how many go, and the number of maximal runs of them."""
    if not starts:
        return raw, 0, 0
    s, e = np.array(starts), np.array(ends)
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    opens = np.r_[True, s[1:] > e[:-1]]
    kept, removed, at = [], 0, 0
    for a, b in zip(s[opens].tolist(), e[np.r_[opens[1:], True]].tolist(), strict=True):
        kept.append(raw[at:a])
        removed, at = removed + b - a, b
    kept.append(raw[at:])
    return b"".join(kept), removed, int(opens.sum())


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in X.pieces(batches):
        texts, starts, ends = (batch.column(i).to_pylist() for i in (2, 3, 4))
        out = []
        for text, s, e in zip(texts, starts, ends, strict=True):
            raw = text.encode()
            kept, removed, spans = _kept(raw, s, e)
            out.append((len(raw), removed, spans, kept))
        n, removed, spans, kept = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(n, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(spans, pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                pa.array(kept, pa.binary()),
            ],
            names=["doc_id", "tag", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def _lists(docs: DataFrame, width: int, hot: int | None) -> DataFrame:
    spans = repeated_spans(docs, width, hot).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return spans.select("doc_id", "tag", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))


def remove_repeats(docs: DataFrame, width: int = 50, hot: int | None = None) -> DataFrame:
    """(doc_id, tag, n_bytes, n_removed, n_spans, kept_sha256, kept) of every document;
    `kept` has the remaining bytes (a cut may fall inside a character)."""
    lists = _lists(docs, width, hot)
    each = tagged(docs).join(lists, ["doc_id", "tag"], "left").select("doc_id", "tag", "text", "starts", "ends")
    return each.mapInArrow(
        _cut, "doc_id long, tag long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )


def _cut_rows(names: list[str]):
    """Of batches (row, starts, ends): the rows with `text` cut and `n_chars` counted."""
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            texts = pa.RecordBatch.from_arrays([columns[at], batch.column(1), batch.column(2)], names=["text", "starts", "ends"])
            cut: list[str] = []
            for piece in X.pieces([texts]):
                for text, s, e in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    cut.append(_kept((text or "").encode(), s, e)[0].decode(errors="ignore"))
            columns[at] = pa.array(cut, pa.string())
            if "n_chars" in names:
                n = names.index("n_chars")
                columns[n] = pa.array([len(t) for t in cut], columns[n].type)
            fields = list(batch.schema.field(0).type)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(columns, fields=fields)], names=["row"])

    return run


def without_repeats(docs: DataFrame, width: int = 50, hot: int | None = None) -> DataFrame:
    """The rows of `docs`, with all their columns, with the repeated bytes of `text` cut
    out (characters that a cut breaks go as well) and `n_chars`, if there, counted anew."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"))
    each = rows.join(_lists(docs, width, hot), ["doc_id", "tag"], "left").select("row", "starts", "ends")
    layout = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema])
    return each.mapInArrow(_cut_rows([c.lower() for c in docs.columns]), T.StructType([T.StructField("row", layout)])).select("row.*")
