"""Document fingerprints by randomised edit embedding and bit sampling.

Edit embedding: every text is walked character by character with shared randomness; at
step j a pointer at character c stays or moves on by a random bit that depends only on
(j modulo `PERIOD`, c).  Texts at small edit distance soon walk in step again, so their
walks differ in few steps: edit distance becomes Hamming distance.

Bit sampling: a fingerprint has `SLOTS` slots.  Each slot samples one step of the walk,
the one of smallest priority among the walk's steps, so texts of different lengths
mostly sample the same steps, and holds 8 bits of what the pointer sees there.  The
likeness of two fingerprints is the share of equal slots.

`similar` groups documents by banding (groups of slots as bucket keys) and verifies each
link by the edit distance of the whole texts.  `with_neighbours` tells in how many bands a
text and its neighbours meet.

Null texts are empty texts; empty texts have one fingerprint, of zeros.  Equal texts
have equal fingerprints.  The next document is the next row by doc_id (rows that repeat
a doc_id: by text); after the last comes the first, which for a table of one row is the
row itself.  Texts of any length are walked whole.  Rows without a doc_id are left out.
Columns other than doc_id and text are ignored, whatever their names.  An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm import textops as X
from leafmark.llm.buckets import PIECE, across, confirmed, pair_batch, proposed, unmerged
from leafmark.llm.common import doc_texts, prepare, release, settle
from leafmark.llm.components import components

SLOTS, SEEN, PERIOD, SEED = 64, 8, 4096, 20240229
BANDS = 16

U = X.U


def _stays() -> np.ndarray:
    """For a class of characters and a step modulo PERIOD: how many steps until the walk
    moves on, by shared random bits."""
    bits = np.random.default_rng(SEED).integers(0, 2, (256, PERIOD), dtype=np.uint8)
    bits[:, -1] = 1
    stay = np.ones((256, PERIOD), np.uint8)
    for j in range(PERIOD - 2, -1, -1):
        stay[:, j] = np.where(bits[:, j] == 1, 1, np.minimum(stay[:, j + 1], 254) + 1)
    return stay.reshape(-1)


def _records() -> list[np.ndarray]:
    """For each slot, the steps whose random priority is below that of all steps before;
    the slot of a walk of n steps samples the last of them before n."""
    rng = np.random.default_rng(SEED + 1)
    out = []
    for _ in range(SLOTS):
        steps, at, priority = [0], 0, rng.random()
        while at < 1 << 40:
            at += int(rng.geometric(max(priority, 1e-15)))
            priority *= rng.random()
            steps.append(at)
        out.append(np.array(steps, np.int64))
    return out


_tables: dict[str, object] = {}


def _shared() -> tuple[np.ndarray, list[np.ndarray]]:
    if not _tables:
        _tables["stays"], _tables["records"] = _stays(), _records()
    return _tables["stays"], _tables["records"]


def walk(classes: np.ndarray, start: np.ndarray, size: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Walk many texts at once: the step at which each character is reached (in the
    layout of `classes`) and the step after the last.  `step`: where each walk begins."""
    stays, _ = _shared()
    reached = np.zeros(len(classes), np.int64)
    order = np.argsort(-size, kind="stable")
    begin, left, now = start[order], size[order], step[order].astype(np.int64)
    ends = -left  # ascending
    i, most = 0, int(left[0]) if len(left) else 0
    mask = PERIOD - 1
    while i < most:
        live = int(np.searchsorted(ends, -i, "left"))
        if live < 20:
            break
        at = begin[:live] + i
        j = now[:live]
        reached[at] = j
        j += stays[(classes[at].astype(np.int64) << 12) | (j & mask)]
        i += 1
    if i < most:  # few long texts are left: one at a time
        flat = stays.tobytes()
        for d in range(int(np.searchsorted(ends, -i, "left"))):
            a, b, j = int(begin[d]) + i, int(begin[d] + left[d]), int(now[d])
            steps = []
            for c in classes[a:b].tolist():
                steps.append(j)
                j += flat[c << 12 | j & mask]
            reached[a:b] = steps
            now[d] = j
    out = np.empty_like(now)
    out[order] = now
    return reached, out


def _classes(points: np.ndarray) -> np.ndarray:
    return ((points * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8)


def _sampled(points: np.ndarray, start: np.ndarray, size: np.ndarray, reached: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints (texts x SLOTS) from the walks; texts are laid out one after another."""
    _, records = _shared()
    hasher = X.Hasher(points)
    out = np.zeros((len(size), SLOTS), np.uint8)
    some = np.flatnonzero(size)
    if not len(some):
        return out
    # Walks in one ascending sequence, so that a step is found by one search.
    base = np.zeros(len(size) + 1, np.int64)
    np.cumsum(end + 1, out=base[1:])
    line = reached + np.repeat(base[:-1], size)
    for k, steps in enumerate(records):
        step = steps[np.searchsorted(steps, end[some], "left") - 1]
        at = np.searchsorted(line, base[:-1][some] + step, "right") - 1
        stop = np.minimum(at + SEEN, start[some] + size[some])
        out[some, k] = (hasher(at, stop) >> U(56)).astype(np.uint8)
    return out


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return points, np.r_[0, np.cumsum(size)][:-1].astype(np.int64), size


def fingerprints(texts: list[str]) -> np.ndarray:
    points, start, size = _points(texts)
    reached, end = walk(_classes(points), start, size, np.zeros(len(size), np.int64))
    return _sampled(points, start, size, reached, end)


def with_edits(texts: list[str], following: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Fingerprints of the texts and of their edited texts, and the edited texts.  The
    half that both have in common is walked once."""
    points, start, size = _points(texts)
    reached, end = walk(_classes(points), start, size, np.zeros(len(size), np.int64))
    own = _sampled(points, start, size, reached, end)
    kept = size - size // 2
    heads = [f[: len(t) // 2] for t, f in zip(texts, following, strict=True)]
    edited = [t[:k] + h for t, k, h in zip(texts, kept.tolist(), heads, strict=True)]
    new, new_start, new_size = _points(heads)
    # The step at which the first replaced character is reached.
    cut = np.minimum(start + kept, max(0, len(reached) - 1))
    begin = np.where(kept < size, reached[cut] if len(reached) else 0, end)
    new_reached, new_end = walk(_classes(new), new_start, new_size, begin)
    all_points, all_start, all_size = _points(edited)
    whole = np.empty(len(all_points), np.int64)
    inside = np.arange(len(all_points)) - np.repeat(all_start, all_size)
    doc = np.repeat(np.arange(len(all_size)), all_size)
    first = inside < kept[doc]
    whole[first] = reached[(start[doc] + inside)[first]]
    whole[~first] = new_reached[(new_start[doc] + inside - kept[doc])[~first]]
    return own, _sampled(all_points, all_start, all_size, whole, new_end), edited


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, bands_edited int, bands_next int"


def _rows(ids: list[int], texts: list[str], next_texts: list[str], next_prints: np.ndarray | None) -> list:
    own, changed, edited = with_edits(texts, next_texts)
    following = np.concatenate([own[1:], fingerprints(next_texts[-1:])]) if next_prints is None else next_prints
    return [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
        pa.array([x.tobytes().hex() for x in own]),
        pa.array([x.tobytes().hex() for x in changed]),
        pa.array((own == changed).mean(axis=1)),
        pa.array((own == following).mean(axis=1)),
        pa.array(shared_bands(own, changed)),
        pa.array(shared_bands(own, following)),
    ]


_NAMES = [x.split()[0] for x in _RESULT.split(", ")]


def _sorted_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of all documents but the partition's last; its first and last texts as well."""
    task, wait, first = TaskContext.get().partitionId(), None, None

    def edge(role: str, doc_id: int, text: str) -> pa.RecordBatch:
        blank = [pa.array([doc_id], pa.int64()), *(pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32()))]
        return pa.RecordBatch.from_arrays([*blank, pa.array([task], pa.int64()), pa.array([role]), pa.array([text])], names=[*_NAMES, "task", "role", "text"])

    for piece in X.pieces(batches, 2 << 20):
        ids, texts = piece.column(0).to_pylist(), piece.column(1).to_pylist()
        if first is None:
            first = ids[0]
            yield edge("first", ids[0], texts[0])
        if wait is not None:
            ids, texts = [wait[0], *ids], [wait[1], *texts]
        wait = (ids[-1], texts[-1])
        if len(ids) > 1:
            n = len(ids) - 1
            rows = _rows(ids[:-1], texts[:-1], texts[1:], None)
            yield pa.RecordBatch.from_arrays([*rows, pa.array(np.full(n, task, np.int64)), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names=[*_NAMES, "task", "role", "text"])
    if wait is not None:
        yield edge("last", *wait)


def _edge_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in X.pieces(batches, 2 << 20):
        texts, following = piece.column(1).to_pylist(), piece.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays(_rows(piece.column(0).to_pylist(), texts, following, fingerprints(following)), names=_NAMES)


def with_neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, bands_edited, bands_next): each text, its edited text (the last half of its characters replaced by
    the first of the next document) and the next document, compared by fingerprint.

    The texts are dealt out by ranges of doc_id once; only each range's first and last
    text travel again, to meet across the ranges.
    """
    prepare(docs.sparkSession)
    dealt = doc_texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    found = settle(dealt.mapInArrow(_sorted_run, f"{_RESULT}, task long, role string, text string"))
    edges = found.where("role IS NOT NULL")
    # One number for each task that had rows.
    tasks = [r.task for r in edges.where("role = 'first'").select("task").orderBy("task").collect()]
    if not tasks:
        return found.select(*_NAMES)
    turns = docs.sparkSession.createDataFrame(list(zip(tasks, [*tasks[1:], tasks[0]], strict=True)), "task long, next_task long")
    firsts = edges.where("role = 'first'").select(F.col("task").alias("next_task"), F.col("text").alias("next_text"))
    lasts = edges.where("role = 'last'").select("doc_id", "text", "task")
    pairs = lasts.join(turns, "task").join(firsts, "next_task").select("doc_id", "text", "next_text")
    return found.where("role IS NULL").select(*_NAMES).union(pairs.mapInArrow(_edge_run, _RESULT))


def shared_bands(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bands fingerprints agree: in one or more, `similar` compares the texts."""
    return (a == b).reshape(-1, BANDS, SLOTS // BANDS).all(axis=2).sum(axis=1).astype(np.int32)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, digest) of every whole text; the digest is of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in X.pieces(batches):
            texts = piece.column(1).to_pylist()
            prints = fingerprints(texts)
            digests = [hashlib.sha256(t.encode()).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([x.tobytes() for x in prints], pa.binary()), pa.array(digests, pa.binary())], names=["doc_id", "fingerprint", "digest"])

    prepare(docs.sparkSession)
    return doc_texts(docs).mapInArrow(run, "doc_id long, fingerprint binary, digest binary")


def _trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the code points that both begin with, and then those both end with."""
    n = min(len(a), len(b))
    unlike = a[:n] != b[:n]
    same = int(unlike.argmax()) if unlike.any() else n
    a, b, n = a[same:], b[same:], n - same
    unlike = a[len(a) - n :][::-1] != b[len(b) - n :][::-1]
    same = int(unlike.argmax()) if unlike.any() else n
    return a[: len(a) - same], b[: len(b) - same]


def _bits(flags: np.ndarray) -> int:
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _deltas(bits: int, n: int) -> np.ndarray:
    packed = np.frombuffer(bits.to_bytes((n + 7) // 8, "little"), np.uint8)
    return np.unpackbits(packed, count=n, bitorder="little").astype(np.int64)


def _in_band(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The number of edits, or None if over `most`, by cells at most `most` off the
    diagonal.  A run of columns shares a window of rows that holds the band; what enters
    at its edges is the cost of a real way round, so no cell is too small."""
    run, done = max(256, most), 0
    low, high, corner = 0, min(len(a), run + most), 0  # rows of the window, cost above its first
    full = (1 << high) - 1
    up, down = full, 0  # where a column's next cell is larger, smaller
    while done < len(b):
        upto = min(len(b), done + run)
        drop, tall = max(0, done - most) - low, min(len(a), upto + most)
        corner += (up & (1 << drop) - 1).bit_count() - (down & (1 << drop) - 1).bit_count()
        up, down = up >> drop | ((1 << tall - high) - 1) << high - low - drop, down >> drop
        low, high = low + drop, tall
        window, full, masks = a[low:high], (1 << high - low) - 1, {}
        for c in b[done:upto].tolist():
            m = masks.get(c)
            if m is None:
                m = masks[c] = _bits(window == c)
            same = (((m & up) + up) ^ up) | m | down
            more, less = (down | ~(same | up) & full) << 1 | 1, (same & up) << 1
            up, down = less & full | ~(same | more) & full, more & same & full
        corner, done = corner + upto - done, upto
        costs = corner + np.r_[0, np.cumsum(_deltas(up, high - low) - _deltas(down, high - low))]
        ahead = np.abs(len(a) - np.arange(low, high + 1) - (len(b) - done))
        if (costs + ahead).min() > most:
            return None
    return int(costs[-1])


def edit_distance(a: str, b: str, most: int) -> int | None:
    """The number of edits from `a` to `b`, or None if over `most`.

    Bit-parallel within a band of diagonals that doubles until it holds the answer, so the
    work is the length times the number of edits (or `most`), over 64 cells a step.
    """
    x, y = _trimmed(*(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b)))
    gap = abs(len(x) - len(y))
    if gap > most or not len(x) or not len(y):
        return max(len(x), len(y)) if gap <= most and max(len(x), len(y)) <= most else None
    band = min(most, max(64, gap))
    while True:
        found = _in_band(x, y, band)
        if found is not None or band == most:
            return found
        band = min(most, 2 * band)


def _verify(edits: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_text = None, ""
        for piece in X.pieces(batches):
            good: list[tuple[int, int]] = []
            for a, b, text in zip(*(c.to_pylist() for c in piece.columns[:3]), strict=True):
                if a == b:
                    hub, hub_text = a, text
                elif hub == a and edit_distance(hub_text, text, int(edits * max(len(text), len(hub_text)))) is not None:
                    good.append((a, b))
            yield pair_batch(*np.array(good, np.int64).reshape(-1, 2).T)

    return run


def _by_row(docs: DataFrame, least: float, edits: float, piece: int) -> DataFrame:
    """`similar` where doc_ids repeat: rows are grouped, and then rows of one doc_id."""
    rows = settle(doc_texts(docs).withColumn("row", F.monotonically_increasing_id()))
    found = similar(rows.select(F.col("row").alias("doc_id"), "text"), least, edits, piece)
    own = rows.select("row", F.col("doc_id").alias("own"))
    named = settle(found.withColumnRenamed("doc_id", "row").join(own, "row").select("own", F.col("class_id").alias("class"), F.col("group_id").alias("group")))
    first = named.groupBy("own").agg(F.min("group").alias("a"))
    links = named.join(first, "own").where("a <> group").select("a", F.col("group").alias("b")).distinct()
    joined = named.join(components(links).select(F.col("node").alias("group"), "component"), "group", "left").withColumn("group", F.coalesce("component", "group"))
    of_class = joined.groupBy("class").agg(F.min("own").alias("class_id"))
    of_group = joined.groupBy("group").agg(F.min("own").alias("group_id"))
    return joined.join(of_class, "class").join(of_group, "group").select(F.col("own").alias("doc_id"), "class_id", "group_id")


def similar(docs: DataFrame, least: float = 0.7, edits: float = 0.2, piece: int = PIECE) -> DataFrame:
    """(doc_id, class_id, group_id): classes of equal texts, and groups of documents
    linked, directly or in chains, by texts that are at most `edits` of the longer one's
    characters apart and whose fingerprints agree in `least` of their slots.  A class or
    group is named by its smallest doc_id; rows that repeat a doc_id are of one group.

    Banding: fingerprints that agree in a whole band meet in a bucket, and those that
    agree in 0.7 of all slots share no band with probability 0.012.  Pairs are taken from
    buckets without lists of all pairs (see `buckets`) and verified on the whole texts.
    Equal texts are one class, and only classes are compared.  Empty texts are equal.
    """
    prints = settle(fingerprinted(docs))
    if not prints.groupBy("doc_id").count().where("count > 1").isEmpty():
        release(prints)
        return _by_row(docs, least, edits, piece)
    classes = settle(prints.groupBy("fingerprint", "digest").agg(F.min("doc_id").alias("doc_id")))
    width = SLOTS // BANDS
    bands = F.array(*(F.xxhash64(F.lit(b), F.substring("fingerprint", b * width + 1, width)) for b in range(BANDS)))
    rows = classes.select("doc_id", F.col("fingerprint").alias("signature"), F.posexplode(bands).alias("band", "key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")
    # No sizes bound a pair's likeness here, so they are all alike.
    members = settle(rows.join(shared, "key").withColumns({"n_shingles": F.lit(1).cast("long"), "common": F.lit(1).cast("long")}))
    texts = settle(doc_texts(docs).join(members.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"))
    first = settle(proposed(members, least, piece))
    links = settle(confirmed(first, texts, _verify(edits), piece))
    groups = components(links)
    named = members.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    open_ = unmerged(named, piece)
    second = settle(across(open_, least, 0, BANDS, width).join(first, ["a", "b"], "left_anti"))
    if not second.isEmpty():
        groups = components(links.union(settle(confirmed(second, texts, _verify(edits), piece))))
    release(members, texts, first, open_)
    of_class = classes.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "fingerprint", "digest", F.col("doc_id").alias("class_id"), F.coalesce("component", "doc_id").alias("group_id")
    )
    return prints.join(of_class, ["fingerprint", "digest"]).select("doc_id", "class_id", "group_id")
