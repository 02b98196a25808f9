"""Near-duplicate grouping by SuperMinHash, banding, exact verification and union-find.

Steps, all partitioned by Spark:

1. `signatures`: one pass over the texts; each document's distinct five-word shingles
   give a digest of the set and a SuperMinHash signature.
2. Documents with the same set form a class at once (one row per class goes on), so a
   group of any number of exact copies costs one row.
3. Classes that agree on a whole band meet in a bucket.  Within a bucket no list of all
   pairs is made: its most central member (closest to the bucket's most frequent
   signature values) is proposed to the others (a bucket of more than `PIECE` members in
   pieces, each with the bucket's first member); once those links have merged classes,
   only pairs across components remain, and of those only pairs that could reach the
   threshold by their signatures and by their shingles that no other document in an
   unmerged bucket has (a pair cannot share those, which bounds its intersection; this
   is what keeps a large family of copies below the threshold from being paired up).
4. Proposed pairs are confirmed on the full shingle sets, recomputed from the texts.
5. `components` joins the confirmed links.

With 25 bands of 5 values, a pair at similarity 0.85 shares no band with probability
4e-7; the signature test loses such a pair with probability under 1e-5 (see `SLACK`).

Null and empty texts have an empty set and are linked with nothing; a document with
fewer words than a shingle has its whole sequence as its one shingle; rows that repeat
a doc_id each get their row and are of one group, with all that any of their texts links to; rows without a doc_id are
left out; texts of any length are read whole; columns other than doc_id and text are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm import textops as X
from leafmark.llm.buckets import PIECE, across, confirmed, pair_batch, proposed, unmerged
from leafmark.llm.common import doc_texts, prepare, release, settle
from leafmark.llm.components import components

VALUES, BANDS, ROWS = 128, 25, 5
#: How far below the threshold an estimate may be: 4.4 standard deviations at 0.85.
SLACK = 0.14

U = X.U
_SCALE = 24  # bits of the fraction in a stored value: rank * 2**24 + fraction


def superminhash(hashes: np.ndarray, offsets: np.ndarray, values: int = VALUES) -> np.ndarray:
    """SuperMinHash signatures (documents x values, uint32) of sets of 64-bit hashes.

    Element e carries one random permutation; the value it gives to slot perm[k] is
    k + a random fraction, and a slot keeps its smallest.  Round k of all elements of
    all unfinished documents is one numpy step; a document stops as soon as its largest
    slot is below the next rank, after which no element can lower any slot.
    """
    n = len(offsets) - 1
    out = np.full((n, values), 0xFFFFFFFF, np.uint32)
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    elements, perm = hashes, None
    for k in range(values):
        live = np.zeros(n, bool)
        live[(size > 0) & (out.max(axis=1, initial=0) >= (k << _SCALE))] = True
        keep = live[doc]
        if not keep.all():
            elements, doc = elements[keep], doc[keep]
            perm = None if perm is None else perm[keep]
        if not len(elements):
            break
        r = X.mix(elements + U((k + 1) * 0xA0761D6478BD642F % (1 << 64)))
        pick = (k + (r >> U(32)) % U(values - k)).astype(np.int64)
        if k == 0 and n:
            slot = pick
        else:
            if perm is None:  # round 0 of those still live is repeated to set up their permutations
                perm = np.tile(np.arange(values, dtype=np.uint8), (len(elements), 1))
                first = ((X.mix(elements + U(0xA0761D6478BD642F)) >> U(32)) % U(values)).astype(np.int64)
                row = np.arange(len(elements))
                perm[:, 0], perm[row, first] = perm[row, first].copy(), perm[:, 0].copy()
            row = np.arange(len(elements))
            slot = perm[row, pick].copy()
            perm[row, pick] = perm[:, k]
            perm[:, k] = slot
        value = (U(k << _SCALE) | (r & U((1 << _SCALE) - 1))).astype(np.uint32)
        np.minimum.at(out.reshape(-1), doc * values + slot.astype(np.int64), value)
    return out


def _signature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in X.pieces(batches):
        data, at = X.texts(piece.column(1))
        hashes, offsets = X.shingles(data, at)
        n, size = piece.num_rows, np.diff(offsets)
        signature = superminhash(hashes, offsets)
        filled = np.flatnonzero(size)
        digest = np.zeros((2, n), U)
        if len(filled):
            for row, factor in ((0, 0x9FB21C651E98DF25), (1, 0xD6E8FEB86659FD93)):
                digest[row, filled] = X.mix(np.add.reduceat(X.mix(hashes ^ U(factor)), offsets[:-1][filled]) + size[filled].astype(U))
        low = (X.mix(signature.astype(U)) & U(255)).astype(np.uint8)
        bands = np.zeros((n, BANDS), U)
        for b in range(BANDS):
            total = np.full(n, b + 1, U)
            for value in low[:, b * ROWS : (b + 1) * ROWS].T:
                total = (total << U(8)) | value
            bands[:, b] = X.mix(total)
        yield pa.RecordBatch.from_arrays(
            [
                piece.column(0),
                pa.array(size.astype(np.int64)),
                X.longs(digest[0]),
                X.longs(digest[1]),
                pa.array([x.tobytes() for x in low], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), X.longs(bands.reshape(-1))),
            ],
            names=["doc_id", "n_shingles", "d1", "d2", "signature", "bands"],
        )


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, signature, bands) of every document."""
    prepare(docs.sparkSession)
    return doc_texts(docs).mapInArrow(
        _signature_batches, "doc_id long, n_shingles long, d1 long, d2 long, signature binary, bands array<long>"
    )


def _confirm(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, None
        for piece in X.pieces(batches):
            a, b = piece.column(0).to_numpy(), piece.column(1).to_numpy()
            hashes, at = X.shingles(*X.texts(piece.column(2)))
            good = np.zeros(len(a), bool)
            for i in range(len(a)):
                own = hashes[at[i] : at[i + 1]]
                if a[i] == b[i]:
                    hub, hub_set = a[i], np.sort(own)
                elif hub == a[i]:
                    place = np.searchsorted(hub_set, own)
                    place[place == len(hub_set)] = 0
                    both = int((hub_set[place] == own).sum()) if len(hub_set) else 0
                    good[i] = 100 * both >= threshold * (len(own) + len(hub_set) - both)
            yield pair_batch(a[good], b[good])

    return run


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in X.pieces(batches):
        hashes, at = X.shingles(*X.texts(piece.column(1)))
        yield pa.RecordBatch.from_arrays([X.longs(hashes), pa.array(np.repeat(piece.column(0).to_numpy(), np.diff(at)))], names=["shingle", "doc_id"])


def with_common(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """`rows` with `common`: how many of a document's shingles another of them has."""
    own = rows.select("doc_id").distinct()
    shingles = texts.join(own.hint("merge"), "doc_id", "left_semi").mapInArrow(_shingle_rows, "shingle long, doc_id long")
    alone = shingles.groupBy("shingle").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last")).where("doc_id = last")
    counted = rows.join(alone.groupBy("doc_id").agg(F.count("*").alias("alone")), "doc_id", "left")
    return counted.withColumn("common", F.col("n_shingles") - F.coalesce("alone", F.lit(0)))


def _by_row(docs: DataFrame, percent: int, piece: int) -> DataFrame:
    """`near_duplicates` where doc_ids repeat: rows are grouped, and then rows of one doc_id."""
    rows = settle(doc_texts(docs).withColumn("row", F.monotonically_increasing_id()))
    found = near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), percent, piece)
    named = settle(found.withColumnRenamed("doc_id", "row").join(rows.select("row", F.col("doc_id").alias("own")), "row").select("own", "n_shingles", F.col("component_id").alias("group")))
    first = named.groupBy("own").agg(F.min("group").alias("a"))
    links = named.join(first, "own").where("a <> group").select("a", F.col("group").alias("b")).distinct()
    joined = named.join(components(links).select(F.col("node").alias("group"), "component"), "group", "left").withColumn("group", F.coalesce("component", "group"))
    least = joined.groupBy("group").agg(F.min("own").alias("component_id"))
    return joined.join(least, "group").select(F.col("own").alias("doc_id"), "n_shingles", "component_id", (F.col("own") == F.col("component_id")).alias("kept"))


def near_duplicates(docs: DataFrame, percent: int = 85, piece: int = PIECE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): groups of documents linked, directly or
    in chains, by 100 * intersection >= `percent` * union of their shingle sets.

    component_id is the group's smallest doc_id; the document that carries it is kept.
    `piece`: so many members of a bucket, or partners of a document, are one task's work.
    """
    prepare(docs.sparkSession)
    least = percent / 100 - SLACK
    marked = settle(signatures(docs))
    if not marked.groupBy("doc_id").count().where("count > 1").isEmpty():
        release(marked)
        return _by_row(docs, percent, piece)
    filled = marked.where("n_shingles > 0")
    class_of = settle(filled.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")))
    reps = settle(
        filled.join(class_of, (filled.doc_id == class_of.rep) & (filled.d1 == class_of.d1) & (filled.d2 == class_of.d2), "left_semi")
        .dropDuplicates(["doc_id", "d1", "d2"])
    )
    rows = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")
    met = rows.join(shared, "key")
    members = settle(met.join(reps.select("doc_id", "signature", "n_shingles"), "doc_id").select("key", "doc_id", "signature", "n_shingles", "band", "n", "first"))
    # A sort-merge join whatever the size, so that small inputs show the plan of large ones.
    texts = settle(doc_texts(docs).join(members.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"))
    first = settle(proposed(members, least, piece))
    links = settle(confirmed(first, texts, _confirm(percent), piece))
    groups = components(links)
    named = members.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    open_ = unmerged(named, piece)
    second = settle(across(with_common(open_, texts), least, percent, BANDS, ROWS).join(first, ["a", "b"], "left_anti"))
    if not second.isEmpty():
        more = settle(confirmed(second, texts, _confirm(percent), piece))
        if not more.isEmpty():
            groups = components(links.union(more))
    release(members, texts, reps, first, open_)
    named_class = class_of.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(
        "d1", "d2", F.coalesce("component", "rep").alias("component")
    )
    return (
        marked.select("doc_id", "n_shingles", "d1", "d2")
        .join(named_class, ["d1", "d2"], "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )
