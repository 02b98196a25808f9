"""Repeated passages: every run of several consecutive sentences, hashed and joined.

A sentence ends at a full stop, question or exclamation mark (or several) before white
space, or at a line break.  One of more than `longest` words counts as several: it is cut
after each word whose hash is smaller than those of the `reach` words on either side, and
pieces that are still longer (one word said over and over) every `longest` words.  Such
cuts depend on the words around them only, so a passage has the same pieces wherever in a
sentence it begins.

Every run of `span` consecutive sentences of a document is hashed (a shorter document has
its whole sequence as its one run).  A run's first occurrence, by (doc_id, place), is
kept; the sentences of any later occurrence go.  The place of the first comes from a
grouped minimum with a map-side combine, and is joined back by the hash: runs with more
than one in `HOT` of all occurrences, of which there are fewer than `HOT`, by broadcast,
so that no task gets all occurrences of a common passage; the others by a shuffle.  Both
joins keep each occurrence as one row, so neither makes more rows than there are.

Runs compare sentences with outer white space removed and inner runs of white space as
one space.  Null and empty texts have no sentence and lose nothing.  Texts of any length
are read whole.  Rows that repeat a doc_id are told apart by text (equal rows are one
document, and each gets a row).  Rows without a doc_id are left out.  Columns other than
doc_id and text are ignored, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm import textops as X
from leafmark.llm.common import doc_texts, prepare, settle

SPAN = 3
LONGEST, REACH = 16, 3
HOT = 2000
_STOP = np.zeros(256, bool)
_STOP[[0x21, 0x2E, 0x3F]] = True
_LINE = np.zeros(256, bool)
_LINE[[0x0A, 0x0D]] = True

U = X.U


def sentences(data: np.ndarray, offsets: np.ndarray, longest: int = LONGEST, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each sentence: first byte, document, hash of its words."""
    starts, ends, doc = X.words(data, offsets)
    if not len(starts):
        e = np.zeros(0, np.int64)
        return e, e, e.astype(U)
    # A word closes its sentence by its last byte, or by a line break before the next word.
    breaks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LINE[data], out=breaks[1:])
    closes = np.ones(len(starts), bool)
    closes[:-1] = _STOP[data[ends[:-1] - 1]] | (breaks[starts[1:]] > breaks[ends[:-1]]) | (doc[1:] != doc[:-1])
    hashes = X.Hasher(data)(starts, ends)

    def pieces() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        last = np.flatnonzero(closes)
        first = np.r_[0, last[:-1] + 1]
        return first, np.repeat(np.arange(len(first)), last - first + 1), np.arange(len(starts)) - np.repeat(first, last - first + 1)

    first, of, _ = pieces()
    long = (np.bincount(of) > longest)[of]
    for k in range(1, reach + 1):  # words outside the sentence count as larger
        same = of[k:] == of[:-k]
        long[k:] &= ~same | (hashes[k:] < hashes[:-k])
        long[:-k] &= ~same | (hashes[:-k] < hashes[k:])
    closes |= long
    first, of, nth = pieces()
    closes |= nth % longest == longest - 1
    first, of, nth = pieces()
    total = np.add.reduceat(X.mix(hashes + nth.astype(U) * U(X.BASE)), first)
    return starts[first], doc[first], X.mix(total)


def runs(code: np.ndarray, doc: np.ndarray, n: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of `span` sentences, their first sentences and lengths."""
    many = X.counts(doc, n)
    at = np.zeros(n + 1, np.int64)
    np.cumsum(many, out=at[1:])
    place = np.arange(len(code))
    left = at[doc + 1] - place
    total = np.zeros(len(code), U)
    for k in range(span):
        here = code[k:] * U((X.BASE * (2 * k + 5)) % (1 << 64) | 1)
        total[: len(here)] += np.where(left[: len(here)] > k, here, U(0))
    keep = np.flatnonzero((left >= span) | ((many[doc] < span) & (place == at[doc])))
    length = np.minimum(left[keep], span)
    return X.mix(total[keep] + length.astype(U)), keep, length


def _run_rows(span: int, longest: int, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in X.pieces(batches):
            data, offsets = X.texts(piece.column(1))
            _, doc, code = sentences(data, offsets, longest, reach)
            hashes, place, _ = runs(code, doc, piece.num_rows, span)
            d = doc[place]
            place = place - np.searchsorted(doc, np.arange(piece.num_rows))[d]
            yield pa.RecordBatch.from_arrays(
                [X.longs(hashes), pa.array(piece.column(0).to_numpy()[d]), pa.array(piece.column(2).to_numpy()[d]), pa.array(place.astype(np.int32))],
                names=["run", "doc_id", "tag", "place"],
            )

    return run


def _cut(span: int, longest: int, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in X.pieces(batches):
            data, offsets = X.texts(piece.column(2))
            starts, doc, _ = sentences(data, offsets, longest, reach)
            n = piece.num_rows
            first = np.searchsorted(doc, np.arange(n + 1))
            gone = np.zeros(len(starts), bool)
            lists = piece.column(3)
            if lists.null_count < n:
                holder = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
                at = first[holder] + lists.flatten().to_numpy().astype(np.int64)
                for k in range(span):
                    gone[np.minimum(at + k, first[holder + 1] - 1)] = True
            # A sentence takes the white space up to the next one with it.
            upto = np.r_[starts[1:], len(data)] if len(starts) else starts
            upto = np.minimum(upto, offsets[doc + 1]) if len(starts) else upto
            dropped = np.zeros(len(data) + 1, np.int32)
            np.add.at(dropped, starts[gone], 1)
            np.add.at(dropped, upto[gone], -1)
            kept = data[np.cumsum(dropped)[: len(data)] == 0]
            lost = np.zeros(n, np.int64)
            np.add.at(lost, doc[gone], (upto - starts)[gone])
            to = np.r_[0, np.cumsum(np.diff(offsets) - lost)].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0),
                    pa.array(np.diff(first)),
                    pa.array(X.counts(doc[gone], n)),
                    pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(to), pa.py_buffer(kept.tobytes())]),
                ],
                names=["doc_id", "n_sentences", "n_removed", "text"],
            )

    return run


def remove_repeated_spans(docs: DataFrame, span: int = SPAN, longest: int = LONGEST, reach: int = REACH) -> DataFrame:
    """(doc_id, n_sentences, n_removed, text): every document without the sentences that
    a non-first run of `span` sentences covers."""
    prepare(docs.sparkSession)
    rows = doc_texts(docs).withColumn("tag", F.xxhash64("text"))
    found = settle(rows.mapInArrow(_run_rows(span, longest, reach), "run long, doc_id long, tag long, place int"))
    place = F.struct("doc_id", "tag", "place")
    often = found.groupBy("run").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).where("first <> last")
    often = settle(often.select("run", "first", "n"))
    hot = F.col("n") * HOT > found.count()
    # Fewer than HOT rows, as each has more than one in HOT of all.
    common = F.broadcast(often.where(hot).select("run", F.col("first").alias("hot")))
    marked = found.join(common, "run", "left")
    # Every row passes both joins once and meets one row at most.  Rows of common runs are
    # dealt out by their place, and take nothing from the second.
    cold = often.where(~hot).select(F.col("run").alias("of"), "first")
    dealt = F.when(F.col("hot").isNull(), F.col("run")).otherwise(F.xxhash64("run", "doc_id", "tag", "place"))
    both = marked.withColumn("dealt", dealt).join(cold, F.col("dealt") == F.col("of"), "left")
    again = both.where(place != F.coalesce("hot", F.when(F.col("hot").isNull(), F.col("first")))).select("doc_id", "tag", "place")
    lists = again.groupBy("doc_id", "tag").agg(F.collect_list("place").alias("places"))
    each = rows.join(lists, ["doc_id", "tag"], "left").select("doc_id", "tag", "text", "places")
    return each.mapInArrow(_cut(span, longest, reach), "doc_id long, n_sentences long, n_removed long, text string")
