"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The benchmark is taken in blocks of at most `BLOCK` words, which is what is broadcast at
a time; a larger benchmark takes more passes over the documents, nothing is left out.

1. One pass over every whole text counts in how many documents each word pair and trigram
   of the benchmark occurs (one-word items: the word).  A pair is two words side by side or
   with any one word between them, in the item and in the text alike, so a word more or
   less, or another one, leaves pairs.
2. The rare ones become seeds: of an item's pairs of each kind, and of its trigrams, those that cost
   at most `RARE` times what its cheapest quarter does, where the cost of an n-gram is the
   number of its documents times that of its items (in all blocks), and only n-grams that
   occur count.
   So an item has seeds however often it was leaked, and a stock phrase of many items is
   none while they have anything rarer.
3. A second pass finds the seeds in every whole text.  Where seeds of one item lie near one
   diagonal (two different ones, or one for items of fewer than ten words), the words
   around them are aligned with the item.  The score is the best local alignment over
   that of the item with itself: a verbatim copy has 1.

With one point off for an edit and two for a match, a passage that reaches 0.5 with words
replaced has at least (n - 3) / 3 of the item's n - 1 bigrams, so every third word may
differ, or a word may stand after every word.  Items of fewer than ten words are known by
words side by side only; single words of two- and three-word items have no seed and are not reported.

Words are runs of letters and digits, lower-cased.  Null and empty items have no word and
match nothing, nor do null and empty texts.  Items with equal item_id are searched for
each by its own text.  A document with several copies of one item gives one row, that of
the best score (ties: the first place).  Rows that repeat a doc_id are one document (the
best of them).  Rows without a doc_id or item_id are left out.  An empty table on either
side gives no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm import textops as X
from leafmark.llm.common import doc_texts, prepare, release, settle

BLOCK = 250_000
MATCH, MISMATCH, GAP = 2, -1, -1
RARE = 8
SHORT = 10  # words from which on an item needs two seeds
#: Kinds of seeds: words in a row, or 0 for a pair with a word between.
ALONE, APART, PAIR, TRIPLE = 1, 0, 2, 3

U = X.U
_TABLE_BITS = 22


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of lower-cased texts, their documents, and each document's first word (n + 1)."""
    data, offsets = X.texts(pc.utf8_lower(column))
    starts, ends, doc = X.tokens(X.sign_breaks(data), offsets)
    at = np.zeros(len(offsets), np.int64)
    np.cumsum(X.counts(doc, len(offsets) - 1), out=at[1:])
    return X.Hasher(data)(starts, ends), doc, at


def grams(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams inside documents and the places of their first words."""
    if len(words) < n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    total = np.full(len(words) - n + 1, n, U)
    for k in range(n):
        total += words[k : len(total) + k] * U((X.BASE * (2 * k + 7)) % (1 << 64) | 1)
    whole = np.flatnonzero(doc[: len(total)] == doc[n - 1 :])
    return X.mix(total[whole]), whole


def kinds(words: np.ndarray, doc: np.ndarray, wanted: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes and places of the n-grams of each kind; pairs hash alike, whatever stands between."""
    out = []
    for kind in wanted:
        if kind == APART:
            if len(words) < 3:
                out.append((np.zeros(0, U), np.zeros(0, np.int64)))
                continue
            # The same sum as for a pair, of words two places apart.
            total = np.full(len(words) - 2, PAIR, U) + words[:-2] * U((X.BASE * 7) % (1 << 64) | 1) + words[2:] * U((X.BASE * 9) % (1 << 64) | 1)
            whole = np.flatnonzero(doc[:-2] == doc[2:])
            out.append((X.mix(total[whole]), whole))
        else:
            out.append(grams(words, doc, kind))
    return out


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman with linear gaps: best local score, and where it ends in both."""
    step = -GAP * np.arange(len(words) + 1)
    row, best, at = np.zeros(len(words) + 1, np.int64), 0, (0, 0)
    for i, word in enumerate(item):
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(words == word, MATCH, MISMATCH))
        row = np.maximum.accumulate(new + step) - step  # gaps along the row
        j = int(row.argmax())
        if row[j] > best:
            best, at = int(row[j]), (i + 1, j)
    return best, *at


class Items:
    """A block of the benchmark: items' words, and their n-grams sorted by hash."""

    def __init__(self, ids: list[int], texts: list[str]):
        words, doc, self.first = hashed_words(pa.array(texts, pa.string()))
        self.ids, self.words = np.array(ids, np.int64), words
        self.size = np.diff(self.first)
        code, place, kind = [], [], []
        every = (ALONE, APART, PAIR, TRIPLE)
        for n, (c, p) in zip(every, kinds(words, doc, every), strict=True):
            if n in (ALONE, APART):
                own = self.size[doc[p]] == 1 if n == ALONE else self.size[doc[p]] >= SHORT
                c, p = c[own], p[own]
            code.append(c)
            place.append(p)
            kind.append(np.full(len(c), n))
        code, place, kind = map(np.concatenate, (code, place, kind))
        self._entries(code, doc[place], place - self.first[doc[place]], kind)

    def _entries(self, code: np.ndarray, item: np.ndarray, place: np.ndarray, kind: np.ndarray) -> None:
        order = np.argsort(code, kind="stable")
        self.code, self.item, self.place, self.kind = code[order], item[order], place[order], kind[order]
        have = set(kind.tolist())
        #: What texts are searched for: pairs of both kinds where items have either.
        self.sizes = sorted(have | ({APART, PAIR} if have & {APART, PAIR} else set()))
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.code >> U(64 - _TABLE_BITS)).astype(np.int64)] = True

    def found(self, words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
        """The n-grams of texts that are among the items': hash, place, their range of entries,
        and whether there is a word between."""
        every = kinds(words, doc, self.sizes) or [(np.zeros(0, U), np.zeros(0, np.int64))]
        code, place = (np.concatenate(x) for x in zip(*every, strict=True))
        apart = np.repeat([k == APART for k in self.sizes or [PAIR]], [len(c) for c, _ in every])
        hit = np.flatnonzero(self.table[(code >> U(64 - _TABLE_BITS)).astype(np.int64)])
        code, place, apart = code[hit], place[hit], apart[hit]
        lo, hi = np.searchsorted(self.code, code, "left"), np.searchsorted(self.code, code, "right")
        hit = hi > lo
        return code[hit], place[hit], lo[hit], hi[hit], apart[hit]

    def rare(self, costs: dict[int, float]) -> Items:
        """The same items with only their rare n-grams, given what each (its hash as a signed
        number) costs; 0 if no document has it."""
        cost = np.array([costs.get(c, 0) for c in self.code.view(np.int64).tolist()], np.float64)
        keep = np.zeros(len(cost), bool)
        group = self.item * 4 + self.kind
        order = np.argsort(group, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            own = cost[rows]
            if (own > 0).any():
                keep[rows] = (own > 0) & (own <= RARE * np.quantile(own[own > 0], 0.25, method="lower"))
        out = object.__new__(Items)
        out.ids, out.words, out.first, out.size = self.ids, self.words, self.first, self.size
        out._entries(self.code[keep], self.item[keep], self.place[keep], self.kind[keep])
        return out


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram): the different n-grams of each item."""
    for piece in X.pieces(batches):
        items = Items(list(range(piece.num_rows)), [x or "" for x in piece.column(1).to_pylist()])
        own = np.unique(np.stack([items.item.astype(U), items.code]), axis=1)[1]
        yield pa.RecordBatch.from_arrays([X.longs(own)], names=["gram"])


def _count(held):
    """(gram, n): in how many of a task's documents each n-gram of the items occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = held.value
        total = np.zeros(len(items.code), np.int64)  # by an n-gram's first entry
        for piece in X.pieces(batches):
            words, doc, _ = hashed_words(piece.column(1))
            _, place, lo, *_ = items.found(words, doc)
            once = np.unique(lo * np.int64(piece.num_rows) + doc[place])
            np.add.at(total, once // max(1, piece.num_rows), 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([X.longs(items.code[seen]), pa.array(total[seen])], names=["gram", "n"])

    return run


_RESULT = "doc_id long, item_id long, n_seeds long, score double, start_word long, end_word long"


def _search(held, least: float):
    names = [x.split()[0] for x in _RESULT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = held.value
        for piece in X.pieces(batches):
            ids = piece.column(0).to_numpy()
            words, doc, first = hashed_words(piece.column(1))
            code, place, lo, hi, apart = items.found(words, doc)
            # Every place of an item that a seed may be, in order of document, item and diagonal.
            row = np.repeat(np.arange(len(code)), hi - lo)
            entry = np.arange(len(row)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[row]
            # Items of few words have no pairs with a word between.
            keep = ~apart[row] | (items.size[items.item[entry]] >= SHORT)
            row, entry = row[keep], entry[keep]
            d, item = doc[place[row]], items.item[entry]
            diagonal = place[row] - first[d] - items.place[entry]
            order = np.lexsort((diagonal, item, d))
            row, d, item, diagonal = row[order], d[order], item[order], diagonal[order]
            if not len(row):
                continue
            slack = np.maximum(8, items.size[item] // 2)
            cut = np.r_[True, (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > slack[1:])]
            group = np.cumsum(cut) - 1
            distinct = np.unique(np.stack([group.astype(U), code[row]]), axis=1)[0].astype(np.int64)
            seeds = np.bincount(distinct, minlength=group[-1] + 1)
            begin = np.flatnonzero(cut)
            end = np.r_[begin[1:], len(row)]
            out: list[tuple] = []
            for g in np.flatnonzero(seeds >= np.where(items.size[item[begin]] < SHORT, 1, 2)):
                a, b = begin[g], end[g]
                i, start, stop = item[a], first[d[a]], first[d[a] + 1]
                x = max(start, start + int(diagonal[a] - slack[a]))
                window = words[x : min(stop, start + int(diagonal[b - 1] + items.size[i] + slack[a]))]
                own = items.words[items.first[i] : items.first[i + 1]]
                best, _, upto = align(own, window)
                if best >= least * MATCH * len(own):
                    _, _, back = align(own[::-1], window[:upto][::-1])
                    at = int(x - start) + upto
                    out.append((int(ids[d[a]]), int(items.ids[i]), int(seeds[g]), best / (MATCH * len(own)), at - back, at))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def _block(docs: DataFrame, items: Items, shared: DataFrame, least: float) -> DataFrame:
    """`shared`: (gram, items), in how many items of the whole benchmark each n-gram is."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(items)  # about BLOCK words
    counted = docs.mapInArrow(_count(held), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    costs = settle(counted.join(shared, "gram").select("gram", (F.col("n").cast("double") * F.col("items")).alias("cost")))
    # At most the n-grams of a block.
    seeds = items.rare({r.gram: r.cost for r in costs.collect()})
    release(costs)
    held.unpersist()
    return docs.mapInArrow(_search(spark.sparkContext.broadcast(seeds), least), _RESULT)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, block: int | None = None) -> DataFrame:
    """(doc_id, item_id, n_seeds, score, start_word, end_word): the documents that hold an
    item of `benchmark` (item_id, text), and the best passage, as a range of words."""
    spark = docs.sparkSession
    prepare(spark)
    block = block or BLOCK
    docs = doc_texts(docs)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items = items.where("item_id IS NOT NULL").distinct()
    # A word takes two bytes, with what parts it from the next: so many words at most.
    size = items.agg(F.sum(F.floor(F.octet_length("text") / 2) + 1)).first()[0] or 0
    many = max(1, -(-size // block))
    shared = settle(items.select("item_id", "text").mapInArrow(_gram_rows, "gram long").groupBy("gram").agg(F.count("*").alias("items")))
    parts = []
    for b in range(many):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == b).orderBy("item_id", "text").collect()
        parts.append(_block(docs, Items([r.item_id for r in mine], [r.text for r in mine]), shared, least))
    every = reduce(DataFrame.unionByName, parts)
    best = F.max(F.struct("score", (-F.col("start_word")).alias("a"), (-F.col("end_word")).alias("b"), "n_seeds")).alias("x")
    return every.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "x.n_seeds", "x.score", (-F.col("x.a")).alias("start_word"), (-F.col("x.b")).alias("end_word")
    )
