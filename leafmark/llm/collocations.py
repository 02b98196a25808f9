"""Word phrases that stand together more often than their parts would by chance, by language.

Counting every phrase exactly would shuffle most of the text several times, so phrases are
narrowed down first:

1. Sketch.  Every phrase of a language has a cell; a cell holds the sum of all phrases that
   share it, which is never less than any one of them.  Cells are counted in numpy within a
   task and travel as sorted vectors, dealt by their first bits; those that reach the least
   count go to the next step as a bitmap of fixed size, whose wrong hits let more through
   and never less.  Words come first, then pairs whose words can reach it, then longer
   phrases whose pairs all can.
2. Stretches.  One more pass takes the longest phrase that may be frequent at each place, and
   the word there by itself; equal ones of a task are counted once, exactly, by their bytes.
   They are dealt by their first two words (or their word) into about as many deals as the
   heavy cells have blocks of `block` bytes.
3. Counts.  A task holds one deal of a language at a time.  Its phrases, which are the
   beginnings of its stretches, compile into an Aho-Corasick automaton that reads each
   distinct stretch once.  A phrase is matched where a stretch begins: wherever else it
   occurs, another stretch begins.  So the sums are the exact counts.
4. Thresholds, scores and containment are plans on these counts, which are few.

So sketches decide what is looked at, not what comes out: with any `cells` and `bits` the
result is the same.  The texts are read four times whatever the number of phrases, and no
step gathers a language, a phrase or its places; a task holds a bitmap for words, pairs and
longer phrases each, and one deal.

Null texts are empty; a null language is `und`.  Rows without a doc_id count as all others,
as do repeated rows.  A phrase never crosses one of `SIGNS` or a document.  Texts and words
of any length are taken whole.  Columns other than text and lang are ignored, whatever
their names.  Empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmark.llm import textops as X
from leafmark.llm.common import prepare, release, settle

U = np.uint64
SIGNS = ".,;:!?\n\x0b\x0c\r"
UNKNOWN = "und"
LONGEST = 5
#: Cells that a task gathers before it counts them.
_GATHERED = 1 << 21
#: Bytes of stretches that a task gathers before equal ones are added up.
_HELD = 32 << 20
#: Stretches whose bytes are taken from a text at once.
_AT_ONCE = 1 << 17
#: Cells are dealt by so many of their first bits.
_DEALT = 10
#: Bytes of a phrase, for the number of deals.
_USUAL = 16

#: A-Z lowered, signs as line feeds, tabs as spaces.
_PLAIN = bytes(10 if chr(b) in SIGNS else 32 if b == 9 else int(X.LOWER[b]) for b in range(256))


class Sketch(NamedTuple):
    """Sizes as powers of two: cells of the sketch, bits of a bitmap of cells."""

    cells: int = 56
    bits: int = 26

    def cell(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> U(64 - self.cells)

    def places(self, cells: np.ndarray) -> list[np.ndarray]:
        """The three bits of each cell."""
        return [X.mix(cells + U(k << 60)) >> U(64 - self.bits) for k in (1, 2, 3)]

    def holds(self, bitmap: bytes, cells: np.ndarray) -> np.ndarray:
        """Whether these cells are in the map; one that is never misses."""
        words, found = np.frombuffer(bitmap, U), np.ones(len(cells), bool)
        for bit in self.places(cells):
            found &= (words[(bit >> U(6)).astype(np.int64)] >> (bit & U(63)) & U(1)).astype(bool)
        return found


class Phrases:
    """The phrases in a batch of (lang, text), and which of them may be frequent: `maps` has
    the bitmaps of words (1), pairs (2) and longer phrases (3) as far as they are known."""

    def __init__(self, batch: pa.RecordBatch, sketch: Sketch, maps: dict[int, Broadcast]):
        self.sketch, self.maps = sketch, maps
        raw, at = X.texts(batch.column(1))
        self.data = np.frombuffer(raw.tobytes().translate(_PLAIN), np.uint8)
        sign = self.data == 10
        self.starts, self.ends, self.doc = X.tokens(sign | (self.data == 32), at)
        n = len(self.starts)
        joined = np.zeros(n, bool)  # with the next word
        joined[:-1] = self.doc[1:] == self.doc[:-1]
        after = np.searchsorted(self.starts, np.flatnonzero(sign))
        joined[after[after > 0] - 1] = False
        last = np.flatnonzero(~joined)
        self.left = np.repeat(last, np.diff(last, prepend=-1)) - np.arange(n) + 1
        langs = batch.column(0).to_pylist()
        self.seed = X.mix(np.array([zlib.crc32((x or UNKNOWN).encode()) for x in langs], U))[self.doc]
        self.words = X.Hasher(self.data)(self.starts, self.ends)
        self._found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def found(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases of `size` words begin that may be frequent, and their hashes."""
        if size not in self._found:
            at = np.flatnonzero(self.left >= size)
            if size > 1:
                part = 1 if size == 2 else 2
                begins = np.zeros(len(self.words), bool)
                begins[self.found(part)[0]] = True
                for k in range(size - part + 1):
                    at = at[begins[at + k]]
            hashes = self.seed[at] + U(size)
            for k in range(size):
                hashes = X.mix(hashes) + self.words[at + k]
            hashes = X.mix(hashes)
            if own := self.maps.get(min(size, 3)):
                good = self.sketch.holds(own.value, self.sketch.cell(hashes))
                at, hashes = at[good], hashes[good]
            self._found[size] = at, hashes
        return self._found[size]

    def stretches(self) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """Each word that may be frequent, and each place's longest phrase that may be: bytes
        with one space between words, the documents, and the hashes by which they are dealt:
        the word's, or that of the first two words.  So many at a time."""
        single, own = self.found(1)
        several, first = self.found(2)
        size = np.ones(len(self.words), np.int64)
        for k in range(2, LONGEST + 1):
            size[self.found(k)[0]] = k
        length = self.ends - self.starts
        ends = np.cumsum(length + 1) - 1
        text = np.full(len(ends) + length.sum(), 32, np.uint8)
        letter = np.ones(len(text), bool)
        letter[ends] = False
        text[letter] = self.data[(self.data != 10) & (self.data != 32)]
        begins, hashes = np.concatenate([single, several]), np.concatenate([own, first])
        start, end = (ends - length)[begins], ends[np.concatenate([single, several + size[several] - 1])]
        for k in range(0, len(begins), _AT_ONCE):
            part = slice(k, k + _AT_ONCE)
            offsets = np.concatenate([[0], np.cumsum(end[part] - start[part])])
            taken = text[np.repeat(start[part] - offsets[:-1], np.diff(offsets)) + np.arange(offsets[-1])]
            yield _strings(taken, offsets), self.doc[begins[part]], hashes[part]


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The values between bounds as binary cells."""
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.concatenate([np.flatnonzero(np.diff(values, prepend=values[:1] + 1)), [len(values)]])


def _sketched(texts: DataFrame, sizes: list[int], least: int, sketch: Sketch, maps: dict[int, Broadcast]) -> DataFrame:
    """(cell): the cells of phrases of these sizes that reach `least` over all tasks."""
    shift = U(max(0, sketch.cells - _DEALT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            cells = np.sort(np.concatenate(gathered))
            gathered.clear()
            first = _runs(cells)
            cells, n = cells[first[:-1]], np.diff(first).astype(np.int32)
            deal = cells >> shift
            bounds = _runs(deal)
            return pa.RecordBatch.from_arrays([pa.array(deal[bounds[:-1]].astype(np.int32)), _packed(cells, bounds), _packed(n, bounds)], names=["deal", "cells", "counts"])

        for part in X.pieces(batches):
            p = Phrases(part, sketch, maps)
            for size in sizes:
                cells = sketch.cell(p.found(size)[1])
                for k in range(0, len(cells), _GATHERED):
                    gathered.append(cells[k : k + _GATHERED])
                    if sum(map(len, gathered)) >= _GATHERED:
                        yield counted()
        if gathered:
            yield counted()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_key(batches, 1):
            _, cells, n = zip(*rows, strict=True)
            cells, n = np.frombuffer(b"".join(cells), U), np.frombuffer(b"".join(n), np.int32).astype(np.int64)
            order = np.argsort(cells)
            cells, n = cells[order], n[order]
            first = _runs(cells)[:-1]
            yield pa.RecordBatch.from_arrays([X.longs(cells[first][np.add.reduceat(n, first) >= least])], names=["cell"])

    dealt = texts.mapInArrow(run, "deal int, cells binary, counts binary").repartition("deal").sortWithinPartitions("deal")
    return dealt.mapInArrow(add, "cell long")


def _by_key(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows that agree in the first `width` columns, one row at a time."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    return groupby(rows, key=lambda r: r[:width])


def _bitmap(cells: DataFrame, sketch: Sketch) -> Broadcast:
    """The bitmap of (cell) on all executors.  Tasks set bits, their words of 64 bits meet in
    a grouped `or`, and at most 2**(bits - 6) of those come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.unique(np.concatenate(sketch.places(batch.column(0).to_numpy().view(U))))
            word, first = np.unique(bit >> U(6), return_index=True)
            bits = np.bitwise_or.reduceat(U(1) << (bit & U(63)), first) if len(bit) else np.zeros(0, U)
            yield pa.RecordBatch.from_arrays([X.longs(word), X.longs(bits)], names=["word", "bits"])

    found = cells.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << max(0, sketch.bits - 6), U)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(U)
    return cells.sparkSession.sparkContext.broadcast(out.tobytes())


def _stretches(texts: DataFrame, deals: int, sketch: Sketch, maps: dict[int, Broadcast]) -> DataFrame:
    """(lang, deal, bytes, lengths, counts): the distinct stretches among those gathered in a
    task, those of a language and deal in one row; deal -1 has the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        names: dict[str, int] = {}
        gathered: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        for part in X.pieces(batches):
            p = Phrases(part, sketch, maps)
            langs = part.column(0).to_pylist()
            own = np.array([names.setdefault(x, len(names)) for x in langs], np.int64)
            for lang, n in zip(langs, np.bincount(p.doc, minlength=len(langs)).tolist(), strict=True):
                total[lang] += n
            for text, doc, hashes in p.stretches():
                gathered.append((text, own[doc], (hashes % U(deals)).astype(np.int32)))
                if sum(x.nbytes for x, _, _ in gathered) > _HELD:
                    yield packed(gathered, list(names))
                    gathered.clear()
        if gathered:
            yield packed(gathered, list(names))
        rows = [(lang, -1, b"", b"", np.int64(n).tobytes()) for lang, n in total.items() if n]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ROW)], schema=_ROW)

    def packed(gathered: list[tuple[pa.Array, np.ndarray, np.ndarray]], names: list[str]) -> pa.RecordBatch:
        texts, langs, deal = zip(*gathered, strict=True)
        told, langs = pa.concat_arrays(texts).dictionary_encode(), np.concatenate(langs)
        both = pa.array(told.indices.to_numpy() * np.int64(len(names)) + langs).dictionary_encode()
        at, of = both.indices.to_numpy(), both.dictionary.to_numpy()
        n = np.bincount(at, minlength=len(of))
        dealt = np.zeros(len(of), np.int64)
        dealt[at] = langs * deals + np.concatenate(deal)
        order = np.argsort(dealt)
        dealt = dealt[order]
        bounds = _runs(dealt)
        data, ends = X.texts(told.dictionary.take(pa.array(of[order] // len(names))))
        columns = [
            pa.array([names[k // deals] for k in dealt[bounds[:-1]].tolist()], pa.string()),
            pa.array((dealt[bounds[:-1]] % deals).astype(np.int32)),
            _packed(data, ends[bounds]),
            _packed(np.diff(ends).astype(np.int32), bounds),
            _packed(n[order], bounds),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=_ROW)

    return texts.mapInArrow(run, "lang string, deal int, bytes binary, lengths binary, counts binary")


_ROW = pa.schema([("lang", pa.string()), ("deal", pa.int32()), ("bytes", pa.binary()), ("lengths", pa.binary()), ("counts", pa.binary())])


def _phrases(stretch: str) -> Iterator[str]:
    """The phrases that a stretch counts for, as they are matched: its beginnings of two
    words and more, or its only word."""
    at = stretch.find(" ")
    if at < 0:
        yield f"\n{stretch}\n"
    while at >= 0:
        at = stretch.find(" ", at + 1)
        yield f"\n{stretch[:at] if at >= 0 else stretch} "


def _matched(stretches: list[str], n: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The phrases of distinct stretches, and how often they occur: `n` has the number of
    times of each stretch."""
    import ahocorasick

    automaton, known = ahocorasick.Automaton(ahocorasick.STORE_INTS), {}
    for stretch in stretches:
        for phrase in _phrases(stretch):
            if phrase not in known:
                automaton.add_word(phrase, len(known))
                known[phrase] = len(known)
    automaton.make_automaton()
    lines = [f"\n{x} \n" if " " in x else f"\n{x}\n" for x in stretches]
    ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))
    hits = np.fromiter(chain.from_iterable(automaton.iter("".join(lines))), np.int64).reshape(-1, 2)
    sums = np.zeros(len(known), np.int64)
    np.add.at(sums, hits[:, 1], n[np.searchsorted(ends, hits[:, 0], "right")])
    return [x[1:-1] for x in known], sums


def _summed(texts: list[pa.Array], times: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """The distinct texts, and the sum of the times of each."""
    told = pa.concat_arrays(texts).dictionary_encode()
    sums = np.zeros(len(told.dictionary), np.int64)
    np.add.at(sums, told.indices.to_numpy(), np.concatenate(times))
    return told.dictionary, sums


def _counted(stretches: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, n): the phrases that occur at least `least` times in their language,
    and the number of all its words as the null phrase."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lang, deal), rows in _by_key(batches, 2):
            if deal < 0:
                own, n = [None], np.array([sum(int(np.frombuffer(r[4], np.int64)[0]) for r in rows)])
            else:
                texts, times, held, most = [], [], 0, _HELD
                for _, _, data, lengths, counts in rows:
                    at = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, np.int32), dtype=np.int64)])
                    texts.append(_strings(np.frombuffer(data, np.uint8), at))
                    times.append(np.frombuffer(counts, np.int64))
                    held += len(data)
                    if held > most:
                        texts, times = ([x] for x in _summed(texts, times))
                        held = texts[0].nbytes
                        most = max(_HELD, 2 * held)
                text, times = _summed(texts, times)
                own, n = _matched([x.decode() for x in text.to_pylist()], times)
                often = np.flatnonzero(n >= least)
                own, n = [own[i] for i in often.tolist()], n[often]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own, pa.string()), pa.array(n)], names=["lang", "phrase", "n"])

    return stretches.repartition("lang", "deal").sortWithinPartitions("lang", "deal").mapInArrow(add, "lang string, phrase string, n long")


def phrase_counts(docs: DataFrame, least: int = 100, sketch: Sketch = Sketch(), block: int = 1 << 17) -> DataFrame:
    """(lang, phrase, n): exact counts of all phrases of up to five words that occur at
    least `least` times in their language, and of all its words (the null phrase)."""
    prepare(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    maps: dict[int, Broadcast] = {}
    many = 0
    for size in (1, 2, 3):
        sizes = [size] if size < 3 else list(range(3, LONGEST + 1))
        heavy = settle(_sketched(texts, sizes, least, sketch, dict(maps)))
        maps[size] = _bitmap(heavy, sketch)
        many += heavy.count()
        release(heavy)
    deals = max(1, -(-many * _USUAL // block))
    counts = settle(_counted(_stretches(texts, deals, sketch, maps), least))
    for of in maps.values():
        of.unpersist()
    return counts


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, sketch: Sketch = Sketch(), block: int = 1 << 17) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of two
    to five words.  A phrase scores as its weakest cut in two: 1000 * a * n over the product
    of the counts l and r of its parts.  Phrases that never occur but within a longer one are
    left out."""
    counts = phrase_counts(docs, least, sketch, block)
    total = counts.where("phrase IS NULL").select("lang", "n")
    known = counts.where("phrase IS NOT NULL").withColumn("words", F.split("phrase", " "))
    several = known.where(F.size("words") > 1)
    part = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    k, rest = F.col("k"), F.size("words") - F.col("k")
    cuts = several.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("n").alias("a"), "k", part(F.lit(1), k).alias("head"), part(k + 1, rest).alias("tail"))
    # A part is at least as frequent as its phrase, so its count is known.
    heads = known.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    tails = known.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    cuts = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(total, "lang")
    wide = lambda c, digits=19: F.col(c).cast(f"decimal({digits},0)")
    cuts = cuts.withColumn("product", wide("a") * wide("n") * F.lit(1000)).withColumn("expected", wide("l") * wide("r"))
    cuts = cuts.withColumn("score", F.expr("product div expected"))
    weakest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut"))
    # One word less in front or behind is enough: every phrase between has the count of both.
    shorter = several.where(F.size("words") > 2).select("lang", F.explode(F.array(part(F.lit(1), F.size("words") - 1), part(F.lit(2), F.size("words") - 1))).alias("phrase"), F.col("n").alias("longer"))
    within = shorter.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = weakest.join(within, ["lang", "phrase"], "left").where("longer IS NULL OR longer < cut.a").select("lang", "phrase", "cut.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle_sql(least: int = 100, top: int = 2000) -> str:
    """The same result by counting every phrase, in DuckDB."""
    return f"""WITH pieces AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM pieces),
total AS (SELECT lang, sum(len(ws)) AS n FROM worded GROUP BY lang),
placed AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM worded),
sized AS (SELECT lang, ws, i, unnest(range(1, least({LONGEST}, len(ws) - i + 1) + 1)) AS k FROM placed),
counted AS (SELECT lang, ws[i:i + k - 1] AS ws, count(*) AS f FROM sized GROUP BY 1, 2 HAVING count(*) >= {least}),
cuts AS (SELECT lang, ws, f, unnest(range(1, len(ws))) AS k FROM counted),
scored AS (
  SELECT c.lang, c.ws, min({{'score': 1000::HUGEINT * c.f * t.n // (h.f::HUGEINT * r.f), 'k': c.k, 'l': h.f, 'r': r.f, 'n': t.n}}) AS cut, any_value(c.f) AS a
  FROM cuts c JOIN total t ON t.lang = c.lang JOIN counted h ON h.lang = c.lang AND h.ws = c.ws[1:c.k] JOIN counted r ON r.lang = c.lang AND r.ws = c.ws[c.k + 1:] GROUP BY 1, 2),
parts AS (SELECT lang, ws, f, unnest(range(2, len(ws))) AS k FROM counted),
inside AS (SELECT lang, ws, f, k, unnest(range(1, len(ws) - k + 2)) AS i FROM parts),
longer AS (SELECT lang, ws[i:i + k - 1] AS ws, max(f) AS f FROM inside GROUP BY 1, 2),
kept AS (SELECT s.* FROM scored s LEFT JOIN longer g ON g.lang = s.lang AND g.ws = s.ws WHERE g.f IS NULL OR 100 * g.f < 100 * s.a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY cut.score DESC, a DESC, array_to_string(ws, ' ')) AS rank, array_to_string(ws, ' ') AS phrase, a, cut FROM kept)
SELECT lang, rank, phrase, a, cut.l AS l, cut.r AS r, CAST(cut.n AS BIGINT) AS n, CAST(cut.score AS BIGINT) AS score FROM ranked WHERE rank <= {top}"""
