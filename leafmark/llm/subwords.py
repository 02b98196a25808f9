"""Averaged hashed subword embeddings with a linear softmax, trained by numpy SGD.

A document is the mean of the vectors of its features, hashed into buckets, over each
kind of feature (n-grams of one length) and then over the kinds, so that word bigrams
count as much as the more numerous character n-grams; the class scores are linear in it.  Because both steps are linear, prediction needs one
small table of class scores per bucket, and a text of any length is one pass over it.

Training happens once, on a bounded sample of labelled rows: `Shape.sample` documents in
all of the `Shape.classes` most frequent labels, chosen by hash of the id, whole texts of
up to `Shape.longest` characters and `Shape.most` in all.  A label of two texts of one
doc_id is taken for the smaller text.  Scoring covers every whole text, of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmark.llm import textops as X
from leafmark.llm.common import doc_texts

U = X.U
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Shape:
    """What is hashed and how the model is fitted."""

    grams: tuple[int, ...]  # bytes in a character n-gram
    words: bool  # word unigrams and bigrams as well
    fold: bool  # lower-case first
    bits: int = 16  # buckets: 2 ** bits
    size: int = 12  # length of a vector
    epochs: int = 8
    rate: float = 0.5
    batch: int = 32
    sample: int = 4000
    longest: int = 200_000
    most: int = 64_000_000
    classes: int = 1000
    seed: int = 7


LANGUAGE = Shape(grams=(2, 3, 4), words=False, fold=True)
QUALITY = Shape(grams=(3, 4), words=True, fold=False, bits=17)


def features(texts: pa.Array, shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each kind of feature: the buckets, document by document, and offsets (n + 1)."""
    data, offsets = X.texts(pc.utf8_lower(texts) if shape.fold else texts)
    n = len(offsets) - 1
    size = np.diff(offsets)
    shift = np.uint32(32 - shape.bits)
    for gram in shape.grams:
        code = np.zeros(max(0, len(data) - gram + 1), np.uint32)
        for k in range(gram):
            code |= data[k : k + len(code)].astype(np.uint32) << np.uint32(8 * k)
        code *= np.uint32(2654435761)
        code ^= np.uint32(gram * 0x85EBCA6B & 0xFFFFFFFF)
        code *= np.uint32(0xC2B2AE35)
        many = np.maximum(size - gram + 1, 0)
        inside = np.ones(len(code), bool)
        cross = size >= gram
        if not cross.all() or n > 1:
            covered = np.zeros(len(data) + 1, np.int32)
            np.add.at(covered, offsets[:-1][cross], 1)
            np.add.at(covered, offsets[1:][cross] - gram + 1, -1)
            inside = np.cumsum(covered)[: len(code)] > 0
        at = np.zeros(n + 1, np.int64)
        np.cumsum(many, out=at[1:])
        yield (code >> shift)[inside], at
    if shape.words:
        starts, ends, doc = X.words(data, offsets)
        hashes = X.Hasher(data)(starts, ends)
        at = np.zeros(n + 1, np.int64)
        np.cumsum(X.counts(doc, n), out=at[1:])
        wide = U(64 - shape.bits)
        yield (hashes >> wide).astype(np.uint32), at
        # A bigram of one word twice is one feature, whichever word it is.
        next_in = doc[1:] == doc[:-1]
        twice = hashes[1:] == hashes[:-1]
        pair = X.mix(hashes[:-1] * U(3) + hashes[1:])
        pair[twice] = U(0x243F6A8885A308D3)
        at = np.zeros(n + 1, np.int64)
        np.cumsum(X.counts(doc[1:][next_in], n), out=at[1:])
        yield (pair[next_in] >> wide).astype(np.uint32), at


REJECTED = 0.01


@dataclass
class Model:
    """Class scores per bucket (classes x buckets), bias, softmax temperature, and the
    probability under which a prediction is less sure than all but `REJECTED` of those on
    the texts that set the temperature."""

    shape: Shape
    classes: list
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    unsure: float = 0.0
    held: dict = field(default_factory=dict)

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        sums, kinds = np.zeros((len(texts), len(self.classes))), 0
        for buckets, at in features(texts, self.shape):
            many = np.diff(at)
            some = np.flatnonzero(many)
            if len(some):
                for c in range(len(self.classes)):
                    sums[some, c] += np.add.reduceat(self.table[c][buckets], at[:-1][some], dtype=np.float64) / many[some]
            kinds += 1
        return softmax((sums / kinds + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _bags(texts: list[str], shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct buckets of each text with their shares: buckets, shares, offsets."""
    buckets, shares, sizes = [], [], []
    for start in range(0, len(texts), 64):
        some = texts[start : start + 64]
        kinds = list(features(pa.array(some, pa.string()), shape))
        for i in range(len(some)):
            own = [b[a[i] : a[i + 1]] for b, a in kinds]
            one, place = np.unique(np.concatenate(own), return_inverse=True)
            part = np.concatenate([np.full(len(b), 1 / (len(b) * len(kinds))) for b in own if len(b)]) if len(place) else np.zeros(0)
            buckets.append(one)
            shares.append(np.bincount(place, weights=part, minlength=len(one)).astype(np.float32))
            sizes.append(len(one))
    return np.concatenate(buckets) if buckets else np.zeros(0, np.uint32), np.concatenate(shares) if shares else np.zeros(0, np.float32), np.r_[0, np.cumsum(sizes)].astype(np.int64)


def fit(texts: list[str], labels: list, shape: Shape) -> Model:
    """SGD over whole texts and one short excerpt of each (so that short texts are scored
    as well as long ones); a fifth of the texts is kept to set the temperature."""
    rng = np.random.default_rng(shape.seed)
    classes = sorted(set(labels))
    if len(classes) < 2:  # nothing to tell apart
        classes = classes or [0]
        return Model(shape, classes, np.zeros((len(classes), 1 << shape.bits), np.float32), np.zeros(len(classes)))
    cut = []
    for text in texts:
        words = text.split()
        a = int(rng.integers(0, max(1, len(words))))
        cut.append(" ".join(words[a : a + int(rng.integers(3, 40))]))
    y = np.array([classes.index(v) for v in labels] * 2)
    buckets, shares, at = _bags(texts + cut, shape)
    share = np.bincount(y, minlength=len(classes)) / len(y)
    weight = 1 / (len(classes) * np.maximum(share, 1e-9))[y]
    keep = np.arange(len(y)) % len(texts) % 5 != 0

    def train(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vectors = rng.normal(0, 0.1, (1 << shape.bits, shape.size)).astype(np.float32)
        out = rng.normal(0, 0.3, (shape.size, len(classes))).astype(np.float32)
        bias = np.zeros(len(classes), np.float32)
        squares = np.full((1 << shape.bits), 1e-6, np.float32)
        steps = shape.epochs * -(-len(rows) // shape.batch)
        step = 0
        for _ in range(shape.epochs):
            order = rng.permutation(rows)
            for s in range(0, len(order), shape.batch):
                some = order[s : s + shape.batch]
                spans = [np.arange(at[i], at[i + 1]) for i in some]
                own = np.concatenate(spans)
                row = np.repeat(np.arange(len(some)), [len(x) for x in spans])
                b, w = buckets[own], shares[own]
                mean = np.zeros((len(some), shape.size), np.float32)
                filled = np.flatnonzero([len(x) for x in spans])
                starts = np.r_[0, np.cumsum([len(x) for x in spans])][:-1][filled]
                if len(filled):
                    mean[filled] = np.add.reduceat(vectors[b] * w[:, None], starts)
                error = softmax(mean @ out + bias)
                error[np.arange(len(some)), y[some]] -= 1
                error = (error * weight[some][:, None]).astype(np.float32)
                back = error @ out.T
                rate = shape.rate * (1 - step / steps)
                out -= rate * mean.T @ error / len(some)
                bias -= rate * error.mean(axis=0)
                one, inverse = np.unique(b, return_inverse=True)
                change = np.zeros((len(one), shape.size), np.float32)
                for d in range(shape.size):
                    change[:, d] = np.bincount(inverse, weights=back[row, d] * w, minlength=len(one))
                squares[one] += (change**2).mean(axis=1)
                vectors[one] -= rate * change / np.sqrt(squares[one])[:, None]
                step += 1
        return (vectors @ out).T.copy(), bias.astype(np.float64)

    table, bias = train(np.flatnonzero(keep))
    held = np.flatnonzero(~keep)
    logits = np.array([(table[:, buckets[at[i] : at[i + 1]]] * shares[at[i] : at[i + 1]]).sum(axis=1) for i in held]) + bias
    options = np.geomspace(0.25, 8, 41)
    loss = [-(np.log(softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12)).mean() for t in options]
    info = {"accuracy": float((logits.argmax(axis=1) == y[held]).mean()), "rows": len(texts)}
    temperature = float(options[int(np.argmin(loss))])
    unsure = float(np.quantile(softmax(logits / temperature).max(axis=1), REJECTED))
    return Model(shape, classes, table, bias, temperature, unsure, info)


def in_fold(column: str, folds: int, fold: int):
    """Whether crc32 of the id as text, modulo `folds`, is `fold`."""
    return (F.crc32(F.col(column).cast("string").cast("binary")) % folds) == fold


def sampled(docs: DataFrame, labels: DataFrame, shape: Shape) -> tuple[list[str], list]:
    """Texts and labels of at most `shape.sample` rows of `labels` (doc_id, label) and
    `shape.most` characters, as many of each label, taken in the order of the id's hash."""
    known = labels.where("label IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "label")
    known = known.distinct()
    often = known.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(shape.classes)
    totals = {r.label: r.n for r in often.collect()}
    if not totals:
        return [], []
    most = max(1, shape.sample // len(totals))
    # Twice as many as needed go by their hash alone, without a sort; the window then
    # takes exactly `most` of each label from these few.
    part = F.create_map(*(F.lit(x) for label, n in totals.items() for x in (label, min(1.0, (2.0 * most + 50) / n))))
    few = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30) < F.element_at(part, F.col("label")))
    by_hash = Window.partitionBy("label").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id")
    chosen = few.withColumn("nth", F.row_number().over(by_hash)).where(F.col("nth") <= most)
    # At most `shape.sample` ids, so small enough to broadcast.
    texts = doc_texts(docs).where(F.length("text") <= shape.longest)
    found = texts.join(F.broadcast(chosen.drop("nth")), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    so_far = F.sum(F.length("text")).over(by_hash.rowsBetween(Window.unboundedPreceding, 0))
    rows = found.withColumn("so_far", so_far).where(F.col("so_far") <= max(1, shape.most // len(totals))).select("doc_id", "label", "text").collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return [r.text for r in rows], [r.label for r in rows]


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, label, scores, letters): the likeliest class of every whole text, the
    calibrated probabilities in the order of `model.classes`, and whether the text has a letter."""
    kind = "string" if isinstance(model.classes[0], str) else "long"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, set by Shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for piece in X.pieces(batches):
            p = model.probabilities(piece.column(1))
            letters = [bool(_LETTER.search(t)) for t in piece.column(1).to_pylist()]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.reshape(-1)))
            names = [model.classes[i] for i in p.argmax(axis=1)]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(names, pa.string() if kind == "string" else pa.int64()), flat, pa.array(letters)],
                names=["doc_id", "label", "scores", "letters"],
            )

    return doc_texts(docs).mapInArrow(run, f"doc_id long, label {kind}, scores array<double>, letters boolean")
