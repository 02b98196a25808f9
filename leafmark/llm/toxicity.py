"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

The lexicon is learned from labelled rows: words, and word beginnings (stems), that
toxic documents have much more often than clean ones.  Scoring reads every whole text:

1. a word that could be within one edit of a term keeps the first or the second half of
   that term, so a table of three-byte beginnings and endings lets most words go by;
2. each of the rest, once per worker, is turned into a bit-parallel Levenshtein
   automaton that is intersected with the trie of terms;
3. each hit is weighed by its context window: inside quotation marks or after words of
   report it is likely a mention, next to words of address it is likely abuse; what
   share of a hit's evidence each kind of window leaves is learned from the labels;
4. a logistic function of the weighed evidence gives the score.

Null texts are empty texts, which have no hit and get the lowest evidence.  Words of any
length are searched.  Of several terms that fit a word an exact one wins, then a stem,
then the smallest of those within one edit.  With no labels of both kinds nothing can be
learned and the score is the share of label 1 (0.5 without labels).  Empty tables give no
rows; repeated rows each get their row; rows without a doc_id are left out; columns other
than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm import subwords
from leafmark.llm import textops as X
from leafmark.llm.common import doc_texts, prepare

#: The fit's bound: so many labelled documents at most, half of each label.
SAMPLE = subwords.Shape(grams=(), words=False, fold=True, sample=4000)
WINDOW = 80  # bytes of context on either side
MEMO = 100_000  # words whose result a worker remembers
SURE = 0.0  # by how much twice a log likelihood ratio must pass what chance reaches about once among all candidates
FUZZY_FROM = 5  # terms of so many characters may be misspelled by one edit
#: Words of report and of address in the four languages of the corpus.
REPORT = "said says called word words term quote quoted wrote sagte nannte wort zitat dit mot appelé cité dijo palabra llamó cita".split()
ADDRESS = "you your you're u are du dein deine bist ihr tu te toi vous votre es tú eres usted".split()
#: What share of a hit's evidence a window leaves, before labels are seen: the values that
#: may be learned, and how strongly the fit holds to the one given first.
WINDOWS = {"quoted": 0.35, "reported": 0.5, "addressed": 1.25}
SHARES = (0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.25, 1.5)
HOLD = 1.0
_OPEN = regex.compile(r"[\"“„«‘][^\"”»’\n]{0,60}$")
_CLOSE = regex.compile(r"^[^\"“„«‘\n]{0,60}[\"”»’]")
_WORD = regex.compile(r"[\p{L}\p{N}@]+")


class Trie:
    """Terms by character; a stem's node accepts any continuation."""

    def __init__(self, terms: list[str], stems: list[str], fuzzy: list[str]):
        self.root: dict = {}
        for kind, names in (("word", terms), ("stem", stems), ("fuzzy", fuzzy)):
            for name in names:
                node = self.root
                for c in name:
                    node = node.setdefault(c, {})
                node.setdefault("", {})[kind] = name
        self.starts, self.stops = {t[: len(t) // 2] for t in fuzzy}, {t[len(t) // 2 :] for t in fuzzy}
        self.sizes = {len(h) for h in self.starts}, {len(h) for h in self.stops}
        self.most = max(map(len, [*terms, *stems, *fuzzy]), default=0)

    def find(self, word: str) -> tuple[str, str] | None:
        """(kind, term): an exact term, else a stem that begins the word, else a fuzzy term
        within one edit; ties go to the smaller term."""
        node, stem = self.root, None
        for c in word:
            node = node.get(c)
            if node is None:
                break
            stem = node.get("", {}).get("stem", stem)
        if node is not None and "word" in node.get("", {}):
            return "word", node[""]["word"]
        if stem is not None:
            return "stem", stem
        close = self.close(word)
        return ("fuzzy", min(close)) if close else None

    def close(self, word: str) -> tuple[str, ...]:
        """As `within_one`, for which one half of the term must be kept."""
        if not FUZZY_FROM - 1 <= len(word) <= self.most + 1:
            return ()
        may = any(word[:k] in self.starts for k in self.sizes[0]) or any(word[-k:] in self.stops for k in self.sizes[1])
        return tuple(self.within_one(word)) if may else ()

    def within_one(self, word: str) -> list[str]:
        """All fuzzy terms within one edit of `word`: its Levenshtein automaton (a
        bit for each position and number of errors) walks down the trie, and a branch
        ends when no state is alive."""
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i + 1
        accept, found = 1 << len(word), []
        todo = [(self.root, 1, 0b11, 0)]  # node, states without and with one error, depth
        while todo:
            node, r0, r1, depth = todo.pop()
            if depth >= FUZZY_FROM and (r0 | r1) & accept and "fuzzy" in node.get("", {}):
                found.append(node[""]["fuzzy"])
            for c, child in node.items():
                if c:
                    m = masks.get(c, 0)
                    s0 = r0 << 1 & m
                    s1 = (r1 << 1 & m | r0 | r0 << 1 | s0 << 1 | s0) & (accept << 1) - 1
                    if s1:
                        todo.append((child, s0, s1, depth + 1))
        return found


_built: dict[str, Lexicon] = {}


@dataclass
class Lexicon:
    words: dict[str, float]  # evidence of an exact hit, in nats
    stems: dict[str, float]
    fuzzy: dict[str, float]
    weights: np.ndarray
    windows: dict[str, float] = field(default_factory=lambda: dict(WINDOWS))
    only: float | None = None  # the score of all if nothing could be learned

    def __post_init__(self) -> None:
        self.trie = Trie(sorted(self.words), sorted(self.stems), sorted(self.fuzzy))
        start, stop = np.zeros(1 << 24, bool), np.zeros(1 << 24, bool)
        for name in {*self.words, *self.stems}:
            _allow(start, name.encode()[:3], False)
        for name in self.fuzzy:
            half = len(name) // 2
            _allow(start, name[:half].encode()[:3], False)
            _allow(stop, name[half:].encode()[-3:], True)
        # A bit each, 2 MB a table.
        self.start, self.stop = np.packbits(start), np.packbits(stop)
        self.memo: dict[int, tuple[str, str] | None] = {}

    def window(self, kinds: tuple[str, ...]) -> float:
        """The share of a hit's evidence that its window leaves."""
        return math.prod(self.windows[k] for k in kinds)


def _among(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (table[codes >> 3] >> (7 - (codes & 7)).astype(np.uint8) & 1).astype(bool)


def _allow(codes: np.ndarray, part: bytes, ending: bool) -> None:
    """Mark all three-byte codes that start (or end) with `part`."""
    view = codes.reshape(256, 256, 256)
    free = (slice(None),) * (3 - len(part))
    view[(*free, *part) if ending else (*part, *free)] = True


#: A hit: its text, how the term was found, the term, the kinds of its window.
Hit = tuple[int, str, str, tuple[str, ...]]


def hits(texts: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, list[Hit]]:
    """Words in each text, and the hits."""
    data, offsets = X.texts(pc.utf8_lower(texts))
    starts, ends, doc = X.tokens(X.sign_breaks(data), offsets)
    many = X.counts(doc, len(offsets) - 1)
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
    head = padded[starts] << 16 | padded[starts + 1] << 8 | padded[starts + 2]
    tail = padded[np.maximum(ends - 3, 0)] << 16 | padded[np.maximum(ends - 2, 0)] << 8 | padded[ends - 1]
    maybe = np.flatnonzero(_among(lexicon.start, head) | _among(lexicon.stop, tail))
    found = []
    if len(maybe):
        keys = X.Hasher(data)(starts[maybe], ends[maybe])
        unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        memo = lexicon.memo
        if len(memo) > MEMO:
            memo.clear()
        # A longer word is no term and near none; its beginning tells whether it has a stem.
        most = 4 * (lexicon.trie.most + 2)
        good = np.zeros(len(unique), bool)
        for i, key in enumerate(unique.tolist()):
            if key not in memo:
                at = maybe[first[i]]
                memo[key] = lexicon.trie.find(data[starts[at] : min(ends[at], starts[at] + most)].tobytes().decode(errors="replace"))
            good[i] = memo[key] is not None
        for n in np.flatnonzero(good[inverse]):
            at, d = maybe[n], doc[maybe[n]]
            kind, term = memo[int(unique[inverse[n]])]
            before = data[max(offsets[d], starts[at] - WINDOW) : starts[at]].tobytes().decode(errors="ignore")
            after = data[ends[at] : min(offsets[d + 1], ends[at] + WINDOW)].tobytes().decode(errors="ignore")
            found.append((int(d), kind, term, context(before, after)))
    return many, found


def context(before: str, after: str) -> tuple[str, ...]:
    """The kinds of a hit's window: in quotation marks or else after a word of report
    (likely a mention), and next to a word of address (likely abuse)."""
    kinds = []
    near = _WORD.findall(before)[-4:]
    if _OPEN.search(before) and _CLOSE.search(after):
        kinds.append("quoted")
    elif any(w in REPORT for w in near):
        kinds.append("reported")
    if any(w in ADDRESS for w in near[-2:] + _WORD.findall(after)[:2]):
        kinds.append("addressed")
    return tuple(kinds)


def _evidence(lexicon: Lexicon, many: np.ndarray, found: list[Hit]) -> np.ndarray:
    """Of each text: bias, evidence of words and of stems, number of hits, length, and
    the stem hits for the length."""
    best: dict[tuple[int, str, str], float] = {}
    count = np.zeros((len(many), 2))
    for d, kind, term, kinds in found:
        weight = lexicon.window(kinds)
        best[d, kind, term] = max(best.get((d, kind, term), 0), weight)
        count[d, int(kind == "stem")] += weight
    out = np.zeros((len(many), 7))
    out[:, 0] = 1
    for (d, kind, term), weight in best.items():
        table = {"word": lexicon.words, "stem": lexicon.stems, "fuzzy": lexicon.fuzzy}[kind]
        out[d, 2 if kind == "stem" else 1] += weight * table.get(term, 0.0)
    out[:, 1:3] = np.minimum(out[:, 1:3], 12) / 4
    out[:, 3] = np.log1p(count.sum(axis=1))
    out[:, 4] = np.log1p(many) / 8
    out[:, 5] = np.log1p(count[:, 1] * 200 / np.maximum(many, 20))
    out[:, 6] = count.sum(axis=1) > 0
    return out


def train(docs: DataFrame, labels: DataFrame, bound: subwords.Shape = SAMPLE) -> Lexicon:
    """A lexicon and weights from the 0/1 column `label` of `labels` (doc_id, label)."""
    prepare(docs.sparkSession)
    known = labels.select("doc_id", F.col("label").cast("int").alias("label")).where("label IN (0, 1)")
    totals = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    texts, names = subwords.sampled(docs, known, bound)
    return learn(texts, [int(x) for x in names], totals)


def learn(texts: list[str], labels: list[int], totals: dict[int, int]) -> Lexicon:
    y = np.array(labels)
    share = totals.get(1, 0) / max(1, sum(totals.values())) if totals else 0.5
    if len(set(labels)) < 2:
        return Lexicon({}, {}, {}, np.zeros(7), only=share)  # nothing to tell apart
    whole, begin = {0: Counter(), 1: Counter()}, {0: Counter(), 1: Counter()}
    bags, families = [], set()
    n = {0: 0, 1: 0}
    for text, label in zip(texts, labels, strict=True):
        bag = set(_WORD.findall(text.lower()))
        # Copies tell no more than one text does: of documents that share two of three
        # least hashes of their longer words, one counts.
        rare = [zlib.crc32(w.encode()) for w in bag if len(w) > 6]
        marks = {(k, min(h * (2 * k + 1) * 2654435761 % (1 << 32) for h in rare)) for k in range(3)} if len(rare) > 5 else {(9, text)}
        if len(marks & families) >= min(2, len(marks)):
            continue
        families |= marks
        n[label] += 1
        bags.append((bag, label))
        whole[label].update(bag)
        begin[label].update({w[:k] for w in bag for k in range(3, min(9, len(w)))})

    def evidence(t: int, c: int) -> float:
        return math.log((t + 0.5) / (n[1] + 1)) - math.log((c + 0.5) / (n[0] + 1))

    chance = 2 * math.log(max(1, len(begin[1])))

    def sure(t: int, c: int) -> bool:
        """Whether such a split is no chance among very many words (likelihood ratio test)."""
        share = n[1] / max(1, n[0] + n[1])
        expected = ((t + c) * share, (t + c) * (1 - share))
        return evidence(t, c) >= 2.3 and 2 * sum(k * math.log(k / e) for k, e in zip((t, c), expected, strict=True) if k) >= chance + SURE

    stems: dict[str, float] = {}
    for name in sorted((s for s, t in begin[1].items() if sure(t, begin[0][s])), key=lambda s: (len(s), s)):
        # The shortest beginning that tells, unless a longer one tells much better.
        shorter = max((stems[name[:k]] for k in range(3, len(name)) if name[:k] in stems), default=0)
        if evidence(begin[1][name], begin[0][name]) > shorter + 1.5:
            stems[name] = evidence(begin[1][name], begin[0][name])
    words = {w: e for w, t in whole[1].items() if len(w) >= 3 and sure(t, whole[0][w]) and (e := evidence(t, whole[0][w]))}
    own = lambda w: begin[1][w[: max(3, len(w) - 2)]] <= 1.5 * whole[1][w]  # noqa: E731  a word of its own, not one of a stem's many
    stems = {s: e for s, e in stems.items() if not any(w.startswith(s) and whole[1][w] >= 0.7 * begin[1][s] for w in words)}
    words = {w: e for w, e in words.items() if not any(w.startswith(s) for s in stems)}
    long = sorted(w for w in words if len(w) >= FUZZY_FROM and own(w))
    near = Trie([], [], long)
    near_to = lru_cache(maxsize=1 << 18)(near.close)

    close: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for bag, label in bags:
        hit = set()
        for w in bag:
            if w not in words and near_to(w) and not any(w.startswith(s) for s in stems):
                hit.update(near_to(w))
        close[label].update(hit)
    # A misspelling counts for less than the term, and for nothing where clean documents
    # have as many words that close.
    fuzzy = {}
    for w in long:
        t, c = close[1][w], close[0][w]
        e = min(0.7 * words[w], math.log((t + 1.5) / (n[1] + 1)) - math.log((c + 0.5) / (n[0] + 1)) + (0 if c else 1.5))
        if e > 0.5:
            fuzzy[w] = e
    lexicon = Lexicon(words, stems, fuzzy, np.zeros(7))
    parts = [hits(pa.array(texts[s : s + 256], pa.string()), lexicon) for s in range(0, len(texts), 256)]
    # Weighted to the shares in all labels.
    w = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum()) * len(y)

    def fitted(windows: dict[str, float]) -> tuple[float, np.ndarray]:
        lexicon.windows = windows
        beta, loss = logistic(np.concatenate([_evidence(lexicon, *part) for part in parts]), y, w)
        return loss + HOLD * sum(math.log(windows[k] / WINDOWS[k]) ** 2 for k in windows), beta

    # One kind of window after another takes the share that fits the labels best; a kind
    # that no hit has keeps its share.
    windows, seen = dict(WINDOWS), {k for _, found in parts for *_, kinds in found for k in kinds}
    for kind in sorted(seen) * 2:
        windows = min(({**windows, kind: s} for s in SHARES), key=lambda v: fitted(v)[0])
    lexicon.weights = fitted(windows)[1]
    return lexicon


def logistic(rows: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.3) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by Newton's method: coefficients and penalised loss."""
    beta = np.zeros(rows.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        hessian = (rows * (w * p * (1 - p))[:, None]).T @ rows + ridge * np.eye(len(beta))
        step = np.linalg.solve(hessian, rows.T @ (w * (y - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
    return beta, float(-(w * np.log(np.where(y == 1, p, 1 - p) + 1e-12)).sum() + ridge / 2 * beta @ beta)


def _probability(lexicon: Lexicon, many: np.ndarray, found: list[Hit]) -> np.ndarray:
    if lexicon.only is not None:
        return np.full(len(many), lexicon.only)
    return 1 / (1 + np.exp(-np.clip(_evidence(lexicon, many, found) @ lexicon.weights, -30, 30)))


def _shipped(docs: DataFrame, lexicon: Lexicon) -> Callable[[], Lexicon]:
    """The lexicon in a Python worker, built once there: its memo serves all its tasks."""
    parts = (lexicon.words, lexicon.stems, lexicon.fuzzy, lexicon.weights, lexicon.windows, lexicon.only)
    name = uuid.uuid4().hex
    held = docs.sparkSession.sparkContext.broadcast(parts)  # a few hundred terms, set by SAMPLE

    def here() -> Lexicon:
        if name not in _built:
            _built.clear()
            _built[name] = Lexicon(*held.value)
        return _built[name]

    return here


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score, predicted, hits): the probability of label 1, whether it is 0.5 or
    more, and the terms found as (kind, term, weight)."""
    lexicon_here = _shipped(docs, lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = lexicon_here()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("term", pa.string()), ("weight", pa.float64())]))
        for piece in X.pieces(batches):
            many, found = hits(piece.column(1), lexicon)
            p = _probability(lexicon, many, found)
            terms: list[list] = [[] for _ in many]
            for d, k, term, kinds in found:
                terms[d].append({"kind": k, "term": term, "weight": lexicon.window(kinds)})
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(terms, kind)], names=["doc_id", "score", "predicted", "hits"]
            )

    return doc_texts(docs).mapInArrow(run, "doc_id long, score double, predicted int, hits array<struct<kind:string,term:string,weight:double>>")


def without_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of `docs`, with all their columns, that are not predicted toxic; all rows
    where nothing could be learned, as nothing tells toxic ones apart then."""
    if lexicon.only is not None:
        return docs
    prepare(docs.sparkSession)
    lexicon_here = _shipped(docs, lexicon)
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in X.pieces(batches, column=at):
            clean = _probability(lexicon_here(), *hits(pc.fill_null(piece.column(at), ""), lexicon_here())) < 0.5
            yield piece.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
