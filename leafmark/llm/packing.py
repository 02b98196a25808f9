"""Best-two-fit packing of tokenised documents into fixed-length sequences.

The packer needs only how many pieces there are of each length, a table of at most
`capacity` rows whatever the corpus.  On it best-two-fit runs once for all pieces:
fill a bin greedily with the largest piece that fits, then replace its smallest piece
with two unpacked ones that fill the widened gap more tightly; the finished bin is a
pattern, used as many times as the counts allow.  The plan says which of the pieces of
each length go to which bins, and every piece finds its place by its rank among the
pieces of its length.  So the result is that of one packer over the whole corpus, while
texts are read and tokenised once and no piece is gathered anywhere.

Ranks need no sort: a task numbers its own pieces of each length, and the counts of the
tasks before it (a running sum per length over one row per task) are joined on.

Null and empty texts are one piece of just the end id.  A text of any length is tokenised
whole and cut into pieces.  Repeated rows are packed as often as they occur.  Pieces of
equal length are alike to the packer, so which of them goes where is not fixed; everything
else is.  Columns other than doc_id and text are ignored, whatever their names.  Rows
without a doc_id are left out.  Empty tables give no rows.
"""

from __future__ import annotations

import base64
import bisect
import json
import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmark.llm import textops as X
from leafmark.llm.common import doc_texts, prepare, settle

END_ID = 0
#: White space that is left to `tokenizers`; the quick library fails from some hundred thousand on.
_LONG_RUN = re.compile(r"\s{5000}").search
_encoders: dict[str, object] = {}


def encoder(ranks: str | None = None, vocabulary: str | None = None):
    """text -> ids of the byte-level BPE of 50,257 ids, by the tokenizer library that is
    quickest at it.  The ids are those that `tokenizers` gives with the file `vocabulary`
    and add_special_tokens=False: the strings of its added tokens are cut out of a text
    first and have ids of their own.  `ranks`: the same vocabulary as merge ranks; both
    default to the public 50k files.

    The quick library looks ahead from the end of a run of white space and gives up on very
    long runs, so a text that holds one goes to `tokenizers` itself."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    if (ranks, vocabulary) not in _encoders:
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        with open(vocabulary, encoding="utf-8") as file:
            added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        model = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=added)
        quick, whole = partial(model.encode_to_numpy, allowed_special="all"), Tokenizer.from_file(vocabulary)

        def encode(text: str) -> np.ndarray:
            if _LONG_RUN(text):
                return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
            return quick(text)

        _encoders[ranks, vocabulary] = encode
    return _encoders[ranks, vocabulary]


def _tokenise(capacity: int, ranks: str | None, vocabulary: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks, vocabulary)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for part in X.pieces(batches):
            ids, piece, start, length, crc, rank = [], [], [], [], [], []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                tokens = np.append(encode(text).astype("<u4"), np.uint32(END_ID)).astype("<u4")
                n = len(tokens)
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k in range(len(cuts) - 1):
                    a, b = cuts[k], cuts[k + 1]
                    ids.append(doc_id)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(tokens[a:b].tobytes()))
                    rank.append(int(seen[b - a]))
                    seen[b - a] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array(np.full(len(ids), task, np.int64)), pa.array(rank, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
            )

    return run


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns (times used, {length: pieces of it in the bin}) that pack all pieces.

    `counts`: how many pieces there are of each length, 1 to `capacity`.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    sizes = sorted(left)
    plan: list[tuple[int, dict[int, int]]] = []
    while sizes:
        used = {sizes[-1]: 1}
        gap = capacity - sizes[-1]
        free = lambda k: left[k] - used.get(k, 0)
        at = bisect.bisect_right(sizes, gap)
        while at and gap:
            size = sizes[at - 1]
            fit = min(free(size), gap // size)
            if fit:
                used[size] = used.get(size, 0) + fit
                gap -= fit * size
            at = min(at - 1, bisect.bisect_right(sizes, gap))
        if gap and sum(used.values()) > 1:
            small = min(used)
            room, best = gap + small, (small, None)
            for a in reversed(sizes[: bisect.bisect_right(sizes, room - 1)]):
                if 2 * a < best[0] or not free(a):
                    continue
                j = bisect.bisect_right(sizes, min(a, room - a))
                while j and a + sizes[j - 1] > best[0]:
                    b = sizes[j - 1]
                    if free(b) >= 1 + (a == b):
                        best = (a + b, (a, b))
                        break
                    j -= 1
                if best[0] == room:
                    break
            if best[1]:
                used[small] -= 1
                if not used[small]:
                    del used[small]
                for k in best[1]:
                    used[k] = used.get(k, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        plan.append((times, used))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
                sizes.pop(bisect.bisect_left(sizes, k))
    return plan


def _slots(plan: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, first bin, pieces per bin, offset), ordered by length and rank."""
    rows, seen, bins = [], {}, 0
    for times, used in plan:
        offset = 0
        for size, n in sorted(used.items(), reverse=True):
            rows.append((size, seen.get(size, 0), bins, n, offset))
            seen[size] = seen.get(size, 0) + n * times
            offset += n * size
        bins += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _place(slots: np.ndarray):
    key = slots[:, 0] * (1 << 50) + slots[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            row = slots[np.searchsorted(key, length * (1 << 50) + rank, "right") - 1]
            past = rank - row[:, 1]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(row[:, 2] + past // row[:, 3]), pa.array(row[:, 4] + past % row[:, 3] * length)], names=names
            )

    return run


def pack(docs: DataFrame, capacity: int = 2048, ranks: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every document's
    ids and an end id, cut into pieces only if longer than `capacity` (the first piece
    may be shorter), placed without gaps or overlaps in sequences of `capacity` ids."""
    prepare(docs.sparkSession)
    layout = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"
    pieces = settle(doc_texts(docs).mapInArrow(_tokenise(capacity, ranks, vocabulary), layout))
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # At most `capacity` rows, whatever the input.
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = _slots(best_two_fit(counts, capacity))
    ranked = pieces.join(before, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank")
    )
    return ranked.mapInArrow(
        _place(slots), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
