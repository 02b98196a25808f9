"""Token counts of whole texts under a byte-pair vocabulary, without making the ids.

A text's symbols are a doubly linked list; a heap holds the adjacent pairs that a piece of
the vocabulary spells, and the pair of lowest rank (ties: leftmost) merges first until no
pair is left.  The count is the number of symbols at first minus the number of merges; a
symbol outside the vocabulary counts as many as its bytes.

Merging costs n log n for n symbols, so a text is cut first, at places that no merge can
cross: between two characters that stand side by side in no piece.  The cuts are read off
the vocabulary (`TokenCounter`), never assumed.  Equal stretches between cuts have
equal counts, which a bounded table remembers.

Null and empty texts have no tokens.  Texts of any length are counted whole, runs without
a cut too.  Repeated rows get a row each; rows without a doc_id are left out; columns other
than doc_id and text are ignored, whatever their names.  Empty tables give no rows.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from leafmark.llm import textops as X
from leafmark.llm.common import doc_texts, prepare

#: Stretches that a worker remembers at most, and the longest of them in characters.
KEPT, KEPT_CHARS = 1 << 20, 32
SPACE = "▁"
_LETTER = re.compile(r"[^\W\d_]")
_counters: dict[str, TokenCounter] = {}


class TokenCounter:
    """text -> number of tokens, for a sentencepiece model of byte pairs with byte fallback."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = range(self.model.vocab_size())
        if any(self.model.is_unused(i) for i in ids) or not any(self.model.is_byte(i) for i in ids):
            raise ValueError(f"{model}: counts are for vocabularies with byte fallback and without unused pieces")
        usual = [i for i in ids if not (self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unknown(i))]
        #: Merges of low rank come first.
        self.ranks = {self.model.id_to_piece(i): -self.model.get_score(i) for i in usual}
        beside = {piece[k : k + 2] for piece in self.ranks for k in range(len(piece) - 1)}
        inner = {c for pair in beside for c in pair}
        # Spaces open a stretch if no piece has one behind another character, and so do signs
        # that no piece has behind a letter; line breaks and tabs that no piece joins to
        # anything are stretches of their own.
        space = "" if any(b == SPACE != a for a, b in beside) else SPACE
        signs = re.escape("".join(set(string.punctuation) - {b for a, b in beside if _LETTER.match(a)}))
        alone = "".join(c for c in "\t\n\r" if c not in inner)
        cuts = [f"[{alone}]"] if alone else []
        cuts += [f"{space}*+{_LETTER.pattern}++(?=[{signs}])"] if space and signs else []
        cuts += [f"{space}*[^{space}{alone}]+", f"{space}+"] if space else [f"[^{alone}]+" if alone else "(?s:.+)"]
        self.stretches = re.compile("|".join(cuts)).findall
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> int:
        known, total = self.known, 0
        for stretch, times in Counter(self.stretches(self.model.normalize(text))).items():
            n = known.get(stretch)
            if n is None:
                n = self.merged(stretch)
                if len(stretch) <= KEPT_CHARS:
                    if len(known) >= KEPT:
                        known.clear()
                    known[stretch] = n
            total += n * times
        return total

    def merged(self, text: str) -> int:
        """Symbols that are left of `text` when no pair can merge any more."""
        ranks = self.ranks
        symbols = list(text)
        n = len(symbols)
        count = sum(1 if c in ranks else len(c.encode()) for c in symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[pair], i, len(pair)) for i in range(n - 1) if (pair := symbols[i] + symbols[i + 1]) in ranks]
        heapify(heap)
        while heap:
            _, i, size = heappop(heap)
            j = after[i]
            # A pair whose symbols have changed since it came in is out of date.
            if j >= n or not symbols[i] or len(symbols[i]) + len(symbols[j]) != size:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (pair := symbols[i] + symbols[k]) in ranks:
                    heappush(heap, (ranks[pair], i, len(pair)))
            h = before[i]
            if h >= 0 and (pair := symbols[h] + symbols[i]) in ranks:
                heappush(heap, (ranks[pair], h, len(pair)))
        return count


def counter(model: str | None = None) -> TokenCounter:
    """The counter of a model file (default: the public 32k one), made once in a worker."""
    import public_tokenizers

    model = model or public_tokenizers.path("piece_bpe_32k.model")
    if model not in _counters:
        _counters[model] = TokenCounter(model)
    return _counters[model]


def count(docs: DataFrame, limit: int = 4096, model: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(model)
        for part in X.pieces(batches):
            texts = part.column(1)
            n = pa.array([tokens(t) for t in texts.to_pylist()], pa.int64())
            sizes = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), sizes, n, pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
