"""Token counts under a unigram vocabulary, with the dynamic programme shared in a trie.

Distinct pre-tokens (words behind a word mark) go into a trie. The best segmentation of
every prefix is computed once, when its node is made, from the nodes above it; words that
share a prefix share the work, and a word's terminal node holds its number of tokens. A
document's count is the sum over its words. Log-probabilities follow the vocabulary's
rank order by Zipf's law (no public unigram scores are at hand); characters outside the
vocabulary fall back to one token per byte.

Each task grows a trie of its own and starts anew at NODES nodes, so memory is bounded
and no word table is shuffled or broadcast. Null text counts 0; a word of any length is
segmented in time linear in it; rows never meet, so repeats and skew need no care; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame

NODES = 1_500_000
MARK = "▁"
#: Words beyond so many characters are segmented without a place in the trie.
LONG = 64


def scores(pieces: list[str]) -> dict[str, int]:
    """piece -> log-probability in thousandths, from its rank; byte pieces ('<0x..>') and controls are left out."""
    good = [p for p in pieces if not (p.startswith("<") and p.endswith(">"))]
    return {p: -round(1000 * log(i + 2)) for i, p in enumerate(good)}


class Trie:
    """Nodes as parallel lists; node 0 is the empty prefix."""

    def __init__(self, piece_scores: dict[str, int]):
        self.scores = piece_scores
        self.longest = max(map(len, piece_scores), default=1)
        #: a byte is less likely than any piece
        self.byte = min(piece_scores.values(), default=0) - 1000
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.best: list[tuple[int, int]] = [(0, 0)]  # score, minus tokens: the larger wins
        self.terminal: dict[bytes, int] = {}

    def step(self, word: str, end: int, back) -> tuple[int, int]:
        """Best (score, -tokens) of ``word[:end]``; ``back(i)`` is that of ``word[:i]``."""
        n = len(word[end - 1].encode("utf-8", "surrogatepass"))
        s, t = back(end - 1)
        found = (s + n * self.byte, t - n)
        for start in range(max(0, end - self.longest), end):
            if (own := self.scores.get(word[start:end])) is not None:
                s, t = back(start)
                found = max(found, (s + own, t - 1))
        return found

    def count(self, raw: bytes) -> int:
        """Tokens of a pre-token."""
        word = MARK + raw.decode("utf-8", "replace")
        if len(word) > LONG:
            row = [(0, 0)]
            for end in range(1, len(word) + 1):
                row.append(self.step(word, end, row.__getitem__))
            return -row[-1][1]
        path = [0]
        for end in range(1, len(word) + 1):
            below = self.children[path[-1]]
            node = below.get(word[end - 1])
            if node is None:
                node = below[word[end - 1]] = len(self.best)
                self.best.append(self.step(word, end, lambda i: self.best[path[i]]))
                self.children.append({})
            path.append(node)
        return -self.best[path[-1]][1]

    def document(self, text: str | None) -> tuple[int, int]:
        """Words and tokens of a text."""
        if len(self.best) > NODES:
            self.clear()
        words = text.encode("utf-8", "surrogatepass").split() if text else []
        total, known = 0, self.terminal
        for w, times in Counter(words).items():
            if (n := known.get(w)) is None:
                n = self.count(w)
                if len(w) <= LONG:
                    known[w] = n
            total += n * times
        return len(words), total


def count_tokens(docs: DataFrame, pieces: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_tokens of every row; the piece list (a vocabulary file's) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(scores(shared.value))
        for batch in batches:
            found = [trie.document(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([t for _, t in found], pa.int64())], names=["key", "n_words", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, n_words long, n_tokens long").withColumnRenamed("key", key)


def pieces_of(model_file: str) -> list[str]:
    """The pieces of a SentencePiece model file, in order of id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [model.id_to_piece(i) for i in range(model.get_piece_size())]
