"""Byte-level BPE by prefix dynamic programming.

For each prefix of a byte string the encoding ends in exactly one token, and that token
is the only one whose pairing with the encoding's last token before it survives the
merges. Storing this last token per prefix makes the encoding of every prefix readable
by walking back, appending exact (old entries never change), and an edit cheap: entries
before it stay, and entries after it are those of the old text again as soon as a whole
token's reach of them agrees.

Null text encodes as the empty string; texts have any length (a pre-token is encoded in
time proportional to its length); rows never meet, so repeated rows, skew and empty
tables need no care; other input columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import kept

CACHE = 400_000
#: Bytes by which tokens that may end at a place are looked up.
TAIL = 4
#: Rows whose ids a worker holds at once.
ROWS = 256


class PrefixBPE:
    """A rank table, the pairs known to hold or not, and the codes of pre-tokens seen."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.decimal = {i: str(i) for i in self.bytes_of}
        self.longest = max(map(len, ranks))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.splits: dict[int, tuple[int, int] | None] = {}
        #: The lengths, falling, of tokens that end in these bytes; shorter tokens may end anywhere.
        short, ending = tuple(range(TAIL - 1, 0, -1)), {}
        for t in ranks:
            if len(t) >= TAIL:
                ending.setdefault(t[-TAIL:], set()).add(len(t))
        self.short, self.ending = short, {tail: (*sorted(sizes, reverse=True), *short) for tail, sizes in ending.items()}
        longer = [i for t, i in ranks.items() if len(t) > 1]
        #: Whether all single bytes rank below all merges, as ``holds`` needs to undo merges by rank.
        self.bytes_first = not longer or max((i for t, i in ranks.items() if len(t) == 1), default=-1) < min(longer)
        self.seen: dict[str, tuple[int, ...]] = {}

    def merged(self, piece: bytes, least: int = 1) -> list[bytes]:
        """The merges themselves, lowest rank first, down to ``least`` parts: what decides whether two tokens may stand side by side."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > least:
            rank, i = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the merges join last into this one; a byte twice; None where they never make it."""
        if token not in self.splits:
            parts = self.merged(self.bytes_of[token], 2)
            self.splits[token] = (token, token) if len(parts) == 1 else (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.splits[token]

    def parted(self, left: int, right: int) -> bool:
        """Whether the merges keep the two tokens apart: their merges undone, the latest first, none across the border comes before."""
        bytes_of, ranks = self.bytes_of, self.ranks
        if self.split(left) is None or self.split(right) is None:
            return False
        limit = 1 << 60
        while True:
            if ranks.get(bytes_of[left] + bytes_of[right], 1 << 60) < limit:
                return False
            for of_left in (True, False) if left > right else (False, True):
                limit, token = (left, left) if of_left else (right + 1, right)
                inner = self.split(token)[1 if of_left else 0]
                if inner != token:
                    break
            else:
                return True
            left, right = (inner, right) if of_left else (left, inner)

    def holds(self, left: int, right: int) -> bool:
        if (known := self.pairs.get((left, right))) is None:
            if len(self.pairs) > 4 * CACHE:
                self.pairs.clear()
            if self.bytes_first:
                known = self.parted(left, right)
            else:
                a, b = self.bytes_of[left], self.bytes_of[right]
                known = self.merged(a + b) == [a, b]
            self.pairs[left, right] = known
        return known

    def starts(self, token: int) -> bool:
        """Whether the merges leave the token's own bytes whole, so that a piece may begin with it."""
        if (known := self.pairs.get((-1, token))) is None:
            known = self.pairs[-1, token] = self.merged(self.bytes_of[token]) == [self.bytes_of[token]]
        return known

    def last_token(self, piece: bytes, last: list[int], end: int) -> int:
        """The last token of ``piece[:end]``, given those of all shorter prefixes."""
        for n in self.ending.get(piece[end - TAIL : end], self.short) if end >= TAIL else self.short:
            token = self.ranks.get(piece[end - n : end]) if n <= end else None
            if token is not None and (self.starts(token) if n == end else self.holds(last[end - n], token)):
                return token
        raise ValueError("the rank table lacks a byte")

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Last tokens of all prefixes of ``piece``; ``last`` has those of a prefix (entry 0 unused)."""
        last = last or [-1]
        rank, lengths, short, pair = self.ranks.get, self.ending.get, self.short, self.pairs.get
        for end in range(len(last), len(piece) + 1):  # as last_token does, which the cost of a call would double
            for n in lengths(piece[end - TAIL : end], short) if end >= TAIL else short:
                if n <= end and (token := rank(piece[end - n : end])) is not None:
                    if (known := pair((last[end - n], token))) is None:
                        known = self.starts(token) if n == end else self.holds(last[end - n], token)
                    if known:
                        last.append(token)
                        break
            else:
                raise ValueError("the rank table lacks a byte")
        return last

    def read(self, last: list[int], end: int) -> list[int]:
        """The encoding of the prefix of length ``end``."""
        out = []
        while end:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return out[::-1]

    def edit(self, piece: bytes, last: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int]]:
        """``piece`` with ``[start:stop]`` replaced, and its last tokens, made anew only near the edit.

        Behind the edit an entry depends on at most ``longest`` entries and bytes before
        it, so after as many agreeing entries the old ones hold.
        """
        text, shift = piece[:start] + new + piece[stop:], len(new) - (stop - start)
        out, agreed = last[: start + 1], 0
        for end in range(start + 1, len(text) + 1):
            out.append(self.last_token(text, out, end))
            agreed = agreed + 1 if end > start + len(new) and out[end] == last[end - shift] else 0
            if agreed >= self.longest:
                return text, out + last[end - shift + 1 :]
        return text, out

    def piece(self, word: str) -> tuple[int, ...]:
        raw = word.encode()
        if (whole := self.ranks.get(raw)) is not None:
            return (whole,)
        return tuple(self.read(self.extend(raw, []), len(raw)))

    def encode(self, text: str) -> list[int]:
        seen, codes = self.seen, []
        for word in self.pattern.findall(text):
            if (code := seen.get(word)) is None:
                code = self.piece(word)
                if len(seen) >= CACHE:
                    seen.clear()
                if len(word) <= 64:
                    seen[word] = code
            codes.append(code)
        return list(chain.from_iterable(codes))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def ranks_of(lines: bytes) -> dict[bytes, int]:
    """A rank file's content: base64 token and rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines.splitlines() if line)}


def encoded(batch: pa.RecordBatch, coder: PrefixBPE, with_ids: bool = True) -> Iterator[pa.RecordBatch]:
    """Of a batch of keys and texts: key, ids, n_tokens and digests, of at most ROWS rows at once."""
    for at in range(0, batch.num_rows, ROWS):
        rows, out = batch.slice(at, ROWS), {"ids": [], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for value in rows.column(1):
            ids = coder.encode(value.as_py() or "")
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(",".join(map(coder.decimal.__getitem__, ids)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(coder.decode(ids)).hexdigest())
            if with_ids:
                out["ids"].append(pa.array(ids, pa.int32()))
        arrays = [rows.column(0), pa.array(out["n_tokens"], pa.int64()), pa.array(out["ids_sha256"], pa.string()), pa.array(out["decoded_sha256"], pa.string())]
        if with_ids:
            arrays.insert(1, pa.array(out["ids"], pa.list_(pa.int32())))
        yield pa.RecordBatch.from_arrays(arrays, names=["key", *(["ids"] if with_ids else []), "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """key, ids, n_tokens, ids_sha256 and decoded_sha256 of each row's whole text.

    The vocabulary file (a parameter; under a megabyte) is read on the driver and broadcast.
    """
    with open(vocabulary, "rb") as f:
        lines = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(lines)
    name = hashlib.sha256(lines + pattern.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept(name, lambda: PrefixBPE(ranks_of(shared.value), pattern))
        for batch in batches:
            yield from encoded(batch, coder, with_ids)

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    made = rows.mapInArrow(run, f"key {kind}, " + ("ids array<int>, " if with_ids else "") + "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return made.withColumnRenamed("key", key)
