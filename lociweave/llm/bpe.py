"""Byte-level BPE by monoid tree reduction.

A text is cut in halves down to leaves; leaves are encoded alone and joined up a tree. A join
re-encodes a window around the cut and keeps all tokens outside it. The window ends where both
sides are provably the same with and without the cut:

* *between words*: a white-space character right after one that isn't white space always starts a
  new match of the pattern, whatever stands further away (no alternative of the pattern runs from
  another class into white space). Tokens before such a place at the left and from such a place at
  the right don't depend on the cut.
* *inside one long match* (no such place on a side): the two byte sequences are joined by their
  tokens. A sequence of tokens is the encoding of its bytes exactly if each two neighbours are the
  encoding of theirs, so a window of tokens is re-encoded and doubled until the pairs at its two
  edges hold.

Decoding concatenates token bytes up the same kind of tree.

Defined results: null text counts as empty; an empty text has no ids; repeated rows give repeated
rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .runtime import doc_texts, ids_and_texts, tidy

#: Characters of a leaf, and bytes of a leaf inside one long match.
LEAF_CHARS, LEAF_BYTES = 1024, 256
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_EDGE = regex.compile(r"(?<=\S)\s")


class Codec:
    """Encoder and decoder for the ranks of a file; ``pattern`` splits texts before the merges."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.match = regex.compile(pattern)
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            self.bytes[v] = k
        self.pairs: dict[tuple[int, int], bool] = {}
        self.decimals = [str(i) for i in range(len(self.bytes))]

    # one match of the pattern

    def _merge(self, piece: bytes) -> list[int]:
        return self.core._encode_single_piece(piece) if piece else []

    def _pair_holds(self, a: int, b: int) -> bool:
        if len(self.pairs) > 500_000:
            self.pairs.clear()
        if (held := self.pairs.get((a, b))) is None:
            held = self.pairs[a, b] = self._merge(self.bytes[a] + self.bytes[b]) == [a, b]
        return held

    def join_tokens(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings, put together within one match."""
        if not a or not b:
            return a + b
        if self._pair_holds(a[-1], b[0]):
            return a + b
        k = 1
        while True:
            i, j = max(0, len(a) - k), min(len(b), k)
            window = self._merge(b"".join(self.bytes[t] for t in a[i:] + b[:j]))
            if (i == 0 or self._pair_holds(a[i - 1], window[0])) and (j == len(b) or self._pair_holds(window[-1], b[j])):
                return a[:i] + window + b[j:]
            k *= 2

    def encode_match(self, piece: bytes) -> list[int]:
        """One match of the pattern, by halves of its bytes."""
        if len(piece) <= LEAF_BYTES:
            return self._merge(piece)
        half = len(piece) // 2
        return self.join_tokens(self.encode_match(piece[:half]), self.encode_match(piece[half:]))

    def encode_flat(self, text: str) -> list[int]:
        """A text without the tree; long matches by halves."""
        if len(text) <= 4 * LEAF_CHARS:
            return self.core.encode_ordinary(text)
        out: list[int] = []
        for m in self.match.finditer(text):
            out += self.encode_match(m[0].encode())
        return out

    # a whole text

    def _take(self, tokens: list[int], size: int, back: bool) -> int:
        """How many tokens at one end hold ``size`` bytes."""
        n = 0
        while size > 0:
            n += 1
            size -= len(self.bytes[tokens[-n if back else n - 1]])
        if size:
            raise ValueError("a token crosses a boundary between matches")
        return n

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= LEAF_CHARS:
            return self.core.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        left, right = self._encode(text, lo, mid), self._encode(text, mid, hi)
        reach = 32
        while True:  # the last boundary before the cut
            start = max(lo, mid - reach)
            found = [m.start() for m in _EDGE.finditer(text, max(lo, start - 1), mid)]
            i = found[-1] if found else lo
            if found or start == lo:
                break
            reach *= 4
        after = _EDGE.search(text, mid, hi)
        j = after.start() if after else hi
        keep = len(left) - self._take(left, len(text[i:mid].encode()), True)
        skip = self._take(right, len(text[mid:j].encode()), False)
        return left[:keep] + self.encode_flat(text[i:j]) + right[skip:]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_CHARS:
            return b"".join([self.bytes[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One codec per Python worker."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: the token ids of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for ids, texts in ids_and_texts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([own.encode(x) for x in texts], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return doc_texts(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, bytes binary: what the ids of every row stand for; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return tokens.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{ids_col}` as array<int>) ids").mapInArrow(tidy(run), "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text; digests of the ids and of the decoded bytes (columns of ``SCHEMA``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for ids, texts in ids_and_texts(batches):
            n, a, b = [], [], []
            for x in texts:
                tokens = own.encode(x)
                n.append(len(tokens))
                a.append(hashlib.sha256(" ".join([own.decimals[t] for t in tokens]).encode()).hexdigest())
                b.append(hashlib.sha256(own.decode(tokens)).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return doc_texts(docs, id_col, text_col).mapInArrow(tidy(run), SCHEMA)
