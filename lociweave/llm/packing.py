"""Best-fit packing by minimum bin slack.

Texts become token ids, cut only where longer than a sequence. The pieces are packed into sequences
of at most ``CAPACITY`` tokens: for each sequence a subset-sum programme over a bitset of reachable
fills (one bit per fill) finds the fullest combination of the available lengths around the longest
one left, and the combination is removed. Pieces of one length can stand for each other, so what
is available is a count per length: at most ``CAPACITY`` numbers however large the corpus. A
combination stays the fullest until one of its lengths runs out; it is taken as often as the
counts allow, so the plan has at most some ten thousand entries, and is made in the driver.

Which piece goes where follows from its rank among the pieces of its length. Ranks are counted in
chunks (a hash of the piece) first and then over chunks, so pieces of one very common length are
never brought to one task.

Defined results: null and empty texts are the single id 0; repeated rows are packed one by one
(two rows with the same doc_id give the same piece numbers twice); an empty table gives no rows;
other columns are ignored; very long texts are read whole. Ids are those that the library gives for the text
with add_special_tokens=False: a special token's string in a text is that token.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import doc_texts, ids_and_texts, materialize, tidy

CAPACITY = 2048
#: Words a worker remembers the ids of, from their second time on; further words are encoded each time they occur.
REMEMBERED = 300_000
#: Marks, by hash, of words seen once.
MARKS = 1 << 22
#: Pieces in a chunk within which ranks are counted by one sort.
CHUNK_ROWS = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds(dict):
    """Word between spaces -> its ids as little-endian unsigned 32-bit bytes.

    No token of the vocabulary crosses white space, so a text's ids are those of its words; texts that
    hold an added token's string go to the library whole. So does every text if the file's normal form
    isn't composed characters, single spaces and lower case, or its parts aren't matches of one pattern.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        made = json.loads(self.whole.to_str())
        steps = [x["type"] for x in (made["normalizer"] or {}).get("normalizers", [])]
        cuts = (made["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_words = steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["invert"]
        self.added = regex.compile("|".join(regex.escape(x["content"]) for x in made["added_tokens"]) or r"(?!)").search
        self.merge = self.whole.model.tokenize
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.split = regex.compile(cuts[0]["pattern"]["Regex"] if self.by_words else "").findall
        #: Normal form C and lower case change these characters one by one.
        self.plain = regex.compile(r"[\x21-\x7e¡-¬®-įĲ-ſ]+").fullmatch
        self.seen = bytearray(MARKS)

    def _part(self, part: str) -> bytes:
        ids = [t.id for t in self.merge(part if part.isascii() else self.bytes(part)[0][0])]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        if not word:
            out = b""
        elif (letters := word.isascii() and word.isalpha()) or self.plain(word):
            low = word.lower()
            parts = [low] if letters else self.split(low)
            out = self._part(word) if parts == [word] else b"".join([self[x] for x in parts])  # a part alone is a word of one part
        else:
            out = np.array(self.whole.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self) < REMEMBERED:
            mark = hash(word) % MARKS
            if self.seen[mark]:
                self[word] = out
            else:
                self.seen[mark] = 1
        return out

    def encode(self, text: str) -> bytes:
        if self.by_words and not self.added(text):
            return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One per Python worker."""
    return WordIds(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns of ``PIECES``: each text's ids and an end id, cut every ``capacity`` ids."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_ids(path)
        for ids, texts in ids_and_texts(batches):
            rows: list[tuple] = []
            for i, text in zip(ids, texts, strict=True):
                data = own.encode(text) + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                a, b, c, d, e = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(e, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return doc_texts(docs, id_col, text_col).mapInArrow(tidy(run), PIECES)


def fullest(counts: dict[int, int], room: int) -> Counter:
    """The combination of available lengths with the largest sum up to ``room``.

    Bit s of ``reach`` says that a fill of s can be reached with the lengths seen so far.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:  # 1, 2, 4, ... copies and the rest: every number of copies can be made
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= reach << (length * k) & mask
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    fill, out = reach.bit_length() - 1, Counter()
    for length, k, before in reversed(steps):
        if not before >> fill & 1:
            out[length] += k
            fill -= length * k
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations (length -> copies) and how many sequences each makes, in the order they were found."""
    counts, out = {k: v for k, v in counts.items() if v}, []
    while counts:
        longest = max(counts)
        rest = dict(counts)
        rest[longest] -= 1
        if not rest[longest]:
            del rest[longest]
        found = fullest(rest, capacity - longest)
        found[longest] += 1
        times = min(counts[k] // n for k, n in found.items())
        out.append((dict(found), times))
        for k, n in found.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
    return out


def layout(made: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, copies per sequence, first sequence, first offset), by length and rank."""
    rows, ranks, sequence = [], Counter(), 0
    for found, times in made:
        offset = 0
        for length, n in sorted(found.items(), reverse=True):
            rows.append((length, ranks[length], n, sequence, offset))
            ranks[length] += n * times
            offset += length * n
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a durable table of pieces (``length`` from 1 to ``capacity``)."""
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    table = layout(plan(counts, capacity))
    chunks = max(64, sum(counts.values()) // CHUNK_ROWS)
    chunk = F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(chunks))
    ranked = parts.withColumn("_chunk", chunk).withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_chunk").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    before = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.groupBy("length", chunk.alias("_chunk")).agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    placed = ranked.join(firsts, ["length", "_chunk"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_first")).cast("long").alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = table[:, 0] * (1 << 48) + table[:, 1]
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            row = table[np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1]
            copy, j = np.divmod(rank - row[:, 1], row[:, 2])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(row[:, 3] + copy), pa.array(row[:, 4] + j * length)], [*b.schema.names[:5], "sequence_id", "offset"])

    return placed.mapInArrow(tidy(run), f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, cut and pack whole texts."""
    return pack(materialize(pieces(docs, path, capacity, 0, id_col, text_col), "pieces"), capacity)
