"""Substring dedup: remove words covered by a 50-word window that also starts in an earlier document.

Windows are found level-wise. At the first level sequences of 13 words are compared over the whole
corpus, but only those that are the smallest by hash among the sequences of some 50-word window: equal
windows choose the same sequence, so a window whose choice is in one document alone is unique and goes.
Where the choice is repeated, the window is extended: its 25-word sequences are compared likewise, and
what survives is compared at the full 50 words, where the smallest document of each window is kept.
(13, 25, 50: each level doubles the one before, less one where the sequences overlap by a word.)

Documents equal to an earlier one need no windows: all of theirs start there too. Sequences are sent as
hashes (64 bits; 128 at the last level). Minima are summed per task before the shuffle, and rows are
joined back to them by plain shuffles that Spark can split, so a passage that a third of all documents
share is not one task.

Defined results: null text has no words; rows with a null doc_id are left as they are and hold nothing
against others; rows with one doc_id don't count as repeats of each other; texts under 50 words stay;
an empty table gives none; very long texts are read whole. Other columns are kept, whatever their names; an
input column called ``_sd_words``, ``_sd_removed`` or ``_sd_kept`` is an error, as the result has these.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .runtime import discard, free_names, materialize, tidy
from .shingles import NEVER, mix, room, sequences, sliding, word_hashes

WINDOW = 50
BLOCK_CHARS = 1_000_000
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def levels(window: int = WINDOW, least: int = 12) -> list[int]:
    """Lengths from the shortest level to the window, each twice the one before or one less."""
    out = [window]
    while out[0] >= 2 * least:
        out.insert(0, -(-out[0] // 2))
    return out


def _blocks(batches: Iterator[pa.RecordBatch], extra: int = 0):
    """(first columns as lists, texts, further columns as lists) in blocks of bounded characters; text is column 2."""
    for b in batches:
        sizes = np.zeros(b.num_rows + 1, dtype=np.int64)
        if b.num_rows:
            np.cumsum(pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy(zero_copy_only=False), out=sizes[1:])
        start = 0
        while start < b.num_rows:
            end = max(start + 1, int(np.searchsorted(sizes, sizes[start] + BLOCK_CHARS, side="right")) - 1)
            part = b.slice(start, end - start)
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column(2)]
            yield part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False), texts, [part.column(3 + k) for k in range(extra)]
            start = end


def _chosen(g: np.ndarray, left: np.ndarray, length: int, window: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest sequence of each window, places of those that a window of ``starts`` chose)."""
    g = np.where(left >= length, g, NEVER)
    span = window - length + 1
    least = sliding(g, span)
    most = sliding(np.where(starts, least, np.uint64(0)), span, least=False, back=True)
    return least, np.flatnonzero((most == g) & (most > 0) & (left >= length))


def _survive(g: np.ndarray, least: np.ndarray, left: np.ndarray, length: int, window: int, starts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Windows of ``starts`` whose choice is among ``places``."""
    kept = np.full(len(g), NEVER)
    kept[places] = g[places]
    return starts & (sliding(kept, window - length + 1) == least) & (least != NEVER)


def _places(column: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """Places in a block, from each document's own."""
    sizes = np.fromiter((len(x) if x.is_valid else 0 for x in column), dtype=np.int64, count=len(column))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat + np.repeat(bounds[:-1], sizes)


def anchors(docs: DataFrame, depth: int, window: int) -> DataFrame:
    """h, doc_id, key, at: the sequences that windows choose at a level.

    docs: doc_id, key, text, and for each level before, the places that survived it.
    """
    lengths = levels(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, texts, found in _blocks(batches, depth):
            h, bounds = word_hashes(texts)
            if not len(h):
                continue
            left = room(bounds, len(h))
            starts = left >= window
            for k in range(depth + 1):
                g = mix(sequences(h, lengths[k]))
                least, at = _chosen(g, left, lengths[k], window, starts)
                if k < depth:
                    starts = _survive(g, least, left, lengths[k], window, starts, _places(found[k], bounds))
            doc = np.searchsorted(bounds, at, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(g[at].view(np.int64)), pa.array(ids[doc]), pa.array(keys[doc]), pa.array((at - bounds[doc]).astype(np.int32))], ["h", "doc_id", "key", "at"])

    return docs.mapInArrow(tidy(run), "h long, doc_id long, key long, at int")


def windows(docs: DataFrame, depth: int, window: int) -> DataFrame:
    """h, h2, doc_id, key, at: the windows that survived all levels."""
    lengths = levels(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, texts, found in _blocks(batches, depth):
            h, bounds = word_hashes(texts)
            if not len(h):
                continue
            left = room(bounds, len(h))
            starts = left >= window
            for k in range(depth):
                g = mix(sequences(h, lengths[k]))
                least = sliding(np.where(left >= lengths[k], g, NEVER), window - lengths[k] + 1)
                starts = _survive(g, least, left, lengths[k], window, starts, _places(found[k], bounds))
            at = np.flatnonzero(starts)
            one, two = mix(sequences(h, window)), mix(sequences(h, window, _OTHER))
            doc = np.searchsorted(bounds, at, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(one[at].view(np.int64)), pa.array(two[at].view(np.int64)), pa.array(ids[doc]), pa.array(keys[doc]), pa.array((at - bounds[doc]).astype(np.int32))], ["h", "h2", "doc_id", "key", "at"])

    return docs.mapInArrow(tidy(run), "h long, h2 long, doc_id long, key long, at int")


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that two documents have, with the smaller doc_id."""
    return materialize(rows.groupBy(*keys).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select(*keys, "first"), "repeated")


def _by_document(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("doc_id", "key").agg(F.collect_list("at").alias(name))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, key (a hash of the text), copy (all windows are repeats), starts array<int> (else these)."""
    lengths = levels(window)
    text = F.col(f"`{text_col}`").cast("string")
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text")).where("doc_id is not null and text is not null")
    rows = materialize(anchors(own, 0, window), "anchors")
    repeated = _repeated(rows, ["h"])
    some = materialize(own.join(_by_document(rows.join(repeated, "h"), "at0"), ["doc_id", "key"]), "candidates")
    discard(rows, repeated)
    # documents equal to an earlier one
    equal = materialize(some.groupBy("key", F.xxhash64(F.lit("text"), "text").alias("key2")).agg(F.min("doc_id").alias("first")), "equal")
    marked = some.join(equal, (some["key"] == equal["key"]) & (F.xxhash64(F.lit("text"), some["text"]) == equal["key2"])).select(some["*"], "first")
    marked = materialize(marked.select("doc_id", "key", "text", "at0", (F.col("first") < F.col("doc_id")).alias("copy")), "marked")
    discard(some, equal)
    left = marked.where("not copy").select("doc_id", "key", "text", "at0").distinct()
    for depth in range(1, len(lengths) - 1):
        level = materialize(left, "level")
        rows = materialize(anchors(level, depth, window), "anchors")
        repeated = _repeated(rows, ["h"])
        left = materialize(level.join(_by_document(rows.join(repeated, "h"), f"at{depth}"), ["doc_id", "key"]), "survivors")
        discard(level, rows, repeated)
    rows = materialize(windows(left, len(lengths) - 1, window), "windows")
    discard(left)
    repeated = _repeated(rows, ["h", "h2"])
    again = rows.join(repeated, ["h", "h2"]).where("first < doc_id")
    found = _by_document(again, "starts").select("doc_id", "key", F.lit(False).alias("copy"), "starts")
    out = materialize(found.union(marked.where("copy").select("doc_id", "key", "copy", F.expr("array()").cast("array<int>")).distinct()), "repeats")
    discard(rows, repeated, marked)
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """All columns, _sd_words and _sd_removed long, and _sd_kept string: the words left, joined by a space."""
    columns = docs.columns
    if taken := {c.lower() for c in columns} & {"_sd_words", "_sd_removed", "_sd_kept"}:
        raise ValueError(f"columns of the result: {sorted(taken)}")
    i, k, c, p, t = free_names(columns, "id", "key", "copy", "starts", "text")
    found = repeats(docs, id_col, text_col, window).select(F.col("doc_id").alias(i), F.col("key").alias(k), F.col("copy").alias(c), F.col("starts").alias(p))
    text = F.col(f"`{text_col}`").cast("string")
    joined = docs.join(found, (F.col(f"`{id_col}`").cast("long") == F.col(i)) & (F.xxhash64(text) == F.col(k)), "left")
    inner = joined.select(*[F.col(f"`{x}`") for x in columns], text.alias(t), c, p)
    n = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, gone, kept = [], [], []
            for t, copy, starts in zip(b.column(n), b.column(n + 1).to_pylist(), b.column(n + 2), strict=True):
                own = t.as_buffer().to_pybytes().split() if t.is_valid else []
                words.append(len(own))
                if copy and len(own) >= window:
                    gone.append(len(own))
                    own = []
                elif starts.is_valid and len(starts):
                    edge = np.zeros(len(own) + 1, dtype=np.int64)
                    at = np.unique(starts.values.to_numpy(zero_copy_only=False))
                    edge[at] += 1
                    edge[at + window] -= 1
                    stay = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
                    gone.append(len(own) - len(stay))
                    own = [own[i] for i in stay.tolist()]
                else:
                    gone.append(0)
                kept.append(b" ".join(own).decode())
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], [*b.schema.names[:n], "_sd_words", "_sd_removed", "_sd_kept"])

    schema = StructType(list(docs.schema.fields)).add("_sd_words", "long").add("_sd_removed", "long").add("_sd_kept", "string")
    return inner.mapInArrow(tidy(run), schema)


def digest(deduped: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return deduped.select("doc_id", F.col("_sd_words").alias("n_words"), F.col("_sd_removed").alias("n_removed"), F.sha2(F.col("_sd_kept").cast("binary"), 256).alias("kept_sha256"))


#: The same for DuckDB, over the view documents (doc_id unique).
SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW}),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h FROM s),
f AS (SELECT h, min(doc_id) AS first FROM k GROUP BY h HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM k JOIN f USING (h), range({WINDOW}) r(j) WHERE first < doc_id),
g AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
