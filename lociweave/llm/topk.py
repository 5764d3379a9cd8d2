"""Exact top-k search by Fagin's threshold algorithm.

Vectors are cut into blocks; each block keeps one sorted list per dimension. For a query every list
is read from its better end (the largest values for a positive weight, the smallest for a negative
one), a step at a time; vectors met are scored in full. An unmet vector scores at most the sum over
dimensions of weight times the last value read, so reading stops once the kth score is above it.

Vectors are dealt to blocks by a hash of their id; a block's lists are sorted once, and the queries, which are
sent to every block, stream past it. First each query searches one block alone. Its kth score there is a
floor for the other blocks: what is below it can't be among the k best, so reading stops as soon as the bound
is. The k best of each block are ranked. No block depends on how many rows share a value. With queries a fixed
share of all rows the work is that of all queries over all blocks, which an exact search can't avoid.

Defined results: vectors that are null, or hold a null or non-finite component, take no part; components
of any finite size are scored exactly, as Python's integers where 64 bits could overflow, and a score that
64 bits can't hold is an error; a query is compared with vectors of its own length; rows with the same id
and vector count once; fewer than k candidates give as many rows; an empty table gives none;
other columns are ignored, and the id column may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize, tidy

#: Rows in a block of vectors.
BLOCK = 32_768
#: Rows read from each list before the first look at the bound; doubled each time.
FIRST_STEP = 32
#: ``over``: 1 above and -1 below the scores that 64 bits hold.
RESULT = "query_id long, vec_id long, score long, over int"
#: A floor below every score.
NONE = -(1 << 63)


def products(a: np.ndarray, b: np.ndarray):
    """a @ b, exact for Python's integers too."""
    return a @ b if a.dtype != object else (a * b).sum(axis=-1)


class Lists:
    """A block of integer vectors with a sorted list per dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.lists = np.argsort(self.vectors, axis=0, kind="stable").T  # by dimension, ascending
        self.values = np.sort(self.vectors, axis=0).T

    def search(self, query_id: int, q: np.ndarray, k: int, floor: int = NONE) -> list[tuple[int, int]]:
        """The k best (vec_id, score) of at least ``floor``, ties to the smaller id; never the query's own id."""
        n = len(self.ids)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        seen = self.ids == query_id
        best_at, best = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        read, step = 0, FIRST_STEP
        while True:
            to = min(n, read + step) if len(up) + len(down) else n
            met = np.zeros(n, dtype=bool)
            if len(up) + len(down):
                met[self.lists[up, n - to : n - read].ravel()] = True
                met[self.lists[down, read:to].ravel()] = True
            if to == n:
                met[:] = True
            new = np.flatnonzero(met & ~seen)
            if len(new):
                seen[new] = True
                at, score = np.concatenate([best_at, new]), np.concatenate([best, products(self.vectors[new], q)])
                if len(at) > 8 * k:  # all that could be among the k best
                    keep = score >= np.partition(score, len(score) - k)[len(score) - k]
                    at, score = at[keep], score[keep]
                order = np.lexsort((self.ids[at], -score))[:k]
                best_at, best = at[order], score[order]
            if to == n:
                break
            bound = int(products(self.values[up, n - to], q[up]) + products(self.values[down, to - 1], q[down]))
            if bound < floor or len(best) == k and best[-1] > bound:
                break
            read, step = to, 2 * step
        return [(i, s) for i, s in zip(self.ids[best_at].tolist(), best.tolist(), strict=True) if s >= floor]


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def fits(dim: int, a: float, b: float) -> bool:
    """Whether no sum of products of 256 times such components can overflow 64 bits."""
    return dim * (int(a) + 1) * (int(b) + 1) < 1 << 45  # 2^61 after scaling by 2^16


def scaled(a: np.ndarray, exact: bool) -> np.ndarray:
    """256 a as 64-bit integers, or as Python's."""
    if not exact:
        return (a * 256).astype(np.int64)
    whole = np.frompyfunc(lambda x: int(x) * 256 if abs(x) >= 1 << 52 else int(x * 256), 1, 1)
    return whole(a).astype(object)


def integers(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v array<double>, dim: the components floor(256 x) / 256, exact, of vectors that take part."""
    x: Column = F.col(f"`{vec_col}`").cast("array<double>")
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine)
    return rows.select("vec_id", F.transform("x", lambda c: F.when(F.abs(c) >= float(1 << 52), c).otherwise(F.floor(c * 256) / 256.0)).alias("v"), F.size("x").alias("dim"))


def _searched(rows: DataFrame, k: int) -> DataFrame:
    """RESULT for rows (dim, b, kind, vec_id, v, floor): kind 0 a block's vectors, kind 1 queries that meet it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, parts, largest, lists = None, [], [], 0.0, {}
        for b in batches:
            out: list[tuple[int, int, int, int]] = []
            dims, blocks, kinds, own, floors = (b.column(i).to_pylist() for i in (0, 1, 2, 3, 5))
            at = 0
            while at < b.num_rows:  # runs of rows of one block and kind
                end = at + 1
                while end < b.num_rows and (dims[end], blocks[end], kinds[end]) == (dims[at], blocks[at], kinds[at]):
                    end += 1
                if (dims[at], blocks[at]) != key:
                    key, ids, parts, lists = (dims[at], blocks[at]), [], [], {}
                v = matrix(b.column(4).slice(at, end - at))
                if kinds[at] == 0:
                    ids += own[at:end]
                    parts.append(v)
                elif ids:
                    largest = max(float(np.abs(p).max(initial=0.0)) for p in parts)
                    exact = not fits(v.shape[1], largest, float(np.abs(v).max(initial=0.0)))
                    if exact not in lists:
                        lists[exact] = Lists(np.array(ids, dtype=np.int64), scaled(np.concatenate(parts), exact))
                    for i, q, floor in zip(own[at:end], scaled(v, exact), floors[at:end], strict=True):
                        for vec, s in lists[exact].search(i, q, k, floor):
                            over = int(s >= 1 << 63) - int(s < -(1 << 63))
                            out.append((i, vec, 0 if over else s, over))
                at = end
            if out:
                cols = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["query_id", "vec_id", "score", "over"])

    ordered = rows.repartition("dim", "b").sortWithinPartitions("dim", "b", "kind")
    return ordered.mapInArrow(tidy(run), RESULT)


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score; ``is_query`` is a condition on ``vec_id``, whatever the id's column is called."""
    rows = materialize(integers(vectors, id_col, vec_col).dropDuplicates(["vec_id", "v"]), "vectors")
    blocks = max(1, -(-rows.count() // block))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    stored = rows.select("dim", own.alias("b"), F.lit(0).alias("kind"), "vec_id", "v", F.lit(NONE).alias("floor"))
    asked = rows.where(is_query).select("dim", own.alias("home"), "vec_id", "v")
    first = materialize(_searched(stored.union(asked.select("dim", F.col("home").alias("b"), F.lit(1), "vec_id", "v", F.lit(NONE))), k), "first")
    if blocks > 1:
        # of a query with several vectors, or scores beyond 64 bits, nothing is known
        known = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max(F.abs("over")).alias("over")).where(f"n = {k} and over = 0").select(F.col("query_id").alias("vec_id"), "least")
        away = asked.join(known, "vec_id", "left").withColumn("b", F.explode(F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda x: x != F.col("home"))))
        more = away.select("dim", "b", F.lit(1).alias("kind"), "vec_id", "v", F.coalesce("least", F.lit(NONE)).alias("floor"))
        found = first.union(_searched(stored.union(more), k))
    else:
        found = first
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("over"), F.desc("score"), "vec_id"))
    held = F.when(F.col("over") == 0, F.col("score")).otherwise(F.raise_error(F.lit("a score among the best does not fit into 64 bits")).cast("long"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", held.alias("score"))


#: The same for DuckDB, over the view embeddings.
SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
