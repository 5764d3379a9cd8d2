"""Shared plumbing of the text operators: tables, durable intermediate results, Arrow batches."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..durable import brief_shuffles, cut, discard

__all__ = ["WORD", "brief_shuffles", "discard", "doc_texts", "first_by_hash", "free_names", "ids_and_texts", "materialize", "partitions", "table", "tidy"]

#: Words are runs of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a batch that a Python function gets.
BATCH_BYTES = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again, in small batches."""
    return cut(df, name, BATCH_BYTES)


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow whose worker gives its free memory back when a task ends: Spark keeps
    workers for the tasks that follow, and what they hold counts against the executor."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            libc = _libc()
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return whole


def free_names(columns: list[str], *names: str) -> list[str]:
    """Internal column names that no input column has, whatever its case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def first_by_hash(rows: DataFrame, group: str, order: list[str], most: Column) -> DataFrame:
    """At most so many rows of each group: the first by ``order``, whose first column is a hash.

    Rows with larger hashes than about twice as many have go before any sort, so no task sees a whole group.
    The groups are few (one row each is broadcast).
    """
    n, place = free_names(rows.columns, "n", "place")
    sizes = rows.groupBy(group).agg(F.count("*").alias(n))
    part = F.shiftrightunsigned(order[0], 32) / F.lit(float(1 << 32))
    near = rows.join(F.broadcast(sizes), group).where(part * F.col(n) <= 2 * most + 40)
    placed = near.withColumn(place, F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return placed.where(F.col(place) <= most).select(*rows.columns)


def partitions(df: DataFrame) -> int:
    """Shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def ids_and_texts(batches: Iterator[pa.RecordBatch], limit: int = 4_000_000):
    """(ids, texts) of (id, text) batches, in blocks of bounded characters; a null text is '', a null id None."""
    for batch in batches:
        ids, column = batch.column(0).to_pylist(), batch.column(1)
        start, n = 0, batch.num_rows
        sizes = np.zeros(n + 1, dtype=np.int64)
        if n:
            np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), out=sizes[1:])
        while start < n:
            end = max(start + 1, int(np.searchsorted(sizes, sizes[start] + limit, side="right")) - 1)
            yield ids[start:end], [x or "" for x in column.slice(start, end - start).to_pylist()]
            start = end


def doc_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, whatever else the table holds."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
