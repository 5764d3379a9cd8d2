"""Implicit matrix products with the sample-by-mutation matrix X.

``up``: V[K x samples] X -> K x mutations; ``down``: V[K x mutations] X^T -> K x samples. Dense
matrices are long tables (row, idx, value); outputs hold every row and every mutation or sample, zeros
included. One equi-join and one partial-aggregated groupBy each; nothing of X or V is collected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .propagate import DOWN, UP, propagate


def parity(x: Column) -> Column:
    """Sum over GF(2): the bool product."""
    return F.bit_xor(x)


def _whole(sums: DataFrame, v: DataFrame, dim: DataFrame, idx: str) -> DataFrame:
    """Every (row, idx), 0 where nothing was summed. Rows of V are few; they are a checked distinct."""
    rows = v.select("row").distinct()
    return rows.join(dim.select(F.col(idx).alias("idx")), how="cross").join(sums, ["row", "idx"], "left").select("row", "idx", F.coalesce("value", F.lit(0)).alias("value"))


def _index(by_individual: bool, ploidy: int, column: str = "sample_idx") -> Column:
    return F.expr(f"{column} div {ploidy}") if by_individual else F.col(column)


def matmul_up(carriers: DataFrame, v: DataFrame, mutations: DataFrame, by_individual: bool = False, ploidy: int = 2, agg: Callable[[Column], Column] = F.sum) -> DataFrame:
    """row, idx (mutation), value: V X. carriers: mut_id, sample_idx."""
    x = carriers.select(F.col("mut_id"), _index(by_individual, ploidy).alias("idx"))
    sums = x.join(v, "idx").groupBy("row", F.col("mut_id").alias("idx")).agg(agg(F.col("value")).alias("value"))
    return _whole(sums, v, mutations, "mut_id")


def matmul_down(carriers: DataFrame, v: DataFrame, samples: DataFrame, by_individual: bool = False, ploidy: int = 2, agg: Callable[[Column], Column] = F.sum) -> DataFrame:
    """row, idx (sample or individual), value: V X^T."""
    x = carriers.select(F.col("mut_id").alias("idx"), _index(by_individual, ploidy).alias("own"))
    sums = x.join(v, "idx").groupBy("row", F.col("own").alias("idx")).agg(agg(F.col("value")).alias("value"))
    dim = samples.select(_index(by_individual, ploidy).alias("own")).distinct()
    return _whole(sums, v, dim, "own")


def dot_product(carriers: DataFrame, v: DataFrame, dim: DataFrame, direction: str) -> DataFrame:
    """idx, value: the product with one row (v: idx, value)."""
    one = v.withColumn("row", F.lit(0))
    out = matmul_up(carriers, one, dim) if direction == UP else matmul_down(carriers, one, dim)
    return out.select("idx", "value")


def check_shape(v: DataFrame, size: int) -> DataFrame:
    """Raise unless every row of V has the indexes 0 .. size - 1 once."""
    bad = v.groupBy("row").agg(F.count("*").alias("n"), F.countDistinct("idx").alias("d"), F.min("idx").alias("lo"), F.max("idx").alias("hi")).where((F.col("n") != size) | (F.col("d") != size) | (F.col("lo") != 0) | (F.col("hi") != size - 1))
    if bad.take(1):
        raise ValueError(f"every row needs the indexes 0 to {size - 1} once")
    return v


def matmul_miss_up(miss_carriers: DataFrame, v: DataFrame, mutations: DataFrame) -> DataFrame:
    """row, idx (mutation), value: V times the matrix of missing data, a site's for all its mutations.

    miss_carriers: position, sample_idx.
    """
    sums = miss_carriers.withColumnRenamed("sample_idx", "idx").join(v, "idx").groupBy("row", "position").agg(F.sum("value").alias("value"))
    own = sums.join(mutations.select("mut_id", "position"), "position").select("row", F.col("mut_id").alias("idx"), "value")
    return _whole(own, v, mutations, "mut_id")


def matmul_miss_down(miss_carriers: DataFrame, v: DataFrame, mutations: DataFrame, samples: DataFrame) -> DataFrame:
    """row, idx (sample), value: what missing data adds to V X^T. A site's mutations are summed first."""
    sites = v.withColumnRenamed("idx", "mut_id").join(mutations.select("mut_id", "position"), "mut_id").groupBy("row", "position").agg(F.sum("value").alias("value"))
    sums = sites.join(miss_carriers, "position").groupBy("row", F.col("sample_idx").alias("idx")).agg(F.sum("value").alias("value"))
    return _whole(sums, v, samples, "sample_idx")


def xtx(dosages: DataFrame, mutations: DataFrame) -> DataFrame:
    """mut_id, value: the sum of squared individual dosages (mut_id, individual_idx, dosage)."""
    sums = dosages.groupBy("mut_id").agg(F.sum(F.col("dosage") * F.col("dosage")).alias("v"))
    return mutations.select("mut_id").join(sums, "mut_id", "left").select("mut_id", F.coalesce("v", F.lit(0)).alias("value"))


# on the graph itself


def node_values(graph, v: DataFrame, direction: str, by_individual: bool = False, init: DataFrame | None = None, agg: Callable[[Column], Column] = F.sum) -> DataFrame:
    """row, node_id, value of every node: the products before they are read off.

    v: row, idx, value (samples going up, mutations going down). init: node_id, row, value, the
    starting value of nodes (see :func:`init_vector`), which travels along paths too.
    """
    if direction == UP:
        at = graph.samples.select(_index(by_individual, graph.ploidy).alias("idx"), F.col("node_id").alias("node"))
    else:
        at = graph.mutation_node.where("node_id is not null").select(F.col("mut_id").alias("idx"), F.col("node_id").alias("node"))
    start = v.join(at, "idx").select("node", "row", "value")
    if init is not None:
        start = start.unionByName(init.select(F.col("node_id").alias("node"), "row", "value"))
    found = propagate(graph.edges, start, direction, ("row",), agg)
    rows = v.select("row").distinct()
    every = rows.join(graph.nodes.select("node_id"), how="cross")
    return every.join(found.withColumnRenamed("node", "node_id"), ["row", "node_id"], "left").select("row", "node_id", F.coalesce("value", F.lit(0)).alias("value"))


def init_vector(graph, init: DataFrame) -> DataFrame:
    """node_id, row, value: one value per row for every node, samples too (init: row, value)."""
    return graph.nodes.select("node_id").join(F.broadcast(init), how="cross")


def init_xtx(graph, rows: DataFrame) -> DataFrame:
    """node_id, row, value: twice the coalescence count of every node; all must be set."""
    if graph.nodes.where("not is_sample and num_coals is null").take(1):
        raise ValueError("coalescence counts are not set for all nodes")
    return graph.nodes.select("node_id", F.coalesce(2 * F.col("num_coals"), F.lit(0)).alias("value")).join(F.broadcast(rows.select("row").distinct()), how="cross")


def read_mutations(graph, values: DataFrame) -> DataFrame:
    """row, mut_id, value: node values at the mutations' nodes; 0 for unmapped ones."""
    rows = values.select("row").distinct().join(graph.mutation_node.select("mut_id", "node_id"), how="cross")
    return rows.join(values, ["row", "node_id"], "left").select("row", "mut_id", F.coalesce("value", F.lit(0)).alias("value"))


def read_samples(graph, values: DataFrame, by_individual: bool = False) -> DataFrame:
    """row, idx, value: node values at the samples, summed by individual if asked."""
    own = graph.samples.select("node_id", _index(by_individual, graph.ploidy).alias("idx"))
    return values.join(own, "node_id").groupBy("row", "idx").agg(F.sum("value").alias("value"))
