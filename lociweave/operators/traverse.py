"""Orders and reachability over the graph.

Breadth- and depth-first orders have no visited set: they list one entry per path. They are sorts: give
every path the ranks of its steps, then breadth-first is by (length, ranks) and pre-order by ranks with
later children first, as a stack pops them. Post-order keeps the first path of each node and puts it
after its descendants.
"""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..durable import cut, is_empty, ranked
from .propagate import DOWN, UP, beneath, propagate, step

_LAST = 2147483647


def paths(edges: DataFrame, seeds: DataFrame, direction: str, backwards: bool = False) -> DataFrame:
    """node, ranks array<int>: every path from ``seeds`` (node, rank); equal nodes may repeat."""
    moves = step(edges, direction).withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("next")))
    sign = -1 if backwards else 1
    wave = cut(seeds.select("node", F.array((F.col("rank") * sign).cast("int")).alias("ranks")), "paths")
    out = wave
    while True:
        wave = cut(wave.join(moves, "node").select(F.col("next").alias("node"), F.concat("ranks", F.array((F.col("rank") * sign).cast("int"))).alias("ranks")), "paths")
        if is_empty(wave):
            return out
        out = out.union(wave)


def bfs_order(edges: DataFrame, seeds: DataFrame, direction: str) -> DataFrame:
    """ord, node_id: one entry per path."""
    all_paths = paths(edges, seeds, direction).withColumn("length", F.size("ranks"))
    return ranked(all_paths, "length", "ranks").select("ord", F.col("node").alias("node_id"))


def bfs_order_capped(edges: DataFrame, seeds: list[int], direction: str, width: int) -> list[int]:
    """Breadth-first order that queues every seed and drops later pushes onto a full queue: sequential by nature, so it runs in the
    driver over a graph that must be small (an error beyond a million edges)."""
    from collections import defaultdict, deque

    rows = step(edges, direction).orderBy("node", "next").limit(1_000_001).collect()
    if len(rows) > 1_000_000:
        raise ValueError("a capped breadth-first order needs a graph of at most a million edges")
    after = defaultdict(list)
    for r in rows:
        after[r.node].append(r.next)
    queue, out = deque(seeds), []
    while queue:
        node = queue.popleft()
        out.append(node)
        for n in after[node]:
            if len(queue) < width:
                queue.append(n)
    return out


def dfs_preorder(edges: DataFrame, seeds: DataFrame, direction: str) -> DataFrame:
    """ord, node_id: a stack's forward order, one entry per path."""
    return ranked(paths(edges, seeds, direction, backwards=True), "ranks").select("ord", F.col("node").alias("node_id"))


def dfs_postorder(edges: DataFrame, seeds: DataFrame, direction: str) -> DataFrame:
    """ord, node_id: every node once, after what is reached from it."""
    first = paths(edges, seeds, direction, backwards=True).groupBy("node").agg(F.min("ranks").alias("ranks"))
    return ranked(first.withColumn("key", F.concat("ranks", F.array(F.lit(_LAST)))), "key").select("ord", F.col("node").alias("node_id"))


def topo_order(edges: DataFrame, nodes: DataFrame, direction: str, seeds: DataFrame | None = None) -> DataFrame:
    """ord, node_id of what is reached (all nodes without seeds), by id: upwards ascending, downwards descending."""
    if seeds is None:
        found = nodes.select("node_id")
    else:
        start = seeds.select("node", F.lit(1).cast("long").alias("value"))
        found = propagate(edges, start, direction, agg=F.max).select(F.col("node").alias("node_id"))
    order = F.col("node_id") if direction == UP else F.desc("node_id")
    return ranked(found, order).select("ord", "node_id")


def topo_rank(heights: DataFrame) -> DataFrame:
    """node_id, topo: a bottom-up order of any graph, by height and id."""
    return ranked(heights, "height", "node_id", name="topo").select("node_id", "topo")


def ordered_nodes(nodes: DataFrame, direction: str) -> DataFrame:
    """ord, node_id: negative ids first, from the largest; downwards the reverse."""
    n = nodes.select("node_id", (F.col("node_id") >= 0).alias("plain"), F.abs("node_id").alias("size"))
    up = direction == UP
    return ranked(n, F.col("plain") if up else F.desc("plain"), F.col("size") if up else F.desc("size")).select("ord", "node_id")


def reach_counts(edges: DataFrame, seeds: DataFrame, direction: str) -> DataFrame:
    """node, value: paths from the seeds."""
    return propagate(edges, seeds.select("node", F.lit(1).cast("long").alias("value")), direction)


def shared_frontier(edges: DataFrame, seeds: DataFrame, direction: str) -> DataFrame:
    """node_id: the first nodes on the way that all (distinct) seeds reach. Multi-trees.

    A node is reached by all seeds if its path count is their number; it is on the frontier if none
    of its predecessors on the way is.
    """
    distinct = seeds.select("node").distinct()
    full = cut(reach_counts(edges, distinct, direction).where(F.col("value") == distinct.count()).select("node"), "full")
    behind = full.join(step(edges, direction), "node").select(F.col("next").alias("node"))
    return full.join(behind, "node", "left_anti").select(F.col("node").alias("node_id"))


def sample_counts(graph) -> DataFrame:
    """node_id, n: sample paths beneath every node."""
    start = graph.samples.select(F.col("node_id").alias("node"), F.lit(1).cast("long").alias("value"))
    return propagate(graph.edges, start, UP).select(F.col("node").alias("node_id"), F.col("value").alias("n"))


def samples_beneath(graph) -> DataFrame:
    """node_id, sample_idx, n_paths: rows, not lists, so no node's samples are gathered."""
    ends = graph.edges.select(F.col("parent").alias("node")).union(graph.samples.select("node_id")).distinct()
    return fold(DataFrame.union, beneath(graph, cut(ends, "ends"))).select(F.col("seed").alias("node_id"), "sample_idx", "n_paths")


def visit(edges: DataFrame, start: DataFrame, direction: str, combine=F.sum, stop=None) -> DataFrame:
    """User-defined propagation: ``combine`` merges values, ``stop`` prunes. See :func:`propagate`."""
    return propagate(edges, start, direction, agg=combine, stop=stop)


def haplotype(carriers: DataFrame, sample_idx: int) -> DataFrame:
    """mut_id: what one sample carries."""
    return carriers.where(F.col("sample_idx") == sample_idx).select("mut_id").distinct()


def hamming_from(carriers: DataFrame, samples: DataFrame, sample_idx: int) -> DataFrame:
    """sample_idx, distance of every sample from one: |a| + |b| - 2 |a and b|, in one pass over the carriers."""
    own = haplotype(carriers, sample_idx).withColumn("shared", F.lit(1))
    n = own.count()
    sums = carriers.join(own, "mut_id", "left").groupBy("sample_idx").agg((F.count("*") - 2 * F.count("shared")).alias("d"))
    return samples.select("sample_idx").join(sums, "sample_idx", "left").select("sample_idx", (F.coalesce("d", F.lit(0)) + n).alias("distance"))


__all__ = ["DOWN", "UP"]
