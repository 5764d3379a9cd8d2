"""Values along paths: the kernel of closures, counts, products and traversals.

A wave starts from the given values and crosses one edge a round; a node's result is the sum of all
waves that reach it, that is over all paths. Rounds end when no value moves, after as many as the
longest path has edges; a cycle is an error. Each round is one join and one partial-aggregated groupBy, cut to a table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import cut, dealt, is_empty

DOWN, UP = "down", "up"


def step(edges: DataFrame, direction: str) -> DataFrame:
    """(node, next): edges in the direction of travel."""
    if direction not in (DOWN, UP):
        raise ValueError(f"direction must be {DOWN!r} or {UP!r}")
    a, b = ("parent", "child") if direction == DOWN else ("child", "parent")
    return edges.select(F.col(a).alias("node"), F.col(b).alias("next"))


def propagate(edges: DataFrame, start: DataFrame, direction: str, keys: tuple[str, ...] = (), agg: Callable[[Column], Column] = F.sum, stop: Callable[[], Column] | None = None, rounds: int | None = None, spread: bool = False) -> DataFrame:
    """node, *keys, value: over all paths from ``start`` (node, *keys, value), combined by ``agg``.

    ``stop`` is a condition on a wave's rows that travel no further (they are still counted).
    ``agg`` must be associative and commutative: sum, bit_xor, max, min. ``spread``: few rows of a wave meet, so they are
    dealt by node and keys before they are grouped, in tasks of bounded size.
    """
    moves = step(edges, direction)
    met = lambda df: (dealt(df, "node", *keys) if spread else df).groupBy("node", *keys).agg(agg(F.col("value")).alias("value"))
    wave = cut(start.groupBy("node", *keys).agg(agg(F.col("value")).alias("value")), "wave")
    waves, n = wave, 0
    while rounds is None or n < rounds:
        go = wave if stop is None else wave.where(~stop())
        wave = cut(met(go.join(moves, "node").select(F.col("next").alias("node"), *keys, "value")), "wave")
        if is_empty(wave):
            break
        waves, n = waves.union(wave), n + 1
        if n == 100 and rounds is None and stop is None:
            limit = edges.select("parent").distinct().count()  # no path has more edges
        if n >= 100 and rounds is None and stop is None and n > limit:
            raise ValueError("the graph has a cycle")
    return met(waves)


def closure(edges: DataFrame, seeds: DataFrame, direction: str) -> DataFrame:
    """seed, node, n_paths: everything reached from each of ``seeds`` (node), itself included."""
    start = seeds.select("node", F.col("node").alias("seed"), F.lit(1).cast("long").alias("value"))
    return propagate(edges, start, direction, ("seed",), spread=True).select("seed", "node", F.col("value").alias("n_paths"))


def set_hash(*columns: str) -> tuple[Column, Column, Column]:
    """Aggregates that tell sets of rows apart without gathering them: a count and two sums of 64-bit hashes, taken by
    halves in 64 bits (a set has less than 2^31 rows)."""

    def total(seed: int) -> Column:
        h = F.xxhash64(F.lit(seed), *[F.col(c) for c in columns])
        return F.sum(F.shiftright(h, 32)).cast("decimal(38,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.sum(h.bitwiseAND(F.lit((1 << 32) - 1)))

    return F.count("*").alias("set_n"), total(1).alias("set_a"), total(2).alias("set_b")


def sample_range(graph) -> tuple[int, int] | None:
    """First and last id, if the samples are the nodes of one gapless range, in order, and leaves: then no join tells them."""
    node = F.col("node_id")
    n, own, lo, hi, moved = graph.samples.agg(F.count("*"), F.count_distinct("node_id"), F.min("node_id"), F.max("node_id"), F.count_if(~node.eqNullSafe(F.col("sample_idx")))).first()
    if not n or moved or not n == own == hi - lo + 1 or graph.edges.where(F.col("parent").between(lo, hi)).take(1):
        return None
    return lo, hi


def legs(graph) -> tuple[DataFrame, DataFrame]:
    """(node, sample_idx) of edges to samples, and the (parent, child) edges that paths may go on from."""
    span = sample_range(graph)
    if span:
        low = F.col("child").between(*span)
        return graph.edges.where(low).select(F.col("parent").alias("node"), F.col("child").alias("sample_idx")), graph.edges.where(~low)
    at = graph.samples.select("sample_idx", F.col("node_id").alias("child"))
    return graph.edges.join(at, "child").select(F.col("parent").alias("node"), "sample_idx"), graph.edges.join(graph.edges.select(F.col("parent").alias("child")), "child", "left_semi").select("parent", "child")


def beneath(graph, seeds: DataFrame, found: tuple[DataFrame, DataFrame] | None = None) -> list[DataFrame]:
    """Parts of (seed, sample_idx, n_paths): the samples beneath ``seeds`` (node), over all paths. A pair is in one part.

    Seeds without an inner node beneath them are read off their edges, dealt by node; only the others walk. ``found``:
    the graph's :func:`legs`.
    """
    leaf, inner = found or legs(graph)
    kids = dealt(leaf, "node").groupBy("node", "sample_idx").agg(F.count("*").alias("k"))
    own = seeds.join(graph.samples.select(F.col("node_id").alias("node"), "sample_idx"), "node").select(F.col("node").alias("seed"), "sample_idx", F.lit(1).cast("long").alias("n_paths"))
    deep = cut(seeds.join(inner.select(F.col("parent").alias("node")), "node", "left_semi").distinct(), "deep")
    if is_empty(deep):
        return [own, kids.join(seeds, "node").select(F.col("node").alias("seed"), "sample_idx", F.col("k").alias("n_paths"))]
    flat = kids.join(seeds.join(deep, "node", "left_anti"), "node").select(F.col("node").alias("seed"), "sample_idx", F.col("k").alias("n_paths"))
    reach = cut(closure(inner, deep, DOWN), "reach")
    far = kids.join(reach, "node").select("seed", "sample_idx", (F.col("k") * F.col("n_paths")).alias("n"))
    return [own, flat, dealt(far, "seed").groupBy("seed", "sample_idx").agg(F.sum("n").alias("n_paths"))]


def carriers(graph, columns: tuple[str, ...] = ("mut_id",)) -> DataFrame:
    """mut_id (or other columns of the mutations), sample_idx, n_paths: the sparse matrix, from the graph."""
    return _carried(graph, "node_id", columns)


def miss_carriers(graph) -> DataFrame:
    """mut_id, sample_idx, n_paths of missing data."""
    return _carried(graph, "miss_node_id")


#: A node with this many mutations has its samples joined with them in cells of about these sizes, in tasks of so many rows.
#: Samples of a cell are a range, their number a multiple of 8: in Parquet they repeat byte by byte from mutation to mutation.
CROWD, MUTATIONS, SAMPLES, ROWS = 64, 16_384, 2_048, 1 << 26


def _carried(graph, column: str, columns: tuple[str, ...] = ("mut_id",)) -> DataFrame:
    found = legs(graph)
    at = graph.mutation_node.where(F.col(column).isNotNull()).select("mut_id", F.col(column).alias("seed"))
    at = _alike(graph, at, found[1])
    crowded = cut(at.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") >= CROWD).select("seed"), "crowded")
    if columns != ("mut_id",):
        at = at.join(graph.mutations, "mut_id").select("seed", *columns)
    out = []
    if is_empty(crowded):
        few = at
    else:
        few = at.join(crowded, "seed", "left_anti")
        below = cut(fold(DataFrame.union, beneath(graph, crowded.select(F.col("seed").alias("node")), found)), "below")
        out = [_product(at.join(crowded, "seed", "left_semi"), below, columns)]
    few = cut(few, "at")
    if not is_empty(few):
        parts = beneath(graph, few.select(F.col("seed").alias("node")).distinct(), found)
        out = [p.join(few, "seed").select(*columns, "sample_idx", "n_paths") for p in parts] + out
    return fold(DataFrame.union, out) if out else few.select(*columns, F.lit(None).cast("long").alias("sample_idx"), F.lit(None).cast("long").alias("n_paths"))


def _alike(graph, at: DataFrame, inner: DataFrame) -> DataFrame:
    """(mut_id, seed), a seed above inner nodes replaced by the smallest with equal children: many nodes above the same few
    would each walk to all samples."""
    deep = at.select(F.col("seed").alias("parent")).distinct().join(inner, "parent", "left_semi").join(graph.samples.select(F.col("node_id").alias("parent")), "parent", "left_anti")
    keys = cut(graph.edges.join(deep, "parent", "left_semi").groupBy(F.col("parent").alias("seed")).agg(*set_hash("child")), "keys")
    if is_empty(keys):
        return at
    first = keys.groupBy("set_n", "set_a", "set_b").agg(F.min("seed").alias("canon"))
    canon = cut(keys.join(first, ["set_n", "set_a", "set_b"]).select("seed", "canon"), "canon")
    return at.join(canon, "seed", "left").select("mut_id", F.coalesce("canon", "seed").alias("seed"))


def _product(at: DataFrame, below: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Every mutation of a seed with every sample beneath it. The output may be the product of two large tables: it is made
    in cells of both, dealt to as many tasks as its size asks for, and a task holds the samples of one cell."""
    sizes = cut(at.groupBy("seed").agg(F.count("*").alias("n_muts")).join(below.groupBy("seed").agg(F.count("*").alias("n_samples")), "seed"), "sizes")
    total = sizes.agg(F.sum(F.col("n_muts").cast("double") * F.col("n_samples"))).first()[0] or 0
    tasks = int(min(10_000, max(int(at.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), total // ROWS)))
    cells = sizes.select("seed", F.ceil(F.col("n_muts") / MUTATIONS).alias("k"), F.ceil(F.col("n_samples") / SAMPLES).alias("l"))
    own = lambda n, *cols: F.pmod(F.xxhash64(*cols), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one = at.join(cells, "seed").select("seed", *columns, own("k", *columns).alias("a"), every("l").alias("b"))
    place = F.row_number().over(Window.partitionBy("seed").orderBy("sample_idx")) - 1
    two = below.withColumn("b", F.floor(place / SAMPLES)).join(cells.drop("l"), "seed").select("seed", "sample_idx", "n_paths", every("k").alias("a"), "b")
    cell = ["seed", "a", "b"]
    return one.repartition(tasks, *cell).hint("merge").join(two.repartition(tasks, *cell), cell).select(*columns, "sample_idx", "n_paths")


def heights(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, height: the longest path down to a leaf."""
    leaves = nodes.select(F.col("node_id").alias("node")).join(edges.select(F.col("parent").alias("node")), "node", "left_anti")
    wave = cut(leaves.select("node", F.lit(0).alias("value")), "wave")
    waves, moves, h = wave, step(edges, UP), 0
    while True:
        h += 1
        wave = cut(wave.select("node").join(moves, "node").select(F.col("next").alias("node"), F.lit(h).alias("value")).distinct(), "wave")
        if is_empty(wave):
            break
        waves = waves.union(wave)
    return waves.groupBy(F.col("node").alias("node_id")).agg(F.max("value").alias("height"))
