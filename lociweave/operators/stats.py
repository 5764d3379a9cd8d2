"""Counts and statistics of mutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import cut, dealt

KEY = ("position", "ref", "alt")


def allele_counts(carriers: DataFrame, mutations: DataFrame, miss_carriers: DataFrame, total: int, span: tuple[int, int] | None = None, only: DataFrame | None = None) -> DataFrame:
    """position, ref, alt, alt_count, miss_count, total, one row per distinct key.

    ``span`` is [first, last); ``only`` (sample_idx) restricts who is counted, not the total. Counts are
    taken by mutation and by site before anything is joined.
    """
    if span:
        mutations = mutations.where((F.col("position") >= span[0]) & (F.col("position") < span[1]))
        miss_carriers = miss_carriers.where((F.col("position") >= span[0]) & (F.col("position") < span[1]))
        carriers = carriers.join(mutations.select("mut_id"), "mut_id", "left_semi")
    if only is not None:
        carriers, miss_carriers = (d.join(only.select("sample_idx"), "sample_idx", "left_semi") for d in (carriers, miss_carriers))
    n = carriers.groupBy("mut_id").agg(F.count("*").alias("n"))
    miss = miss_carriers.groupBy("position").agg(F.count("*").alias("m"))
    keyed = mutations.join(n, "mut_id", "left").groupBy(*KEY).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("alt_count"))
    return keyed.join(miss, "position", "left").select(*KEY, "alt_count", F.coalesce("m", F.lit(0)).alias("miss_count"), F.lit(total).cast("long").alias("total"))


def zygosity(dosages: DataFrame, mutations: DataFrame, miss_carriers: DataFrame, individuals: int) -> DataFrame:
    """position, ref, alt, n_aa0 (no copy; missing individuals included), n_het, n_hom, miss (haplotypes)."""
    own = dosages.groupBy("mut_id").agg(F.count_if(F.col("dosage") == 1).alias("het"), F.count_if(F.col("dosage") == 2).alias("hom"))
    miss = miss_carriers.groupBy("position").agg(F.count("*").alias("m"))
    keyed = mutations.join(own, "mut_id", "left").groupBy(*KEY).agg(F.coalesce(F.sum("het"), F.lit(0)).alias("n_het"), F.coalesce(F.sum("hom"), F.lit(0)).alias("n_hom"))
    return keyed.join(miss, "position", "left").select(*KEY, (F.lit(individuals) - F.col("n_het") - F.col("n_hom")).alias("n_aa0"), "n_het", "n_hom", F.coalesce("m", F.lit(0)).alias("miss"))


def allele_frequency(counts: DataFrame) -> DataFrame:
    """Adds freq: the count over what isn't missing, 0 where nothing is left."""
    return counts.withColumn("freq", F.coalesce(F.try_divide("alt_count", F.col("total") - F.col("miss_count")), F.lit(0.0)))


def population_frequency(carriers: DataFrame, samples: DataFrame) -> DataFrame:
    """mut_id, pop_id, freq of carriers in each population that has one."""
    size = samples.groupBy("pop_id").agg(F.count("*").alias("size"))
    n = carriers.join(samples.select("sample_idx", "pop_id"), "sample_idx").groupBy("mut_id", "pop_id").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(size) if size.limit(10_001).count() <= 10_000 else size, "pop_id").select("mut_id", "pop_id", (F.col("n") / F.col("size")).alias("freq"))


def complete_individuals(reach: DataFrame, samples: DataFrame, ploidy: int = 2) -> DataFrame:
    """node_id, complete: individuals all of whose haplotypes are below (reach: node_id, node_id of a sample as sample_node)."""
    own = reach.join(samples.select(F.col("node_id").alias("sample_node"), "individual_idx"), "sample_node")
    each = own.groupBy("node_id", "individual_idx").agg(F.countDistinct("sample_node").alias("k")).where(F.col("k") == ploidy)
    return each.groupBy("node_id").agg(F.count("*").alias("complete"))


def coalescences(edges: DataFrame, nodes: DataFrame, complete: DataFrame) -> DataFrame:
    """node_id, num_coals: individuals completed at a node and not below it already (multi-trees)."""
    below = edges.join(complete.withColumnRenamed("node_id", "child"), "child").select(F.col("parent").alias("node_id"), (-F.col("complete")).alias("n"))
    own = nodes.where("not is_sample").select("node_id", F.lit(0).cast("long").alias("n"))
    change = complete.select("node_id", F.col("complete").alias("n")).join(own.select("node_id"), "node_id", "left_semi").union(below)
    return own.union(change).groupBy("node_id").agg(F.sum("n").alias("num_coals"))


def graph_statistics(graph) -> DataFrame:
    """metric, value."""
    count = lambda df, name: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
    span = graph.mutations.agg(F.min("position").alias("a"), (F.max("position") + 1).alias("b"))
    parts = [count(getattr(graph, t), f"num_{t}") for t in ("nodes", "edges", "samples", "mutations", "populations")]
    parts += [span.select(F.lit("first_position").alias("metric"), F.col("a").alias("value")), span.select(F.lit("end_position").alias("metric"), F.col("b").alias("value"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def matrix_difference(one: DataFrame, two: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """keys, side, n: carriers that only one of two matrices (keys, sample_idx) has."""
    cols = [*keys, "sample_idx"]
    both = one.select(*cols, F.lit(1).alias("_n")).union(two.select(*cols, F.lit(-1).alias("_n")))
    left = dealt(both, *cols).groupBy(*cols).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return left.withColumn("side", F.when(F.col("_n") > 0, "first").otherwise("second")).groupBy(*keys, "side").agg(F.sum(F.abs("_n")).alias("n"))


def hwe_p(het: Column, hom_a: Column, hom_b: Column) -> Column:
    """Exact two-sided Hardy-Weinberg p-value, by the recurrence over heterozygote counts.

    Starting from probability 1 at the parity-matched count nearest the mode, terms to both sides follow
    by ratios; the p-value is the share of the sum not above the observed count's term. Two folds, in the JVM, over states
    of fixed size: the first finds the sum and the observed term, the second what is not above it.
    """
    rare = (2 * F.least(hom_a, hom_b) + het).cast("long")
    n = (het + hom_a + hom_b).cast("long")
    common = 2 * n - rare
    raw = F.floor(rare * common / (2 * n).cast("double")).cast("long")
    mid = F.when((raw % 2) != (rare % 2), F.when(raw + 1 <= rare, raw + 1).otherwise(raw - 1)).otherwise(raw)
    state = "struct<h:bigint,p:double,sum:double,seen:double,top:double,total:double>"
    fields = lambda *values: F.struct(*[v.alias(name) for v, name in zip(values, ("h", "p", "sum", "seen", "top", "total"), strict=True)]).cast(state)
    one, zero = F.lit(1.0), F.lit(0.0)

    def down(acc, _):
        h, r = acc["h"], (rare - acc["h"]) / 2
        return step(acc, h - 2, acc["p"] * h * (h - 1.0) / (4.0 * (r + 1) * (n - h - r + 1)))

    def up(acc, _):
        h, r = acc["h"], (rare - acc["h"]) / 2
        return step(acc, h + 2, acc["p"] * 4.0 * r * (n - h - r) / ((h + 2.0) * (h + 1.0)))

    def step(acc, h, p):
        return fields(h, p, acc["sum"] + F.when(p <= acc["top"], p).otherwise(zero), F.when(h == het, p).otherwise(acc["seen"]), acc["top"], acc["total"])

    def again(acc):
        top = acc["seen"] * (1 + 1e-12)
        return fields(mid, one, F.when(top >= 1.0, one).otherwise(zero), acc["seen"], top, acc["sum"])

    steps = lambda k: F.when(k >= 1, F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int"))).otherwise(F.array().cast("array<int>"))
    both = lambda start, end: F.aggregate(steps(F.floor((rare - mid) / 2)), F.aggregate(steps(F.floor(mid / 2)), start, down, lambda acc: fields(mid, one, acc["sum"], acc["seen"], acc["top"], acc["total"])), up, end)
    first = both(fields(mid, one, one, F.when(mid == het, one).otherwise(zero), F.lit(float("inf")), zero), again)
    return F.when(n == 0, one).otherwise(both(first, lambda acc: F.least(one, acc["sum"] / acc["total"])))


def hwe(counts: DataFrame) -> DataFrame:
    """mut_id, p of counts (mut_id, het, hom_a, hom_b): worked out once for mutations with equal counts."""
    counts = cut(counts.select("mut_id", "het", "hom_a", "hom_b"), "counts")
    p = counts.select("het", "hom_a", "hom_b").distinct()
    p = cut(p.select("*", hwe_p(F.col("het"), F.col("hom_a"), F.col("hom_b")).alias("p")), "p")
    return counts.join(p, ["het", "hom_a", "hom_b"]).select("mut_id", "p")


def trailing_mean(histogram: DataFrame, share: float) -> DataFrame:
    """mean of the smallest ``share`` of a histogram's observations (value, n)."""
    from pyspark.sql import Window

    seen = F.sum("n").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    own = histogram.groupBy("value").agg(F.sum("n").alias("n")).withColumns({"before": F.coalesce(seen, F.lit(0)), "limit": F.floor(F.lit(share) * total)})
    taken = F.greatest(F.lit(0), F.least(F.col("n"), F.col("limit") - F.col("before")))
    return own.agg(F.try_divide(F.sum(F.col("value") * taken), F.sum(taken)).alias("mean"))
