"""Readers and writers: variant text, graphs as Parquet, small tables, tree sequences."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import FORMAT_VERSION, MISSING, SCHEMAS, VariantGraph

# variant text


def read_variants(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """position, ref, alt, is_missing, sample_idx: by extension, from variant text or Parquet."""
    if path.endswith((".vcf", ".vcf.gz", ".vcf.bz2")):
        out = genotypes(spark, path)
    elif path.endswith(".parquet"):
        out = spark.read.parquet(path)
    else:
        raise ValueError(f"unknown kind of variant file: {path}")
    if first is not None:
        out = out.where((F.col("position") >= first) & (F.col("position") < last))
    return out


def sites(spark: SparkSession, path: str) -> DataFrame:
    """contig, position, ref, alts, gts array: the rows of a variant text file."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.length("value") > 0))
    f = F.split("value", "\t")
    gt = F.array_position(F.split(F.get(f, F.lit(8)), ":"), "GT").cast("int")
    calls = F.transform(F.slice(f, 10, F.size(f)), lambda x: F.get(F.split(x, ":"), gt - 1))
    at = lambda i: F.get(f, F.lit(i))  # noqa: E731  a filter may be moved above the one on comments
    rows = lines.select(at(0).alias("contig"), at(1).try_cast("long").alias("position"), at(3).alias("ref"), at(4).alias("alts"), calls.alias("gts"))
    if rows.select("contig").distinct().limit(2).count() > 1:
        raise ValueError("more than one contig in the file")
    return rows


def individual_ids(spark: SparkSession, path: str) -> DataFrame:
    """individual_idx, individual_id from the header line."""
    head = spark.read.text(path).where(F.col("value").startswith("#CHROM")).limit(1)
    return head.select(F.posexplode(F.slice(F.split("value", "\t"), 10, 1 << 30))).select(F.col("pos").cast("long").alias("individual_idx"), F.col("col").alias("individual_id"))


def metadata(spark: SparkSession, path: str) -> dict:
    """ploidy, individuals and phased, checked to be the same in every row."""
    g = F.col("gts")
    shape = F.struct(F.size(F.split(F.get(g, F.lit(0)), r"[|/]")).alias("ploidy"), F.size(g).alias("individuals"), (~F.exists(g, lambda x: F.contains(x, F.lit("/")))).alias("phased"))
    found = sites(spark, path).select(shape.alias("s")).distinct().limit(2).collect()
    if len(found) > 1:
        raise ValueError("ploidy, individuals or phasing differ between rows")
    return found[0].s.asDict() if found else {"ploidy": 0, "individuals": 0, "phased": True}


def genotypes(spark: SparkSession, path: str) -> DataFrame:
    """position, ref, alt, is_missing, sample_idx: a row for each haplotype with an alternative or missing."""
    calls = sites(spark, path).select("position", "ref", F.split("alts", ",").alias("alts"), F.posexplode("gts").alias("individual", "gt"))
    alleles = calls.select("position", "ref", "alts", "individual", F.posexplode(F.split("gt", r"[|/]")).alias("copy", "a"), F.size(F.split("gt", r"[|/]")).alias("ploidy"))
    seen = alleles.where("a <> '0'")
    miss = F.col("a") == MISSING
    return seen.select("position", "ref", F.when(miss, F.lit(MISSING)).otherwise(F.expr("try_element_at(alts, try_cast(a as int))")).alias("alt"), miss.alias("is_missing"), (F.col("individual") * F.col("ploidy") + F.col("copy")).cast("long").alias("sample_idx"))


def variant_lists(rows: DataFrame) -> DataFrame:
    """position, ref, alt, is_missing, samples array, missing rows first in each site."""
    return rows.groupBy("position", "ref", "alt", "is_missing").agg(F.array_sort(F.collect_list("sample_idx")).alias("samples")).orderBy("position", F.desc("is_missing"), "ref", "alt")


def count_variants(rows: DataFrame, first: int | None = None, last: int | None = None) -> int:
    if first is not None:
        rows = rows.where((F.col("position") >= first) & (F.col("position") < last))
    return rows.select("position", "ref", "alt").distinct().count()


def restrict(rows: DataFrame, first: float, last: float, kind: str = "bp") -> DataFrame:
    """Rows of a range: ``bp`` positions, ``variant`` numbers, or ``share`` of the whole range (0 to 1)."""
    if kind == "bp":
        lo, hi = first, last
    elif kind == "share":
        a, b = rows.agg(F.min("position"), F.max("position") + 1).first()
        lo, hi = a + int(first * (b - a)), a + int(last * (b - a))
    elif kind == "variant":
        from ..durable import ranked

        keys = ranked(rows.select("position", "ref", "alt").distinct(), "position", "ref", "alt", name="number")
        return rows.join(keys.where((F.col("number") >= first) & (F.col("number") < last)).drop("number"), ["position", "ref", "alt"], "left_semi")
    else:
        raise ValueError(f"unknown kind of range: {kind}")
    return rows.where((F.col("position") >= lo) & (F.col("position") < hi))


# small tables


def read_map(spark: SparkSession, path: str, left: str, right: str, sep: str = "\t") -> DataFrame:
    """Two named columns of a text table; a ragged row is an error, of equal keys the first row of the file stays."""
    rows = spark.read.csv(path, sep=sep, header=True, mode="FAILFAST").select(left, right).withColumn("_at", F.monotonically_increasing_id())
    return rows.groupBy(left).agg(F.min_by(F.struct(right), "_at").alias("_first")).select(left, F.col("_first")[right].alias(right))


def read_node_ids(spark: SparkSession, path: str) -> DataFrame:
    """node_id: one number a line, blank lines skipped."""
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.trim("value").cast("long").alias("node_id"))


def read_recombination_map(spark: SparkSession, path: str) -> DataFrame:
    """position, cm."""
    t = spark.read.csv(path, sep="\t", header=True)
    return t.select(F.col("`Position(bp)`").cast("long").alias("position"), F.col("`Map(cM)`").cast("double").alias("cm"))


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """window_id, begin, end from lines "begin end"."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(f[0].cast("long").alias("begin"), f[1].cast("long").alias("end"))
    from ..durable import ranked

    return ranked(rows, "begin", "end", name="window_id").select("window_id", "begin", "end")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", header=True, mode="overwrite")


# graphs

_SORTED = {"nodes": ["node_id"], "edges": ["parent", "child"], "mutations": ["position", "ref", "alt"], "mutation_node": ["mut_id"], "samples": ["sample_idx"], "individuals": ["individual_idx"], "populations": ["pop_id"]}


def save(graph: VariantGraph, path: str, simplify: bool = True) -> None:
    """One Parquet table each, sorted so that readers skip by id and position."""
    if simplify:
        from ..operators.edit import simplify as lean

        graph = lean(graph)
    for name, order in _SORTED.items():
        getattr(graph, name).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/{name}")
    span = graph.specified_range or (None, None)
    meta = [(*FORMAT_VERSION, graph.ploidy, graph.phased, *span)]
    graph.spark.createDataFrame(meta, "major int, minor int, ploidy int, phased boolean, range_first long, range_last long").write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> VariantGraph:
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta.major != FORMAT_VERSION[0]:
        raise ValueError(f"version {meta.major} of the format can't be read")
    tables = {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in SCHEMAS.items()}
    span = None if meta.range_first is None else (meta.range_first, meta.range_last)
    return VariantGraph(**tables, ploidy=meta.ploidy, phased=meta.phased, specified_range=span)


def save_subset(graph: VariantGraph, path: str, direction: str, seeds: list[int]) -> bool:
    """Save what the listed mutations (down) or samples (up) need; nothing is written for no seeds."""
    from ..operators.edit import subset_mutations, subset_samples

    if not seeds:
        return False
    part = subset_mutations(graph, graph.spark.createDataFrame([(s,) for s in seeds], "mut_id long")) if direction == "down" else subset_samples(graph, seeds)
    save(part, path)
    return True


def write_carriers(carriers: DataFrame, mutations: DataFrame, path: str, bucket: int = 1_000_000) -> None:
    """The matrix as rows, partitioned by position."""
    out = carriers.join(mutations, "mut_id").withColumn("bucket", F.floor(F.col("position") / bucket))
    out.repartition("bucket").sortWithinPartitions("position", "ref", "alt", "sample_idx").write.partitionBy("bucket").mode("overwrite").parquet(path)


def graph_json(graph: VariantGraph, start: list[int], show_mutations: bool = True) -> str:
    """Nodes and edges reached downwards from ``start``, as elements for a graph viewer. An error beyond
    100,000 nodes or 1,000,000 edges."""
    from ..operators.propagate import DOWN, closure

    seeds = graph.spark.createDataFrame([(s,) for s in start], "node long")
    seen = closure(graph.edges, seeds, DOWN).select("node").distinct()
    muts = graph.mutation_node.groupBy(F.col("node_id").alias("node")).agg(F.array_sort(F.collect_list("mut_id")).alias("muts"))
    nodes = seen.join(muts, "node", "left").orderBy("node").limit(100_001).collect()
    edges = graph.edges.join(seen.withColumnRenamed("node", "parent"), "parent", "left_semi").select("parent", "child").orderBy("parent", "child").limit(1_000_001).collect()
    if len(nodes) > 100_000 or len(edges) > 1_000_000:
        raise ValueError("too large a part of the graph for a viewer")
    label = lambda r: f"{r.node}" + (f" {r.muts}" if show_mutations and r.muts else "")
    return json.dumps({"nodes": [{"data": {"id": str(r.node), "label": label(r)}} for r in nodes], "edges": [{"data": {"source": str(e.parent), "target": str(e.child)}} for e in edges]})


# tree sequences


def from_tree_sequence(nodes: DataFrame, edges: DataFrame, sites: DataFrame, mutations: DataFrame, binary: bool = False) -> DataFrame:
    """position, ref, alt, sample_idx: the carriers that a tree sequence's tables describe.

    nodes: id, is_sample; edges: left, right, parent, child; sites: id, position, ancestral_state;
    mutations: id, site, node, derived_state, parent. An edge counts at a site it spans; a mutation's
    samples are those below its node less those of mutations that follow it there.
    """
    from ..durable import cut, is_empty

    at = mutations.join(sites.select(F.col("id").alias("site"), "position", "ancestral_state"), "site").select("id", "site", "position", "ancestral_state", "node", "derived_state", F.col("parent").alias("before"))
    wave = cut(at.select("id", "position", "node"), "wave")
    below = wave
    while True:
        spans = (F.col("position") >= F.col("left")) & (F.col("position") < F.col("right")) & (F.col("node") == F.col("parent"))
        wave = cut(wave.join(edges, spans).select("id", "position", F.col("child").alias("node")), "wave")
        if is_empty(wave):
            break
        below = below.union(wave)
    samples = nodes.where("is_sample").select(F.col("id").alias("node"))
    reach = cut(below.join(samples, "node").select("id", "node").distinct(), "reach")
    later = at.where("before is not null and before >= 0").select(F.col("before").alias("id"), F.col("id").alias("next"))
    lost = later.join(reach.select(F.col("id").alias("next"), "node"), "next").select("id", "node").distinct()
    own = reach.join(lost, ["id", "node"], "left_anti").join(at.drop("node"), "id").where("derived_state <> ancestral_state")
    alt = F.lit("1") if binary else F.col("derived_state")
    return own.select(F.col("position").cast("long").alias("position"), F.col("ancestral_state").alias("ref"), alt.alias("alt"), F.col("node").cast("long").alias("sample_idx")).distinct()
