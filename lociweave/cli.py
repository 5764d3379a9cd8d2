"""Command line: construct, process, split, merge and subset graphs.

    python -m lociweave.cli construct in.vcf out.graph [--range A B] [--binary] [--flip] [--populations FILE] [--reduce N] [--ignore-missing]
    python -m lociweave.cli process freq|zygosity in.graph out.tsv [--range A B]
    python -m lociweave.cli split in.graph out --size N
    python -m lociweave.cli merge out.graph a.graph[:OFFSET] b.graph[:OFFSET] ... [--no-combine] [--by-samples]
    python -m lociweave.cli subset in.graph out.graph --samples FILE | --mutations FILE
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .model import MISSING
from .operators import edit, propagate, stats, transforms, windows
from .sources import files


def construct(spark: SparkSession, source: str, out: str, span=None, binary: bool = False, flip: bool = False, populations: str | None = None, rounds: int = 0, ignore_missing: bool = False) -> None:
    rows = files.read_variants(spark, source, *(span or (None, None)))
    meta, people = files.metadata(spark, source), files.individual_ids(spark, source)
    n, ploidy = meta["individuals"] * meta["ploidy"], meta["ploidy"]
    samples = spark.range(n).select(F.col("id").alias("sample_idx"), F.expr(f"id div {ploidy}").alias("individual_idx"), F.lit(None).cast("int").alias("pop_id"))
    pops = None
    if populations:
        own, pops = transforms.assign_populations(people, spark.read.csv(populations, sep="\t", schema="individual_id string, population string"))
        samples = samples.drop("pop_id").join(own, "individual_idx").select("sample_idx", "individual_idx", "pop_id")
    miss = rows.where(F.col("is_missing")).select("position", "sample_idx").distinct()
    seen = rows.where(F.col("alt") != MISSING).select("position", "ref", "alt", "sample_idx")
    seen = transforms.binary(seen).distinct() if binary else seen
    if flip:  # a sample without data carries no allele, whichever is the reference
        seen = transforms.flip_to_major(seen, samples).join(miss, ["position", "sample_idx"], "left_anti").select("position", "ref", "alt", "sample_idx")
    keys = edit.ranked(seen.select("position", "ref", "alt").distinct(), "position", "ref", "alt", name="mut_id")
    graph = edit.build(seen.join(keys, ["position", "ref", "alt"]).select("mut_id", "sample_idx").distinct(), keys, samples, ploidy, rounds, None if ignore_missing else miss)
    graph = graph.having(individuals=people, phased=meta["phased"], specified_range=span, **({"populations": pops} if pops is not None else {}))
    files.save(graph, out)


def process(spark: SparkSession, what: str, source: str, out: str, span=None) -> None:
    graph = files.load(spark, source)
    x = propagate.carriers(graph).select("mut_id", "sample_idx").distinct()
    miss = propagate.miss_carriers(graph).join(graph.mutations, "mut_id").select("position", "sample_idx").distinct()
    if what == "freq":
        files.write_tsv(stats.allele_counts(x, graph.mutations, miss, graph.num_samples(), span), out)
    else:
        if graph.ploidy != 2 or span:
            raise ValueError("zygosity is for whole diploid graphs")
        own = x.join(graph.samples, "sample_idx").groupBy("mut_id", "individual_idx").agg(F.count("*").alias("dosage"))
        files.write_tsv(stats.zygosity(own, graph.mutations, miss, graph.num_individuals()), out)


def split(spark: SparkSession, source: str, out: str, size: int) -> None:
    graph = files.load(spark, source)
    first, last = graph.specified_range or graph.bp_range()
    parts = windows.split(propagate.carriers(graph), graph.mutations, windows.by_bp(spark, first, last, size))
    parts.repartition("window_id").write.partitionBy("window_id").mode("errorifexists").parquet(out)


def merge(spark: SparkSession, out: str, sources: list[str], combine: bool = True, by_samples: bool = False) -> None:
    pairs = [s.rsplit(":", 1) if s.rsplit(":", 1)[-1].isdigit() else (s, "0") for s in sources]
    if int(pairs[0][1]):
        raise ValueError("the first graph's offset must be 0")
    files.save(edit.merge([files.load(spark, p) for p, _ in pairs], combine, by_samples, offsets=[int(o) for _, o in pairs]), out)


def subset(spark: SparkSession, source: str, out: str, samples: str | None, mutations: str | None) -> None:
    ids = [r.node_id for r in files.read_node_ids(spark, samples or mutations).collect()]
    files.save_subset(files.load(spark, source), out, "up" if samples else "down", ids)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="lociweave")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("construct")
    c.add_argument("source"), c.add_argument("out"), c.add_argument("--range", type=int, nargs=2), c.add_argument("--binary", action="store_true")
    c.add_argument("--flip", action="store_true"), c.add_argument("--populations"), c.add_argument("--reduce", type=int, default=0), c.add_argument("--ignore-missing", action="store_true")
    c = sub.add_parser("process")
    c.add_argument("what", choices=["freq", "zygosity"]), c.add_argument("source"), c.add_argument("out"), c.add_argument("--range", type=int, nargs=2)
    c = sub.add_parser("split")
    c.add_argument("source"), c.add_argument("out"), c.add_argument("--size", type=int, required=True)
    c = sub.add_parser("merge")
    c.add_argument("out"), c.add_argument("sources", nargs="+"), c.add_argument("--no-combine", action="store_true"), c.add_argument("--by-samples", action="store_true")
    c = sub.add_parser("subset")
    c.add_argument("source"), c.add_argument("out")
    which = c.add_mutually_exclusive_group(required=True)
    which.add_argument("--samples"), which.add_argument("--mutations")
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    span = tuple(a.range) if getattr(a, "range", None) else None
    if a.command == "construct":
        construct(spark, a.source, a.out, span, a.binary, a.flip, a.populations, a.reduce, a.ignore_missing)
    elif a.command == "process":
        process(spark, a.what, a.source, a.out, span)
    elif a.command == "split":
        split(spark, a.source, a.out, a.size)
    elif a.command == "merge":
        merge(spark, a.out, a.sources, not a.no_combine, a.by_samples)
    else:
        subset(spark, a.source, a.out, a.samples, a.mutations)


if __name__ == "__main__":
    main()
