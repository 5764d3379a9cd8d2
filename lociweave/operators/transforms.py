"""Transforms of variant rows (position, ref, alt, sample_idx), one row per carrier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import ranked

KEY = ("position", "ref", "alt")


def explode_alleles(sites: DataFrame) -> DataFrame:
    """position, ref, alt, sample_idx from (position, ref, alts "A,C", sample_idx, allele number)."""
    alts = F.split("alts", ",")
    return sites.where("allele > 0").select("position", "ref", F.element_at(alts, F.col("allele").cast("int")).alias("alt"), "sample_idx")


def binary(rows: DataFrame) -> DataFrame:
    """All alternatives of a site as one, called 1; a sample with two of them is there twice."""
    return rows.select("position", "ref", F.lit("1").alias("alt"), "sample_idx")


def merge_duplicates(rows: DataFrame) -> DataFrame:
    """position, ref, alt, samples array: rows with one key together, sorted."""
    return rows.groupBy(*KEY).agg(F.array_sort(F.collect_list("sample_idx")).alias("samples"))


def flip_to_major(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """Swap an alternative that most samples carry with the reference.

    The swapped alternative becomes the reference of its site; the old reference becomes an alternative
    carried by whoever had no alternative at all. Only sites that flip are complemented.
    """
    n = samples.count()
    counts = rows.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") > F.greatest(F.floor(F.lit(n) / 2), F.lit(1)))
    major = counts.groupBy("position").agg(F.max_by(F.struct("ref", "alt"), F.struct("n", "alt")).alias("m")).select("position", F.col("m.ref").alias("old"), F.col("m.alt").alias("new"))
    joined = rows.join(major, "position", "left")
    kept = joined.where(F.col("new").isNull() | (F.col("alt") != F.col("new"))).select("position", F.coalesce("new", "ref").alias("ref"), "alt", "sample_idx")
    flipped = major.join(samples.select("sample_idx"), how="cross").join(rows.select("position", "sample_idx"), ["position", "sample_idx"], "left_anti")
    return kept.union(flipped.select("position", F.col("new").alias("ref"), F.col("old").alias("alt"), "sample_idx"))


def skip_empty(variants: DataFrame) -> DataFrame:
    """Variants (samples array) that someone carries."""
    return variants.where(F.size("samples") > 0)


def expand_copies(rows: DataFrame, ploidy: int = 2) -> DataFrame:
    """Haplotypes of unphased rows (individual_idx, copies; null copies: missing, all haplotypes)."""
    first = F.col("individual_idx") * ploidy
    last = first + F.coalesce("copies", F.lit(ploidy)) - 1
    return rows.where(F.coalesce("copies", F.lit(1)) > 0).withColumn("sample_idx", F.explode(F.sequence(first, last))).drop("copies", "individual_idx")


def keep_individuals(rows: DataFrame, keep: DataFrame, ploidy: int = 2) -> DataFrame:
    """Rows of the individuals in ``keep`` (individual_idx), numbered anew in their order."""
    new = ranked(keep.select("individual_idx").distinct(), "individual_idx", name="new_idx").select("individual_idx", "new_idx")
    own = rows.withColumn("individual_idx", F.expr(f"sample_idx div {ploidy}")).join(new, "individual_idx")
    return own.select(*[c for c in rows.columns if c != "sample_idx"], (F.col("new_idx") * ploidy + F.col("sample_idx") % ploidy).alias("sample_idx"))


def trim(rows: DataFrame, k: int) -> DataFrame:
    """The first k samples."""
    return rows.where(F.col("sample_idx") < k)


def add_noise(rows: DataFrame, samples: DataFrame, false_negative: float, false_positive: float, seed: int = 0) -> DataFrame:
    """Drop carriers and add others at random, per allele in proportion to its carriers."""
    kept = rows.where(F.rand(seed) >= false_negative)
    n = samples.count()
    new = rows.groupBy(*KEY).agg(F.count("*").alias("n")).withColumn("draws", F.floor(F.col("n") * false_positive + F.rand(seed + 1))).where("draws > 0")
    drawn = new.withColumn("d", F.explode(F.sequence(F.lit(1), F.col("draws").cast("int")))).select(*KEY, F.floor(F.rand(seed + 2) * n).cast("long").alias("sample_idx")).distinct()
    return kept.union(drawn.join(rows, [*KEY, "sample_idx"], "left_anti").select(*rows.columns))


def assign_populations(individuals: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(individual_idx, pop_id), (pop_id, description): ids by first appearance in individual order.

    individuals: individual_idx, individual_id; mapping: individual_id, population. Every individual
    must be mapped.
    """
    first = mapping.dropDuplicates(["individual_id"])
    own = individuals.join(first, "individual_id", "left")
    if own.where("population is null").take(1):
        raise ValueError("an individual has no population")
    firsts = own.groupBy("population").agg(F.min("individual_idx").alias("at"))
    pops = ranked(firsts, "at", name="pop_id").select(F.col("pop_id").cast("int").alias("pop_id"), F.col("population").alias("description"))
    return own.join(pops.withColumnRenamed("description", "population"), "population").select("individual_idx", "pop_id"), pops
