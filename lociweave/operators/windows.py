"""Genomic windows, and what falls into them. All ranges are [first, last)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def in_range(position: Column, first, last) -> Column:
    return (position >= first) & (position < last)


def in_range_except_edges(position: Column, first, last) -> Column:
    return (position > first) & (position < last - 1)


def overlaps(a_first: Column, a_last: Column, b_first: Column, b_last: Column) -> Column:
    """Whether two ranges share a position; touching ends don't."""
    return (a_first < b_last) & (b_first < a_last)


def by_bp(spark: SparkSession, first: int, last: int, size: int, overlap: int = 1) -> DataFrame:
    """window_id, begin, end: windows of ``size`` positions, one each size / overlap."""
    if size <= 0 or overlap <= 0 or size % overlap:
        raise ValueError("the window size must be a positive multiple of the overlap")
    step = size // overlap
    n = max(0, -(-(last - first) // step))
    if n > 65535:
        raise ValueError("more than 65535 windows")
    return spark.range(n).select(F.col("id").alias("window_id"), (F.lit(first) + F.col("id") * step).alias("begin"), (F.lit(first) + F.col("id") * step + size).alias("end"))


def map_segments(recomb_map: DataFrame) -> DataFrame:
    """p0, p1, cm0, cm1: the lines between points of a map (position, cm). The map is one chromosome's."""
    order = Window.orderBy("position")
    return recomb_map.select(F.lag("position").over(order).alias("p0"), F.col("position").alias("p1"), F.lag("cm").over(order).alias("cm0"), F.col("cm").alias("cm1")).where("p0 is not null")


def by_cm(recomb_map: DataFrame, first: int, last: int, size: float, overlap: int = 1) -> DataFrame:
    """window_id, begin, end: windows of ``size`` centimorgans, by linear interpolation on the map."""
    seg = map_segments(recomb_map)
    lo_hi = recomb_map.where(in_range(F.col("position"), first, last)).agg(F.min("cm"), F.max("cm")).first()
    if lo_hi[0] is None:
        return recomb_map.sparkSession.createDataFrame([], "window_id long, begin long, end long")
    step = size / overlap
    n = max(1, int(-(-(lo_hi[1] - lo_hi[0]) // step)))
    if n > 65535:
        raise ValueError("more than 65535 windows")
    marks = recomb_map.sparkSession.range(n + overlap).select("id", (F.lit(lo_hi[0]) + F.col("id") * step).alias("at"))
    placed = marks.join(F.broadcast(seg), (F.col("at") >= F.col("cm0")) & (F.col("at") < F.col("cm1")), "left")
    position = F.when(F.col("p0").isNull(), F.lit(last)).otherwise(F.least(F.lit(last), F.col("p0") + F.floor((F.col("at") - F.col("cm0")) / (F.col("cm1") - F.col("cm0")) * (F.col("p1") - F.col("p0")))))
    edge = placed.groupBy("id").agg(F.min(position).cast("long").alias("position"))
    begin, end = edge.alias("b"), edge.alias("e")
    out = begin.join(end, F.col("e.id") == F.col("b.id") + overlap).where(F.col("b.id") < n)
    return out.select(F.col("b.id").alias("window_id"), F.col("b.position").alias("begin"), F.col("e.position").alias("end"))


def assign(mutations: DataFrame, windows: DataFrame, size: int | None = None) -> DataFrame:
    """window_id, mut_id: the mutations in each window.

    An interval join by buckets: windows are spelled out over the buckets they touch, so the join has an
    equi-key however many windows there are. ``size``: bucket width (by default the widest window).
    """
    width = size or (windows.agg(F.max(F.col("end") - F.col("begin"))).first()[0] or 1)
    own = windows.where("end > begin").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("begin") / width), F.floor((F.col("end") - 1) / width))))
    at = mutations.select("mut_id", "position", F.floor(F.col("position") / width).alias("bucket"))
    return at.join(own, "bucket").where(in_range(F.col("position"), F.col("begin"), F.col("end"))).select("window_id", "mut_id")


def split(carriers: DataFrame, mutations: DataFrame, windows: DataFrame) -> DataFrame:
    """window_id, mut_id, sample_idx: the matrix cut into windows (to be written partitioned by window)."""
    return carriers.join(assign(mutations, windows), "mut_id").select("window_id", "mut_id", "sample_idx")
