"""The star-schema tables seen as a sample-by-mutation matrix.

customers are samples (two to an individual), parts are mutations (two to a site), and a line item
that was not returned makes its customer a carrier of its part. A returned line at a site where the
customer carries nothing is missing data. Nations are populations; region, nation, segment and customer
form a hierarchy. The same in SQL is ``PRELUDE``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..durable import dealt
from ..model import VariantGraph


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("sample_idx"), F.expr("c_custkey div 2").alias("individual_idx"), F.col("c_nationkey").alias("pop_id"))


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("mut_id"), F.expr("1000 + 10 * (p_partkey div 2)").alias("position"), F.col("p_brand").alias("ref"), F.col("p_type").alias("alt"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    order = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("sample_idx"))
    return line.join(order, "l_orderkey").select(F.col("l_partkey").alias("mut_id"), "sample_idx", (F.col("l_returnflag") == "R").alias("returned"))


def carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mut_id, sample_idx: distinct; dealt by mutation, so that what groups by mutation needs no other shuffle."""
    return dealt(_lines(spark, sf_dir).where("not returned").select("mut_id", "sample_idx"), "mut_id").distinct()


def miss_carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """position, sample_idx: one aggregation by site and sample."""
    at = dealt(_lines(spark, sf_dir).select(F.expr("1000 + 10 * (mut_id div 2)").alias("position"), "sample_idx", "returned"), "position").groupBy("position", "sample_idx").agg(F.bool_and("returned").alias("only"))
    return at.where("only").select("position", "sample_idx")


def individual_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mut_id, individual_idx, dosage: copies that an individual carries."""
    return carriers(spark, sf_dir).groupBy("mut_id", F.expr("sample_idx div 2").alias("individual_idx")).agg(F.count("*").alias("dosage"))


def hierarchy(spark: SparkSession, sf_dir: str) -> VariantGraph:
    """customer < (nation, segment) < nation < region, ids bottom-up; every part is a mutation, every 13th unmapped."""
    c = read(spark, sf_dir, "customer")
    names = c.select("c_mktsegment").distinct().withColumn("seg", F.row_number().over(Window.orderBy("c_mktsegment")) - 1)  # a handful
    n = c.count()
    own = c.join(F.broadcast(names), "c_mktsegment").select("c_custkey", "c_nationkey", "seg")
    at = lambda k: F.lit(n + k)
    leaf = own.select((at(0) + F.col("c_nationkey") * 5 + F.col("seg")).alias("parent"), F.col("c_custkey").alias("child"))
    mid = own.select((at(125) + F.col("c_nationkey")).alias("parent"), (at(0) + F.col("c_nationkey") * 5 + F.col("seg")).alias("child")).distinct()
    nations = read(spark, sf_dir, "nation")
    top = nations.select((at(150) + F.col("n_regionkey")).alias("parent"), (at(125) + F.col("n_nationkey")).alias("child"))
    edges = leaf.union(mid).union(top).select(F.col("parent").cast("long").alias("parent"), F.col("child").cast("long").alias("child"))
    nodes = edges.select(F.col("parent").alias("node_id")).union(edges.select("child")).distinct().select("node_id", (F.col("node_id") < n).alias("is_sample"), F.lit(None).cast("long").alias("num_coals"))
    m = mutations(spark, sf_dir)
    node = F.when(F.col("mut_id") % 13 != 0, at(125) + F.expr("mut_id * 7 % 30"))
    placed = m.select("mut_id", node.cast("long").alias("node_id"), F.when(F.col("mut_id") % 4 == 0, at(125) + F.expr("mut_id * 3 % 25")).cast("long").alias("miss_node_id"))
    s = samples(spark, sf_dir).select("sample_idx", F.col("sample_idx").alias("node_id"), "individual_idx", "pop_id")
    people = s.select("individual_idx").distinct().select("individual_idx", F.concat(F.lit("I"), F.col("individual_idx").cast("string")).alias("individual_id"))
    pops = nations.select(F.col("n_nationkey").alias("pop_id"), F.col("n_name").alias("description"))
    return VariantGraph(nodes, edges, m.withColumn("time", F.lit(None).cast("int")), placed, s, people, pops)


#: The same tables as common table expressions for DuckDB.
PRELUDE = """
samples AS (SELECT c_custkey AS sample_idx, c_custkey // 2 AS individual_idx, c_nationkey AS pop_id FROM customer),
mutations AS (SELECT p_partkey AS mut_id, 1000 + 10 * (p_partkey // 2) AS position, p_brand AS ref, p_type AS alt FROM part),
lines AS (SELECT l_partkey AS mut_id, o_custkey AS sample_idx, l_returnflag = 'R' AS returned FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
carriers AS (SELECT DISTINCT mut_id, sample_idx FROM lines WHERE NOT returned),
miss_carriers AS (SELECT 1000 + 10 * (mut_id // 2) AS position, sample_idx FROM lines GROUP BY ALL HAVING bool_and(returned)),
dosages AS (SELECT mut_id, sample_idx // 2 AS individual_idx, count(*) AS dosage FROM carriers GROUP BY ALL)
"""
#: The hierarchy, likewise.
TREE = """
cust AS (SELECT c_custkey, c_nationkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS seg, count(*) OVER () AS n FROM customer),
size AS (SELECT count(*) AS n FROM customer),
edges AS (SELECT n + c_nationkey * 5 + seg AS parent, c_custkey AS child FROM cust
  UNION ALL SELECT DISTINCT n + 125 + c_nationkey, n + c_nationkey * 5 + seg FROM cust
  UNION ALL SELECT n + 150 + n_regionkey, n + 125 + n_nationkey FROM nation, size),
nodes AS (SELECT parent AS node_id FROM edges UNION SELECT child FROM edges),
mutation_node AS (SELECT p_partkey AS mut_id, CASE WHEN p_partkey % 13 <> 0 THEN n + 125 + p_partkey * 7 % 30 END AS node_id,
  CASE WHEN p_partkey % 4 = 0 THEN n + 125 + p_partkey * 3 % 25 END AS miss_node_id FROM part, size)
"""
