"""Registered queries over the star-schema tables, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import cut, dealt, ranked
from ..operators import assoc, edit, matmul, stats, transforms, traverse, windows
from ..operators import propagate as prop
from ..sources import star
from ..sources.star import PRELUDE, TREE

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, tree: bool = False, prelude: bool = True, recursive: bool = False):
    """Register a function of (spark, sf_dir); ``sql`` follows the common table expressions it needs."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            before = ", ".join(x.strip() for x in ((PRELUDE,) if prelude else ()) + ((TREE,) if tree else ()))
            joint = ("," if sql.lstrip().startswith("+") else "\n") if before else ""
            body = sql.lstrip().removeprefix("+")
            ORACLE_SQL[f.__name__] = (f"WITH {'RECURSIVE ' if recursive else ''}{before}{joint} {body}" if before else body)
        return f

    return add


def rows_of(v: DataFrame, *cols: str) -> DataFrame:
    return v.select(*cols)


def sample_vectors(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    """row, idx, value: K deterministic integer rows over samples."""
    s = star.samples(spark, sf_dir).select(F.col("sample_idx").alias("idx"))
    return s.withColumn("row", F.explode(F.array([F.lit(i) for i in range(k)]))).select("row", "idx", F.expr("(idx * 7 + row * 3) % 11").alias("value"))


def individual_vectors(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    s = star.samples(spark, sf_dir).select(F.col("individual_idx").alias("idx")).distinct()
    return s.withColumn("row", F.explode(F.array([F.lit(i) for i in range(k)]))).select("row", "idx", F.expr("(idx * 7 + row * 3) % 11").alias("value"))


def mutation_vectors(m: DataFrame, k: int = 3) -> DataFrame:
    return m.select(F.col("mut_id").alias("idx")).withColumn("row", F.explode(F.array([F.lit(i) for i in range(k)]))).select("row", "idx", F.expr("(idx * 5 + row * 2) % 7").alias("value"))


VS = "vs AS (SELECT row, sample_idx AS idx, (sample_idx * 7 + row * 3) % 11 AS value FROM samples, range(3) r(row))"
VI = "vi AS (SELECT row, idx, (idx * 7 + row * 3) % 11 AS value FROM (SELECT DISTINCT individual_idx AS idx FROM samples), range(3) r(row))"
VM = "vm AS (SELECT row, mut_id AS idx, (mut_id * 5 + row * 2) % 7 AS value FROM mutations, range(3) r(row))"

# counts and statistics

COUNTS = """SELECT m.position, m.ref, m.alt, coalesce(sum(n), 0)::BIGINT AS alt_count, any_value(coalesce(k, 0))::BIGINT AS miss_count, (SELECT count(*) FROM samples) AS total
FROM mutations m LEFT JOIN (SELECT mut_id, count(*) AS n FROM carriers {only} GROUP BY 1) USING (mut_id) LEFT JOIN (SELECT position, count(*) AS k FROM miss_carriers {only} GROUP BY 1) USING (position) {where} GROUP BY ALL"""
SPAN = (2000, 6000)


def _counts(spark, sf_dir, **kw) -> DataFrame:
    n = star.samples(spark, sf_dir).count()
    return stats.allele_counts(star.carriers(spark, sf_dir), star.mutations(spark, sf_dir), star.miss_carriers(spark, sf_dir), n, **kw)


@query(COUNTS.format(only="", where=""))
def g01_allele_counts(spark, sf_dir):
    return _counts(spark, sf_dir)


@query(COUNTS.format(only="", where=f"WHERE m.position >= {SPAN[0]} AND m.position < {SPAN[1]}"))
def g02_allele_counts_region(spark, sf_dir):
    return _counts(spark, sf_dir, span=SPAN)


@query(COUNTS.format(only="WHERE sample_idx % 3 = 0", where=""))
def g03_allele_counts_subset(spark, sf_dir):
    return _counts(spark, sf_dir, only=star.samples(spark, sf_dir).where("sample_idx % 3 = 0"))


@query("""SELECT position, ref, alt, (SELECT count(DISTINCT individual_idx) FROM samples) - sum(het)::BIGINT - sum(hom)::BIGINT AS n_aa0, sum(het)::BIGINT AS n_het, sum(hom)::BIGINT AS n_hom, any_value(coalesce(k, 0)) AS miss
FROM (SELECT m.*, coalesce(het, 0) AS het, coalesce(hom, 0) AS hom FROM mutations m LEFT JOIN (SELECT mut_id, count(*) FILTER (dosage = 1) AS het, count(*) FILTER (dosage = 2) AS hom FROM dosages GROUP BY 1) USING (mut_id))
LEFT JOIN (SELECT position, count(*) AS k FROM miss_carriers GROUP BY 1) USING (position) GROUP BY position, ref, alt""")
def g04_zygosity(spark, sf_dir):
    n = star.samples(spark, sf_dir).select("individual_idx").distinct().count()
    return stats.zygosity(star.individual_counts(spark, sf_dir), star.mutations(spark, sf_dir), star.miss_carriers(spark, sf_dir), n)


REACH = "+ down AS (SELECT node_id AS seed, node_id AS node, 1::BIGINT AS n FROM nodes UNION ALL SELECT seed, child, n FROM down JOIN edges ON node = parent)"


@query(REACH + """, ind AS (SELECT seed, sample_idx // 2 AS i FROM down JOIN samples ON node = sample_idx GROUP BY ALL HAVING count(DISTINCT node) = 2),
full_ AS (SELECT seed, count(*) AS c FROM ind GROUP BY 1), kids AS (SELECT parent, sum(c) AS c FROM edges JOIN full_ ON child = seed GROUP BY 1)
SELECT node_id, (coalesce(f.c, 0) - coalesce(k.c, 0))::BIGINT AS num_coals FROM nodes LEFT JOIN full_ f ON seed = node_id LEFT JOIN kids k ON parent = node_id, size WHERE node_id >= size.n""", tree=True, recursive=True)
def g05_coals(spark, sf_dir):
    g = star.hierarchy(spark, sf_dir)
    reach = traverse.samples_beneath(g).join(g.samples.select("sample_idx", F.col("node_id").alias("sample_node")), "sample_idx").select("node_id", "sample_node")
    complete = cut(stats.complete_individuals(reach, g.samples), "complete")
    return stats.coalescences(g.edges, g.nodes, complete)


@query("""SELECT 'num_nodes' AS metric, count(*) AS value FROM nodes UNION ALL SELECT 'num_edges', count(*) FROM edges UNION ALL SELECT 'num_samples', count(*) FROM samples
UNION ALL SELECT 'num_mutations', count(*) FROM mutations UNION ALL SELECT 'num_populations', count(*) FROM nation
UNION ALL SELECT 'first_position', min(position) FROM mutations UNION ALL SELECT 'end_position', max(position) + 1 FROM mutations""", tree=True)
def g08_stats(spark, sf_dir):
    return stats.graph_statistics(star.hierarchy(spark, sf_dir))


@query("""+ a AS (SELECT position, ref, alt, sample_idx FROM carriers JOIN mutations USING (mut_id)), b AS (SELECT position, ref, CASE WHEN mut_id % 50 = 0 THEN 'X' ELSE alt END AS alt, sample_idx FROM carriers JOIN mutations USING (mut_id))
SELECT position, ref, alt, side, count(*) AS n FROM (SELECT *, 'first' AS side FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT *, 'second' FROM (FROM b EXCEPT ALL FROM a)) GROUP BY ALL""")
def g09_graph_diff(spark, sf_dir):
    m = star.mutations(spark, sf_dir)
    a = star.carriers(spark, sf_dir).join(m, "mut_id").select("position", "ref", "alt", "sample_idx", "mut_id")
    b = a.withColumn("alt", F.when(F.col("mut_id") % 50 == 0, F.lit("X")).otherwise(F.col("alt")))
    return stats.matrix_difference(a, b)


@query()
def g10_hwe(spark, sf_dir):
    n = star.samples(spark, sf_dir).select("individual_idx").distinct().count()
    z = star.individual_counts(spark, sf_dir).groupBy("mut_id").agg(F.count_if(F.col("dosage") == 1).alias("het"), F.count_if(F.col("dosage") == 2).alias("hom"))
    counts = z.select("mut_id", "het", F.col("hom").alias("hom_a"), (F.lit(n) - F.col("het") - F.col("hom")).alias("hom_b"))
    return stats.hwe(counts).select("mut_id", F.round("p", 6).alias("p"))


@query("+ c AS (" + COUNTS.format(only="", where="") + ") SELECT position, ref, alt, round(CASE WHEN total = miss_count THEN 0 ELSE alt_count / (total - miss_count) END, 6) AS freq FROM c")
def g11_allele_freq(spark, sf_dir):
    return stats.allele_frequency(_counts(spark, sf_dir)).select("position", "ref", "alt", F.round("freq", 6).alias("freq"))


@query("SELECT mut_id, pop_id, round(count(*) / any_value(z.n), 6) AS freq FROM carriers JOIN samples USING (sample_idx) JOIN (SELECT pop_id, count(*) AS n FROM samples GROUP BY 1) z USING (pop_id) GROUP BY mut_id, pop_id")
def g12_pop_freq(spark, sf_dir):
    return stats.population_frequency(star.carriers(spark, sf_dir), star.samples(spark, sf_dir)).select("mut_id", "pop_id", F.round("freq", 6).alias("freq"))


@query("""+ h AS (SELECT value, count(*) AS n FROM (SELECT mut_id, count(*) AS value FROM carriers GROUP BY 1) GROUP BY 1),
w AS (SELECT value, n, coalesce(sum(n) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, floor(0.25 * sum(n) OVER ()) AS l FROM h),
t AS (SELECT value, greatest(0, least(n, l - b)) AS k FROM w) SELECT round(sum(value * k) / sum(k), 6) AS mean FROM t""")
def g13_trailing_mean(spark, sf_dir):
    h = star.carriers(spark, sf_dir).groupBy("mut_id").agg(F.count("*").alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    return stats.trailing_mean(h, 0.25).select(F.round("mean", 6).alias("mean"))


@query("SELECT 'nnz' AS metric, count(*) AS value FROM carriers UNION ALL SELECT 'missing', count(*) FROM miss_carriers")
def e13_naive_edges(spark, sf_dir):
    one = lambda d, n: d.agg(F.count("*").alias("value")).select(F.lit(n).alias("metric"), "value")
    return one(star.carriers(spark, sf_dir), "nnz").union(one(star.miss_carriers(spark, sf_dir), "missing"))


# products

UP_SQL = "SELECT r.row, m.mut_id AS idx, coalesce(v, 0)::BIGINT AS value FROM (SELECT DISTINCT row FROM {v}) r CROSS JOIN mutations m LEFT JOIN (SELECT row, mut_id, {agg} AS v FROM {x} JOIN {v} ON {on} = idx GROUP BY 1, 2) s ON s.row = r.row AND s.mut_id = m.mut_id"


@query(f"+ {VS} " + UP_SQL.format(v="vs", x="carriers", on="sample_idx", agg="sum(value)"))
def h01_matmul_up(spark, sf_dir):
    return matmul.matmul_up(star.carriers(spark, sf_dir), sample_vectors(spark, sf_dir), star.mutations(spark, sf_dir))


DOWN_SQL = "SELECT r.row, d.i AS idx, coalesce(v, 0)::BIGINT AS value FROM (SELECT DISTINCT row FROM vm) r CROSS JOIN (SELECT DISTINCT {i} AS i FROM samples) d LEFT JOIN (SELECT row, {i} AS i, {agg} AS v FROM {x} JOIN vm ON mut_id = idx GROUP BY 1, 2) s ON s.row = r.row AND s.i = d.i"


@query(f"+ {VM} " + DOWN_SQL.format(i="sample_idx", x="carriers", agg="sum(value)"))
def h02_matmul_down(spark, sf_dir):
    m = star.mutations(spark, sf_dir)
    return matmul.matmul_down(star.carriers(spark, sf_dir), mutation_vectors(m), star.samples(spark, sf_dir))


@query(f"+ {VI} " + UP_SQL.format(v="vi", x="carriers", on="sample_idx // 2", agg="sum(value)"))
def h03_up_individual(spark, sf_dir):
    return matmul.matmul_up(star.carriers(spark, sf_dir), individual_vectors(spark, sf_dir), star.mutations(spark, sf_dir), by_individual=True)


@query(f"+ {VM} " + DOWN_SQL.format(i="sample_idx // 2", x="carriers", agg="sum(value)"))
def h03_down_individual(spark, sf_dir):
    m = star.mutations(spark, sf_dir)
    return matmul.matmul_down(star.carriers(spark, sf_dir), mutation_vectors(m), star.samples(spark, sf_dir), by_individual=True)


UPWARD = "+ " + VS + ", up AS (SELECT row, idx AS node, value FROM vs {init} UNION ALL SELECT row, parent, value FROM up JOIN edges ON node = child), nv AS (SELECT row, node, sum(value) AS value FROM up GROUP BY 1, 2)"
AT_MUTS = " SELECT r.row, m.mut_id, coalesce(value, 0)::BIGINT AS value FROM mutation_node m CROSS JOIN range(3) r(row) LEFT JOIN nv ON nv.row = r.row AND node = node_id"


@query(UPWARD.format(init="") + " SELECT row, node AS node_id, value::BIGINT AS value FROM nv", tree=True, recursive=True)
def h04_emit_all_nodes(spark, sf_dir):
    return matmul.node_values(star.hierarchy(spark, sf_dir), sample_vectors(spark, sf_dir), prop.UP)


@query("SELECT mut_id, coalesce(v, 0)::BIGINT AS value FROM mutations LEFT JOIN (SELECT mut_id, sum(dosage * dosage) AS v FROM dosages GROUP BY 1) USING (mut_id)")
def h05_xtx(spark, sf_dir):
    return matmul.xtx(star.individual_counts(spark, sf_dir), star.mutations(spark, sf_dir))


@query(UPWARD.format(init="UNION ALL SELECT row, node_id, row + 1 FROM nodes, range(3) r(row)") + AT_MUTS, tree=True, recursive=True)
def h06_init_vector(spark, sf_dir):
    g, v = star.hierarchy(spark, sf_dir), sample_vectors(spark, sf_dir)
    init = matmul.init_vector(g, spark.createDataFrame([(i, i + 1) for i in range(3)], "row int, value long"))
    return matmul.read_mutations(g, matmul.node_values(g, v, prop.UP, init=init))


@query(UPWARD.format(init="UNION ALL SELECT row, node_id, (node_id + row) % 5 FROM nodes, range(3) r(row)") + AT_MUTS, tree=True, recursive=True)
def h07_init_matrix(spark, sf_dir):
    g, v = star.hierarchy(spark, sf_dir), sample_vectors(spark, sf_dir)
    init = g.nodes.select("node_id", F.explode(F.array([F.lit(i) for i in range(3)])).alias("row")).withColumn("value", F.expr("(node_id + row) % 5"))
    return matmul.read_mutations(g, matmul.node_values(g, v, prop.UP, init=init))


@query(f"+ {VS}, x AS (SELECT mut_id, sample_idx FROM miss_carriers JOIN mutations USING (position)) " + UP_SQL.format(v="vs", x="x", on="sample_idx", agg="sum(value)"))
def h08_miss_up(spark, sf_dir):
    return matmul.matmul_miss_up(star.miss_carriers(spark, sf_dir), sample_vectors(spark, sf_dir), star.mutations(spark, sf_dir))


@query(f"+ {VM}, x AS (SELECT mut_id, sample_idx FROM miss_carriers JOIN mutations USING (position)) " + DOWN_SQL.format(i="sample_idx", x="x", agg="sum(value)"))
def h08_miss_down(spark, sf_dir):
    m = star.mutations(spark, sf_dir)
    return matmul.matmul_miss_down(star.miss_carriers(spark, sf_dir), mutation_vectors(m), m, star.samples(spark, sf_dir))


@query(f"+ {VS} SELECT row, idx, value % 2 AS value FROM (" + UP_SQL.format(v="(SELECT row, idx, value % 2 AS value FROM vs)", x="carriers", on="sample_idx", agg="sum(value)") + ")")
def h09_bool_xor(spark, sf_dir):
    v = sample_vectors(spark, sf_dir).withColumn("value", F.col("value") % 2)
    return matmul.matmul_up(star.carriers(spark, sf_dir), v, star.mutations(spark, sf_dir), agg=matmul.parity)


@query("SELECT mut_id AS idx, coalesce(v, 0)::BIGINT AS value FROM mutations LEFT JOIN (SELECT mut_id, sum(sample_idx % 5) AS v FROM carriers GROUP BY 1) USING (mut_id)")
def h10_dot_product(spark, sf_dir):
    v = star.samples(spark, sf_dir).select(F.col("sample_idx").alias("idx"), (F.col("sample_idx") % 5).alias("value"))
    return matmul.dot_product(star.carriers(spark, sf_dir), v, star.mutations(spark, sf_dir), prop.UP)


@query("""SELECT sample_idx, coalesce(d, 0) + (SELECT count(*) FROM carriers WHERE sample_idx = 1) AS distance FROM samples LEFT JOIN
(SELECT c.sample_idx, count(*) - 2 * count(o.mut_id) AS d FROM carriers c LEFT JOIN (SELECT mut_id FROM carriers WHERE sample_idx = 1) o USING (mut_id) GROUP BY 1) USING (sample_idx)""")
def h15_hamming_1_vs_all(spark, sf_dir):
    return traverse.hamming_from(star.carriers(spark, sf_dir), star.samples(spark, sf_dir), 1)


def _halves(spark, sf_dir) -> list[DataFrame]:
    m = star.mutations(spark, sf_dir)
    return [m.where("position < 3000"), m.where("position >= 3000")]


@query(f"+ {VS} " + UP_SQL.format(v="vs", x="carriers", on="sample_idx", agg="sum(value)"))
def h17_split_concat(spark, sf_dir):
    x, v = star.carriers(spark, sf_dir), sample_vectors(spark, sf_dir)
    a, b = (matmul.matmul_up(x.join(m.select("mut_id"), "mut_id", "left_semi"), v, m) for m in _halves(spark, sf_dir))
    return a.union(b)


@query(f"+ {VM} " + DOWN_SQL.format(i="sample_idx", x="carriers", agg="sum(value)"))
def h17_split_sum(spark, sf_dir):
    x, s = star.carriers(spark, sf_dir), star.samples(spark, sf_dir)
    a, b = (matmul.matmul_down(x, mutation_vectors(m), s) for m in _halves(spark, sf_dir))
    return a.union(b).groupBy("row", "idx").agg(F.sum("value").alias("value"))


# traversal

SEEDS = "(SELECT n + 150 AS node, 1 AS rank FROM size UNION ALL SELECT n + 126, 2 FROM size)"
PATHS = "+ step AS (SELECT parent, child, row_number() OVER (PARTITION BY parent ORDER BY child) AS r FROM edges), p AS (SELECT node, [{s}rank] AS k FROM " + SEEDS + " UNION ALL SELECT child, list_append(k, {s}r) FROM p JOIN step ON node = parent)"


def _seeds(g) -> DataFrame:
    n = g.samples.count()
    return g.spark.createDataFrame([(n + 150, 1), (n + 126, 2)], "node long, rank int")


@query(PATHS.format(s="") + " SELECT row_number() OVER (ORDER BY len(k), k) - 1 AS ord, node AS node_id FROM p", tree=True, recursive=True)
def e01_bfs(spark, sf_dir):
    g = star.hierarchy(spark, sf_dir)
    return traverse.bfs_order(g.edges, _seeds(g), prop.DOWN)


@query(PATHS.format(s="-") + " SELECT row_number() OVER (ORDER BY k) - 1 AS ord, node AS node_id FROM p", tree=True, recursive=True)
def e02_dfs_pre(spark, sf_dir):
    g = star.hierarchy(spark, sf_dir)
    return traverse.dfs_preorder(g.edges, _seeds(g), prop.DOWN)


@query(PATHS.format(s="-") + " SELECT row_number() OVER (ORDER BY list_append(k, 2147483647)) - 1 AS ord, node AS node_id FROM (SELECT node, min(k) AS k FROM p GROUP BY 1)", tree=True, recursive=True)
def e02_dfs_post(spark, sf_dir):
    g = star.hierarchy(spark, sf_dir)
    return traverse.dfs_postorder(g.edges, _seeds(g), prop.DOWN)


@query("+ u AS (SELECT node_id AS node FROM nodes WHERE node_id IN (3, 8, 21) UNION SELECT parent FROM u JOIN edges ON node = child) SELECT row_number() OVER (ORDER BY node) - 1 AS ord, node AS node_id FROM u", tree=True, recursive=True)
def e03_topo_up(spark, sf_dir):
    g = star.hierarchy(spark, sf_dir)
    return traverse.topo_order(g.edges, g.nodes, prop.UP, spark.createDataFrame([(3,), (8,), (21,)], "node long"))


@query("SELECT row_number() OVER (ORDER BY node_id DESC) - 1 AS ord, node_id FROM nodes", tree=True)
def e03_topo_down(spark, sf_dir):
    g = star.hierarchy(spark, sf_dir)
    return traverse.topo_order(g.edges, g.nodes, prop.DOWN)


HEIGHT = "+ h AS (SELECT node_id, 0 AS height FROM nodes WHERE node_id NOT IN (SELECT parent FROM edges) UNION SELECT parent, height + 1 FROM h JOIN edges ON node_id = child), hm AS (SELECT node_id, max(height) AS height FROM h GROUP BY 1)"


@query(HEIGHT + " SELECT row_number() OVER (ORDER BY height, node_id) - 1 AS topo, node_id FROM hm", tree=True, recursive=True)
def e06_topo_rank(spark, sf_dir):
    g = star.hierarchy(spark, sf_dir)
    return traverse.topo_rank(prop.heights(g.edges, g.nodes)).select("topo", "node_id")


@query(HEIGHT + " SELECT * FROM hm", tree=True, recursive=True)
def e14_heights(spark, sf_dir):
    g = star.hierarchy(spark, sf_dir)
    return prop.heights(g.edges, g.nodes)


@query("SELECT row_number() OVER (ORDER BY node_id >= 0, abs(node_id)) - 1 AS ord, node_id FROM (SELECT sample_idx - 10 AS node_id FROM samples)")
def e07_ordered_nodes(spark, sf_dir):
    return traverse.ordered_nodes(star.samples(spark, sf_dir).select((F.col("sample_idx") - 10).alias("node_id")), prop.UP)


FRONT = "+ w AS (SELECT node_id AS node FROM nodes WHERE node_id IN ({seeds}) UNION ALL SELECT {nxt} FROM w JOIN edges ON node = {at}), f AS (SELECT node FROM w GROUP BY 1 HAVING count(*) = {k}) SELECT node AS node_id FROM f WHERE node NOT IN (SELECT {nxt} FROM edges JOIN f ON {at} = node)"


@query(FRONT.format(seeds="SELECT unnest([3, 8, 21])", nxt="parent", at="child", k=3), tree=True, recursive=True)
def e10_frontier_up(spark, sf_dir):
    g = star.hierarchy(spark, sf_dir)
    return traverse.shared_frontier(g.edges, spark.createDataFrame([(3,), (8,), (21,)], "node long"), prop.UP)


@query(FRONT.format(seeds="SELECT n + 126 FROM size UNION ALL SELECT parent FROM edges, size WHERE child = size.n + 126", nxt="child", at="parent", k=2), tree=True, recursive=True)
def e10_frontier_down(spark, sf_dir):
    g = star.hierarchy(spark, sf_dir)
    at = g.samples.count() + 126
    above = g.edges.where(F.col("child") == at).select(F.col("parent").alias("node"))
    return traverse.shared_frontier(g.edges, above.union(spark.createDataFrame([(at,)], "node long")), prop.DOWN)


@query(REACH + " SELECT seed AS node_id, sample_idx, sum(down.n)::BIGINT AS n_paths FROM down JOIN samples ON node = sample_idx GROUP BY 1, 2", tree=True, recursive=True)
def e11_samples_below(spark, sf_dir):
    return traverse.samples_beneath(star.hierarchy(spark, sf_dir))


@query(REACH + " SELECT seed AS node_id, sum(down.n)::BIGINT AS n FROM down JOIN samples ON node = sample_idx GROUP BY 1", tree=True, recursive=True)
def e12_sample_counts(spark, sf_dir):
    return traverse.sample_counts(star.hierarchy(spark, sf_dir))


@query("""SELECT p AS part, n AS nation, count(*) AS n_paths FROM (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem) JOIN (SELECT s_suppkey AS s, s_nationkey AS n FROM supplier) USING (s) GROUP BY 1, 2""", prelude=False)
def e12_diamond_paths(spark, sf_dir):
    """A graph with diamonds (part > supplier > nation): values count paths."""
    line, sup = star.read(spark, sf_dir, "lineitem"), star.read(spark, sf_dir, "supplier")
    one = cut(dealt(line.select((F.col("l_partkey") + 10_000_000).alias("parent"), (F.col("l_suppkey") + 1_000_000).alias("child")), "parent").distinct(), "edges")
    two = sup.select((F.col("s_suppkey") + 1_000_000).alias("parent"), F.col("s_nationkey").cast("long").alias("child"))
    seeds = one.select(F.col("parent").alias("node")).distinct()
    found = prop.closure(one.union(two), seeds, prop.DOWN).where("node < 1000000")
    return found.select((F.col("seed") - 10_000_000).alias("part"), F.col("node").alias("nation"), "n_paths")


@query(REACH + " SELECT mut_id, sample_idx, sum(down.n)::BIGINT AS n_paths FROM mutation_node m JOIN down ON seed = m.node_id JOIN samples ON node = sample_idx GROUP BY 1, 2", tree=True, recursive=True)
def e15_carriers(spark, sf_dir):
    return prop.carriers(star.hierarchy(spark, sf_dir))


# lookups


@query("SELECT node_id, (SELECT count(*) FROM edges WHERE parent = node_id) AS n_down, (SELECT count(*) FROM edges WHERE child = node_id) AS n_up FROM nodes", tree=True)
def d09_degrees(spark, sf_dir):
    g = star.hierarchy(spark, sf_dir)
    return g.down_degrees().join(g.up_degrees(), "node_id")


@query("SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT child FROM edges)", tree=True)
def d12_roots(spark, sf_dir):
    return star.hierarchy(spark, sf_dir).root_nodes()


@query("SELECT row_number() OVER (ORDER BY node_id NULLS FIRST, mut_id) - 1 AS ord, node_id, mut_id, miss_node_id FROM mutation_node", tree=True)
def d13_node_mut_pairs(spark, sf_dir):
    g = star.hierarchy(spark, sf_dir)
    return ranked(g.mutation_node, F.asc_nulls_first("node_id"), "mut_id").select("ord", "node_id", "mut_id", "miss_node_id")


@query("SELECT mut_id FROM mutation_node WHERE node_id IS NULL", tree=True)
def d17_unmapped(spark, sf_dir):
    return star.hierarchy(spark, sf_dir).unmapped_mutations()


@query("SELECT DISTINCT node_id FROM mutation_node JOIN nodes USING (node_id)", tree=True)
def d19_nodes_with_mutations(spark, sf_dir):
    return star.hierarchy(spark, sf_dir).nodes_with_mutations()


@query("SELECT a.w AS a, b.w AS b FROM (SELECT i AS w, i * 100 AS s, i * 100 + 150 AS e FROM range(20) t(i)) a JOIN (SELECT i AS w, i * 100 AS s, i * 100 + 150 AS e FROM range(20) t(i)) b ON a.s < b.e AND b.s < a.e AND a.w < b.w", prelude=False)
def d25_bp_overlap(spark, sf_dir):
    w = lambda x: spark.range(20).select(F.col("id").alias(x), (F.col("id") * 100).alias(f"s_{x}"), (F.col("id") * 100 + 150).alias(f"e_{x}"))
    return w("a").join(w("b"), windows.overlaps(F.col("s_a"), F.col("e_a"), F.col("s_b"), F.col("e_b")) & (F.col("a") < F.col("b"))).select("a", "b")


# edits


@query("SELECT mut_id, row_number() OVER (ORDER BY position, ref, alt, mut_id) - 1 AS new_id FROM mutations")
def f07_sort_mutations(spark, sf_dir):
    return edit.sorted_ids(star.mutations(spark, sf_dir))


@query("SELECT position, ref, alt, count(*) AS n FROM mutations GROUP BY ALL HAVING count(*) > 1")
def f08_unique(spark, sf_dir):
    return edit.repeated_mutations(star.mutations(spark, sf_dir))


def _graph_with_copies(spark, sf_dir):
    """The hierarchy, every tenth mutation's key repeated by another one."""
    g = star.hierarchy(spark, sf_dir)
    top = g.mutations.agg(F.max("mut_id")).first()[0] or 0
    copy = g.mutations.where("mut_id % 10 = 1").withColumn("mut_id", F.col("mut_id") + top + 1)
    at = g.mutation_node.where("mut_id % 10 = 2").withColumn("mut_id", F.col("mut_id") + top)
    return g.having(mutations=g.mutations.unionByName(copy), mutation_node=g.mutation_node.unionByName(at))


@query(REACH + """, top AS (SELECT max(mut_id) AS top FROM mutations), m2 AS (SELECT mut_id, position, ref, alt FROM mutations UNION ALL SELECT mut_id + top + 1, position, ref, alt FROM mutations, top WHERE mut_id % 10 = 1),
a2 AS (SELECT mut_id, node_id FROM mutation_node UNION ALL SELECT mut_id + top, node_id FROM mutation_node, top WHERE mut_id % 10 = 2),
k AS (SELECT DISTINCT position, ref, alt, node_id FROM m2 JOIN a2 USING (mut_id) WHERE node_id IS NOT NULL)
SELECT position, ref, alt, sample_idx, sum(down.n)::BIGINT AS n_paths FROM k JOIN down ON seed = node_id JOIN samples ON node = sample_idx GROUP BY 1, 2, 3, 4""", tree=True, recursive=True)
def f09_ensure_unique(spark, sf_dir):
    g = edit.ensure_unique_mutations(_graph_with_copies(spark, sf_dir))
    return prop.carriers(g, edit.KEY).select("position", "ref", "alt", "sample_idx", "n_paths")


def _span(m: DataFrame) -> tuple[int, int]:
    """[first, last) of the positions in the table."""
    first, last = m.agg(F.min("position"), F.max("position")).first()
    return (first, last + 1) if first is not None else (0, 0)


def _parted(spark, sf_dir) -> list[tuple[DataFrame, DataFrame]]:
    """(carriers, mutations) of the two halves of the table's positions; a site is in one of them."""
    x, m = star.carriers(spark, sf_dir), star.mutations(spark, sf_dir)
    middle = sum(_span(m)) // 2
    first = F.col("position") < middle
    x = cut(x.join(m.select("mut_id", first.alias("first")).distinct(), "mut_id"), "carriers")
    return [(x.where(F.col("first") == half).select("mut_id", "sample_idx"), m.where(first == half)) for half in (True, False)]


def _two_graphs(spark, sf_dir):
    """Built from the two halves of all mutations."""
    s = star.samples(spark, sf_dir)
    return [edit.build(x, m, s, stored=True) for x, m in _parted(spark, sf_dir)]


def _mapped(spark, sf_dir):
    """A graph of the first half, and the second half mapped onto it."""
    (x, m), (new_x, new_m) = _parted(spark, sf_dir)
    return edit.map_mutations(edit.build(x, m, star.samples(spark, sf_dir), stored=True), new_m, new_x)


MERGED = "SELECT position, ref, alt, sample_idx FROM carriers JOIN mutations USING (mut_id)"


def _keyed(g) -> DataFrame:
    return prop.carriers(g, edit.KEY).select("position", "ref", "alt", "sample_idx")


@query(MERGED)
def f11_merge(spark, sf_dir):
    return _keyed(edit.merge(_two_graphs(spark, sf_dir)))


@query(MERGED)
def f12_merge_by_samples(spark, sf_dir):
    return _keyed(edit.merge(_two_graphs(spark, sf_dir), by_samples=True))


@query("SELECT mut_id, sample_idx FROM carriers")
def f13_reduce(spark, sf_dir):
    g = edit.build(star.carriers(spark, sf_dir), star.mutations(spark, sf_dir), star.samples(spark, sf_dir))
    return prop.carriers(edit.reduce_edges(g, least=2, share=0.1)[0]).select("mut_id", "sample_idx")


@query(REACH + " SELECT mut_id, sample_idx, sum(down.n)::BIGINT AS n_paths FROM mutation_node m JOIN down ON seed = m.node_id JOIN samples ON node = sample_idx GROUP BY 1, 2", tree=True, recursive=True)
def f17_simplify(spark, sf_dir):
    return prop.carriers(edit.simplify(star.hierarchy(spark, sf_dir)))


KEPT = "+ d AS (SELECT node_id AS node FROM mutation_node WHERE mut_id % 7 = 3 UNION SELECT miss_node_id FROM mutation_node WHERE mut_id % 7 = 3 UNION SELECT child FROM d JOIN edges ON node = parent) SELECT parent, child FROM edges JOIN d ON node = parent"


@query(KEPT, tree=True, recursive=True)
def f18_subset_mutations(spark, sf_dir):
    g = star.hierarchy(spark, sf_dir)
    return edit.subset_mutations(g, g.mutations.where("mut_id % 7 = 3")).edges


@query(REACH + " SELECT mut_id, sample_idx // 20 * 2 + sample_idx % 2 AS sample_idx, sum(down.n)::BIGINT AS n_paths FROM mutation_node m JOIN down ON seed = m.node_id JOIN samples ON node = sample_idx WHERE sample_idx // 2 % 10 = 0 GROUP BY 1, 2", tree=True, recursive=True)
def f19_subset_samples(spark, sf_dir):
    g = star.hierarchy(spark, sf_dir)
    keep = g.samples.where("individual_idx % 10 = 0").select(F.expr("sample_idx div 20 * 2 + sample_idx % 2").alias("new_idx"), "sample_idx")
    return prop.carriers(edit.subset_samples(g, keep))


@query("SELECT i AS window_id, 1000 + i * 250 AS begin, 1000 + i * 250 + 500 AS end FROM range(36) t(i)", prelude=False)
def f22_windows_bp(spark, sf_dir):
    return windows.by_bp(spark, 1000, 10000, 500, 2)


MAP = [(1000, 0.0), (3000, 1.0), (5000, 4.0), (11000, 5.0)]


@query("""WITH m(p, c) AS (VALUES (1000, 0.0::DOUBLE), (3000, 1.0), (5000, 4.0), (11000, 5.0)), s AS (SELECT lag(p) OVER (ORDER BY p) AS p0, p AS p1, lag(c) OVER (ORDER BY p) AS c0, c AS c1 FROM m),
e AS (SELECT i, coalesce(least(11001, p0 + floor((0.25 * i - c0) / (c1 - c0) * (p1 - p0)))::BIGINT, 11001) AS p FROM range(22) t(i) LEFT JOIN s ON 0.25 * i >= c0 AND 0.25 * i < c1)
SELECT a.i AS window_id, a.p AS begin, b.p AS end FROM e a JOIN e b ON b.i = a.i + 2 WHERE a.i < 20""", prelude=False)
def f23_windows_cm(spark, sf_dir):
    return windows.by_cm(spark.createDataFrame(MAP, "position long, cm double"), 1000, 11001, 0.5, 2)


@query("+ s AS (SELECT min(position) AS first FROM mutations) SELECT (position - first) // 250 - k AS window_id, mut_id FROM mutations, s, range(2) r(k) WHERE (position - first) // 250 >= k")
def f24_mutations_in_window(spark, sf_dir):
    m = star.mutations(spark, sf_dir)
    return windows.assign(m, windows.by_bp(spark, *_span(m), 500, 2))


@query("+ s AS (SELECT min(position) AS first FROM mutations) SELECT (position - first) // 2000 AS window_id, mut_id, sample_idx FROM carriers JOIN mutations USING (mut_id), s")
def f25_split(spark, sf_dir):
    m = star.mutations(spark, sf_dir)
    return windows.split(star.carriers(spark, sf_dir), m, windows.by_bp(spark, *_span(m), 2000))


@query("SELECT mut_id, sample_idx FROM carriers")
def f26_map_mutations(spark, sf_dir):
    return prop.carriers(_mapped(spark, sf_dir)[0]).select("mut_id", "sample_idx")


@query("+ s AS (SELECT (min(position) + max(position) + 1) // 2 AS middle FROM mutations) SELECT mut_id, sum(1)::BIGINT AS n_carriers FROM carriers JOIN mutations USING (mut_id), s WHERE position >= middle GROUP BY 1")
def f27_mapping_stats(spark, sf_dir):
    return _mapped(spark, sf_dir)[1].select("mut_id", "n_carriers")


@query("SELECT mut_id, sample_idx FROM carriers")
def f28_build(spark, sf_dir):
    return prop.carriers(edit.build(star.carriers(spark, sf_dir), star.mutations(spark, sf_dir), star.samples(spark, sf_dir))).select("mut_id", "sample_idx")


@query("SELECT count(*) AS n_sets FROM (SELECT DISTINCT list(sample_idx ORDER BY sample_idx) FROM carriers GROUP BY mut_id)")
def f29_distinct_sets(spark, sf_dir):
    keys = star.carriers(spark, sf_dir).groupBy("mut_id").agg(*edit.set_hash("sample_idx"))
    return keys.select("set_n", "set_a", "set_b").distinct().agg(F.count("*").alias("n_sets"))


# input transforms

SITE = "x AS (SELECT position, ref, alt, sample_idx FROM carriers JOIN mutations USING (mut_id))"


def _rows(spark, sf_dir) -> DataFrame:
    return star.carriers(spark, sf_dir).join(star.mutations(spark, sf_dir), "mut_id").select("position", "ref", "alt", "sample_idx")


@query("""SELECT mut_id // 2 AS position, 'R' AS ref, CASE mut_id % 2 WHEN 0 THEN 'A' ELSE 'C' END AS alt, sample_idx FROM carriers""")
def b01_explode(spark, sf_dir):
    x = star.carriers(spark, sf_dir)
    return transforms.explode_alleles(x.select(F.expr("mut_id div 2").alias("position"), F.lit("R").alias("ref"), F.lit("A,C").alias("alts"), "sample_idx", (F.col("mut_id") % 2 + 1).alias("allele")))


@query(f"+ {SITE} SELECT position, ref, '1' AS alt, sample_idx FROM x")
def b02_binary(spark, sf_dir):
    return transforms.binary(_rows(spark, sf_dir))


FLIP = """+ big AS (SELECT position, 'R' AS ref, 'A' AS alt, sample_idx FROM (SELECT DISTINCT 1000 + 10 * (mut_id // 100) AS position, sample_idx FROM carriers)),
n AS (SELECT position, ref, alt FROM big GROUP BY ALL HAVING count(*) > greatest((SELECT count(*) FROM samples) // 2, 1))
SELECT b.position, CASE WHEN n.position IS NULL THEN b.ref END AS ref, b.alt, sample_idx FROM big b LEFT JOIN n USING (position) WHERE n.position IS NULL
UNION ALL SELECT n.position, n.alt, n.ref, s.sample_idx FROM n CROSS JOIN samples s WHERE NOT EXISTS (SELECT 1 FROM big b WHERE b.position = n.position AND b.sample_idx = s.sample_idx)"""


@query(FLIP)
def b04_ref_flip(spark, sf_dir):
    x = star.carriers(spark, sf_dir).select(F.expr("1000 + 10 * (mut_id div 100)").alias("position"), F.lit("R").alias("ref"), F.lit("A").alias("alt"), "sample_idx").distinct()
    return transforms.flip_to_major(x, star.samples(spark, sf_dir))


@query(f"+ {SITE} SELECT position, ref, alt, array_to_string(list(sample_idx ORDER BY sample_idx), ',') AS samples FROM x GROUP BY ALL")
def b06_merge_dups(spark, sf_dir):
    return transforms.merge_duplicates(_rows(spark, sf_dir)).withColumn("samples", F.concat_ws(",", F.col("samples").cast("array<string>")))


@query("SELECT c_custkey AS position, c_custkey * 2 + k AS sample_idx FROM customer, range(2) r(k) WHERE c_custkey % 3 = 0 OR c_custkey % 3 = 2 AND k = 0", prelude=False)
def b07_copies(spark, sf_dir):
    c = star.read(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").alias("position"), F.col("c_custkey").alias("individual_idx"), F.when(F.col("c_custkey") % 3 == 0, F.lit(None)).when(F.col("c_custkey") % 3 == 2, F.lit(1)).otherwise(F.lit(0)).cast("int").alias("copies"))
    return transforms.expand_copies(rows).select("position", "sample_idx")


@query(f"+ {SITE} SELECT position, ref, alt, sample_idx // 2 // 4 * 2 + sample_idx % 2 AS sample_idx FROM x WHERE sample_idx // 2 % 4 = 0")
def b08_keep(spark, sf_dir):
    keep = star.samples(spark, sf_dir).where("individual_idx % 4 = 0")
    return transforms.keep_individuals(_rows(spark, sf_dir), keep)


@query(f"+ {SITE} SELECT * FROM x WHERE sample_idx < 50")
def b09_trim(spark, sf_dir):
    return transforms.trim(_rows(spark, sf_dir), 50)


@query()
def b11_noise(spark, sf_dir):
    return transforms.add_noise(_rows(spark, sf_dir), star.samples(spark, sf_dir), 0.01, 0.01, 7)


@query("""+ p AS (SELECT individual_idx, min_by(pop_id, sample_idx) AS pop FROM samples GROUP BY 1), f AS (SELECT pop, row_number() OVER (ORDER BY min(individual_idx)) - 1 AS pop_id FROM p GROUP BY 1)
SELECT individual_idx, pop_id FROM p JOIN f USING (pop)""")
def b12_populations(spark, sf_dir):
    s = star.samples(spark, sf_dir)
    people = s.groupBy("individual_idx").agg(F.min_by("pop_id", "sample_idx").cast("string").alias("population")).withColumn("individual_id", F.concat(F.lit("I"), "individual_idx"))
    return transforms.assign_populations(people.select("individual_idx", "individual_id"), people.select("individual_id", "population"))[0].withColumn("pop_id", F.col("pop_id").cast("long"))


@query("""+ a AS (SELECT mut_id, sample_idx FROM carriers WHERE mut_id % 2 = 0), b AS (SELECT mut_id - 1 AS mut_id, sample_idx FROM carriers WHERE mut_id % 2 = 1)
SELECT a.mut_id, a.sample_idx FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.mut_id = a.mut_id AND b.sample_idx = a.sample_idx)""")
def f35_nested_mutations(spark, sf_dir):
    x = star.carriers(spark, sf_dir)
    return x.where("mut_id % 2 = 0").join(x.where("mut_id % 2 = 1").withColumn("mut_id", F.col("mut_id") - 1), ["mut_id", "sample_idx"], "left_anti")


# association

PHENO = "ph AS (SELECT c_custkey // 2 AS individual_idx, avg(c_acctbal) AS y FROM customer GROUP BY 1), n AS (SELECT count(*) AS n FROM ph)"


def phenotype(spark, sf_dir) -> DataFrame:
    return star.read(spark, sf_dir, "customer").groupBy(F.expr("c_custkey div 2").alias("individual_idx")).agg(F.avg("c_acctbal").alias("y"))


@query(f"""+ {PHENO}, f AS (SELECT m.mut_id, coalesce(dosage, 0) AS x, y FROM (SELECT DISTINCT mut_id FROM carriers) m CROSS JOIN ph LEFT JOIN dosages d ON d.mut_id = m.mut_id AND d.individual_idx = ph.individual_idx)
SELECT mut_id, sum(x)::BIGINT AS n_carried, round(regr_slope(y, x), 4) AS beta, round(regr_intercept(y, x), 4) AS b0, round(regr_r2(y, x), 4) AS r2 FROM f GROUP BY 1""")
def i01_gwas(spark, sf_dir):
    out = assoc.linear_regression(star.individual_counts(spark, sf_dir), star.mutations(spark, sf_dir), phenotype(spark, sf_dir))
    return out.select("mut_id", "n_carried", *[F.round(c, 4).alias(c) for c in ("beta", "b0", "r2")])


@query("""+ n AS (SELECT count(DISTINCT individual_idx) AS n FROM samples), f AS (SELECT mut_id, coalesce(s, 0) / (2 * n) AS f FROM mutations LEFT JOIN (SELECT mut_id, sum(dosage) AS s FROM dosages GROUP BY 1) USING (mut_id), n),
v AS (SELECT DISTINCT individual_idx, individual_idx % 7 AS v FROM samples)
SELECT mut_id, round(CASE WHEN f * (1 - f) > 0 THEN (coalesce(q, 0) - 2 * f * (SELECT sum(v) FROM v)) / sqrt(2 * f * (1 - f)) ELSE 0 END, 6) AS value FROM f LEFT JOIN (SELECT mut_id, sum(dosage * v) AS q FROM dosages JOIN v USING (individual_idx) GROUP BY 1) USING (mut_id)""")
def i04_standardized(spark, sf_dir):
    d, m = star.individual_counts(spark, sf_dir), star.mutations(spark, sf_dir)
    people = star.samples(spark, sf_dir).select("individual_idx").distinct()
    freq = assoc.frequencies(d, m, people.count())
    v = people.select("individual_idx", (F.col("individual_idx") % 7).cast("double").alias("value"))
    return assoc.standardised_up(d, freq, v).select("mut_id", F.round("value", 6).alias("value"))


@query()
def i03_pca_eigenvalues(spark, sf_dir):
    people = star.samples(spark, sf_dir).select("individual_idx").distinct()
    values, _ = assoc.principal_components(cut(star.individual_counts(spark, sf_dir), "dosages"), star.mutations(spark, sf_dir), people, 2)
    return spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "component int, eigenvalue double")


@query("""+ k AS (SELECT position, ref, alt, sum(n) AS n FROM mutations LEFT JOIN (SELECT mut_id, count(*) AS n FROM carriers JOIN samples USING (sample_idx) WHERE pop_id < 5 GROUP BY 1) USING (mut_id) WHERE position < 6000 GROUP BY ALL)
SELECT position, ref, alt, n::BIGINT AS n FROM k WHERE n >= 2""")
def i07_filtered_counts(spark, sf_dir):
    n = star.samples(spark, sf_dir)
    only = n.where("pop_id < 5").select("sample_idx")
    c = stats.allele_counts(star.carriers(spark, sf_dir), star.mutations(spark, sf_dir), star.miss_carriers(spark, sf_dir), n.count(), span=(0, 6000), only=only)
    return c.where("alt_count >= 2").select("position", "ref", "alt", F.col("alt_count").alias("n"))


# coalescence counts on nodes


def _xtx_of(graph) -> DataFrame:
    """mut_id, value: squared dosages summed over individuals, by a product of ones with starting values."""
    ones = graph.samples.select(F.lit(0).alias("row"), F.col("sample_idx").alias("idx"), F.lit(1).cast("long").alias("value"))
    values = matmul.node_values(graph, ones, "up", init=matmul.init_xtx(graph, ones))
    return matmul.read_mutations(graph, values).select("mut_id", F.col("value").cast("long").alias("value"))


@query("+ s AS (SELECT mut_id, sum(dosage * dosage) AS v FROM dosages GROUP BY 1) SELECT mut_id, coalesce(v, 0)::BIGINT AS value FROM mutations LEFT JOIN s USING (mut_id)")
def g07_build_coals(spark, sf_dir):
    return _xtx_of(edit.build(star.carriers(spark, sf_dir), star.mutations(spark, sf_dir), star.samples(spark, sf_dir)))


@query(REACH + """, d AS (SELECT mut_id, sample_idx // 20 AS ind, sum(down.n) AS k FROM mutation_node m JOIN down ON seed = m.node_id JOIN samples ON node = sample_idx WHERE sample_idx // 2 % 10 = 0 GROUP BY 1, 2),
x AS (SELECT mut_id, sum(k * k) AS v FROM d GROUP BY 1) SELECT mut_id, coalesce(v, 0)::BIGINT AS value FROM mutations LEFT JOIN x USING (mut_id)""", tree=True, recursive=True)
def f21_subset_coals(spark, sf_dir):
    g = star.hierarchy(spark, sf_dir)
    keep = g.samples.where("individual_idx % 10 = 0").select(F.expr("sample_idx div 20 * 2 + sample_idx % 2").alias("new_idx"), "sample_idx")
    return _xtx_of(edit.subset_samples(g, keep))


@query("""+ n AS (SELECT position, count(*) AS n FROM miss_carriers GROUP BY 1)
SELECT mut_id, coalesce(n, 0)::BIGINT AS n_missing FROM mutations LEFT JOIN n USING (position)""")
def b03_missing_kept(spark, sf_dir):
    """Missing data read back from a built graph."""
    g = edit.build(star.carriers(spark, sf_dir), star.mutations(spark, sf_dir), star.samples(spark, sf_dir), miss=star.miss_carriers(spark, sf_dir))
    n = prop.miss_carriers(g).groupBy("mut_id").agg(F.count("*").alias("n"))
    return g.mutations.select("mut_id").join(n, "mut_id", "left").select("mut_id", F.coalesce("n", F.lit(0)).alias("n_missing"))
