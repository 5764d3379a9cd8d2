"""Hand-built graphs: products, traversal, counts, edits and round trips."""

import random

import pytest
from pyspark.sql import functions as F

from lociweave.model import from_rows
from lociweave.operators import edit, matmul, propagate, stats, traverse, windows
from lociweave.sources import files

TREE_EDGES = [(4, 0), (4, 1), (5, 2), (5, 3), (6, 4), (6, 5)]
EIGHT_EDGES = [(8, 0), (8, 1), (9, 8), (9, 2), (10, 3), (10, 4), (10, 7), (11, 8), (11, 10), (11, 6), (12, 10), (12, 5), (13, 12), (13, 9)]


def vector(spark, rows):
    return spark.createDataFrame([(r, i, v) for r, row in enumerate(rows) for i, v in enumerate(row)], "row int, idx long, value double" if any(isinstance(v, float) for r in rows for v in r) else "row int, idx long, value long")


def dense(df, idx="idx"):
    out = {}
    for r in df.collect():
        out.setdefault(r.row, {})[r[idx]] = r.value
    return [[v for _, v in sorted(row.items())] for _, row in sorted(out.items())]


@pytest.fixture(scope="module")
def tree(spark):
    return from_rows(spark, 4, TREE_EDGES, [(5, "G", "A", 1), (6, "G", "A", 5), (7, "G", "A", 6)])


@pytest.fixture(scope="module")
def eight(spark):
    return from_rows(spark, 8, EIGHT_EDGES)


def test_products_on_the_graph(spark, tree):
    down = lambda rows: dense(matmul.read_samples(tree, matmul.node_values(tree, vector(spark, rows), "down")))
    up = lambda rows: dense(matmul.read_mutations(tree, matmul.node_values(tree, vector(spark, rows), "up")), "mut_id")
    assert down([[1, 2, 1], [0, 1, 1]]) == [[1, 2, 3, 3], [1, 1, 2, 2]]
    assert up([[1.0] * 4, [0.25] * 4]) == [[1, 2, 4], [0.25, 0.5, 1]]


def test_products_equal_the_matrix(spark, tree):
    x = propagate.carriers(tree)
    v = vector(spark, [[1, 1, 1, 1], [1, 2, 3, 4]])
    assert dense(matmul.matmul_up(x, v, tree.mutations)) == [[1, 2, 4], [2, 7, 10]]
    u = vector(spark, [[1, 2, 1]])
    assert dense(matmul.matmul_down(x, u, tree.samples)) == [[1, 2, 3, 3]]
    assert dense(matmul.matmul_down(x, u, tree.samples, by_individual=True)) == [[3, 6]]
    with pytest.raises(ValueError):
        matmul.check_shape(u, 4)
    with pytest.raises(ValueError):
        propagate.step(tree.edges, "sideways")


def test_squares_by_init(spark):
    g = from_rows(spark, 4, TREE_EDGES, [(1, "G", "A", 6), (2, "G", "T", 5), (3, "A", "C", 4)])
    reach = traverse.samples_beneath(g).join(g.samples.select("sample_idx", F.col("node_id").alias("sample_node")), "sample_idx").select("node_id", "sample_node")
    coals = stats.coalescences(g.edges, g.nodes, stats.complete_individuals(reach, g.samples))
    v = vector(spark, [[1, 1, 1, 1]])
    with pytest.raises(ValueError):
        matmul.init_xtx(g, v)
    g = g.having(nodes=g.nodes.drop("num_coals").join(coals, "node_id", "left").select("node_id", "is_sample", "num_coals"))
    values = matmul.node_values(g, v, "up", init=matmul.init_xtx(g, v))
    assert dense(matmul.read_mutations(g, values), "mut_id") == [[8, 4, 4]]


def test_frontiers(spark, eight):
    seeds = lambda *n: spark.createDataFrame([(i,) for i in n], "node long")
    ids = lambda df: sorted(r.node_id for r in df.collect())
    assert ids(traverse.shared_frontier(eight.edges, seeds(13, 11), "down")) == [8, 10]
    assert ids(traverse.shared_frontier(eight.edges, seeds(1, 3), "up")) == [11, 13]


def _loops(edges, direction, seeds):
    """The visits themselves, as queue and stack loops."""
    after = {}
    for p, c in edges:
        a, b = (p, c) if direction == "down" else (c, p)
        after.setdefault(a, []).append(b)
    after = {k: sorted(v) for k, v in after.items()}
    queue, bfs = list(seeds), []
    while queue:
        n = queue.pop(0)
        bfs.append(n)
        queue += after.get(n, [])
    stack, pre = list(seeds), []
    while stack:
        n = stack.pop()
        pre.append(n)
        stack += after.get(n, [])
    return bfs, pre


def test_orders(spark, eight):
    seeds = spark.createDataFrame([(13, 1), (11, 2)], "node long, rank int")
    bfs, pre = _loops(EIGHT_EDGES, "down", [13, 11])
    order = lambda df: [r.node_id for r in df.orderBy("ord").collect()]
    assert order(traverse.bfs_order(eight.edges, seeds, "down")) == bfs
    assert order(traverse.dfs_preorder(eight.edges, seeds, "down")) == pre
    post = order(traverse.dfs_postorder(eight.edges, seeds, "down"))
    assert sorted(post) == sorted(set(pre)) and all(post.index(p) > post.index(c) for p, c in EIGHT_EDGES if p in post)
    assert traverse.bfs_order_capped(eight.edges, [13, 11], "down", 1000) == bfs
    assert len(traverse.bfs_order_capped(eight.edges, [13, 11], "down", 2)) < len(bfs)
    assert {13, 11} <= set(traverse.bfs_order_capped(eight.edges, [13, 11], "down", 1))


def test_lookups(spark, tree):
    assert (tree.num_nodes(), tree.num_edges(), tree.shape(), tree.haploid_shape()) == (7, 6, (2, 3), (4, 3))
    assert tree.bp_range() == (5, 8) and tree.nodes_are_ordered() and tree.mutations_are_ordered() and tree.samples_are_ordered()
    assert tree.down_edges(6) == [4, 5] and tree.up_edges(4) == [6] and [r.node_id for r in tree.root_nodes().collect()] == [6]
    assert not tree.has_missing_data() and not tree.has_individual_ids() and not tree.has_individual_coals()
    assert dict(map(tuple, propagate.heights(tree.edges, tree.nodes).collect())) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 2}
    with pytest.raises(ValueError):
        from_rows(spark, 3, [])


def test_subsets(spark):
    g = from_rows(spark, 4, TREE_EDGES, [(999, "T", "ACCC", 4), (10001, "A", "C", 6)], individual_ids=["a", "b"])
    one = edit.simplify(edit.subset_mutations(g, spark.createDataFrame([(0,)], "mut_id long")))
    assert (one.num_nodes(), one.num_edges(), one.down_edges(4)) == (5, 2, [0, 1])
    last = edit.simplify(edit.subset_samples(g, [2, 3]))
    assert (last.num_nodes(), last.num_edges(), last.ploidy) == (3, 2, 2)
    assert {r.mut_id: r.node_id is None for r in last.mutation_node.collect()} == {0: True, 1: False}
    first = edit.simplify(edit.subset_samples(g, [0, 1]))
    assert (first.num_nodes(), first.num_edges()) == (4, 3)
    assert [r.individual_id for r in last.individuals.collect()] == ["b"]
    assert edit.subset_samples(g, [1, 2, 3]).ploidy == 1
    with pytest.raises(ValueError):
        edit.subset_samples(g, [1, 1])


def test_edits(spark, tree):
    g, new = edit.make_nodes(tree, 2)
    assert new == [7, 8]
    g = edit.connect(g, [(7, 6), (7, 6), (8, 7)])
    assert g.num_edges() == 9
    g, had = edit.disconnect(g, 7, 6)
    assert had and g.num_edges() == 7 and not edit.disconnect(g, 7, 6)[1]
    with pytest.raises(ValueError):
        edit.connect(g, [(99, 1)])
    g, m = edit.add_mutation(g, 1, "C", "T", 4)
    assert m == 3 and not g.mutations_are_ordered()
    g = edit.sort_mutations(g)
    assert g.mutations_are_ordered() and g.mutation_by_id(0).first().position == 1
    g = edit.remove_mutation(g, 0, 4)
    assert g.num_mutations() == 4 and edit.sort_mutations(g).num_mutations() == 3
    with pytest.raises(ValueError):
        edit.remove_mutation(g, 0, 4)
    assert edit.mutations_are_unique(tree)
    with pytest.raises(ValueError):
        edit.set_samples(tree, [1, 1])
    assert edit.set_samples(tree, [3, 0]).num_samples() == 2


def test_save_and_load(spark, tree, tmp_path):
    files.save(tree, str(tmp_path / "g"), simplify=False)
    back = files.load(spark, str(tmp_path / "g"))
    assert back.num_nodes() == 7 and back.ploidy == 2
    assert sorted(map(tuple, propagate.carriers(back).collect())) == sorted(map(tuple, propagate.carriers(tree).collect()))
    assert not files.save_subset(tree, str(tmp_path / "none"), "down", []) and not (tmp_path / "none").exists()
    assert files.save_subset(tree, str(tmp_path / "one"), "up", [2, 3])
    assert '"4"' in files.graph_json(tree, [6])


def test_merge_rules(spark, tree):
    other = from_rows(spark, 4, TREE_EDGES, [(50, "G", "A", 4)])
    both = edit.merge([tree, other])
    assert both.num_nodes() == 7 and both.num_mutations() == 4 and both.specified_range == (5, 51)
    assert edit.merge([tree, other], by_samples=True).num_nodes() == 7
    assert edit.merge([tree, other], combine=False).num_nodes() == 10
    with pytest.raises(ValueError):
        edit.merge([tree, tree])
    with pytest.raises(ValueError):
        edit.merge([tree, from_rows(spark, 2, [])])
    assert edit.merge([tree, tree], offsets=[0, 100]).num_mutations() == 6


def test_random_matrices_survive(spark):
    rng = random.Random(4)
    rows = [(m, s) for m in range(30) for s in range(20) if rng.random() < 0.3]
    rows += [(m + 30, s) for m, s in rows if m < 10]
    x = spark.createDataFrame(rows, "mut_id long, sample_idx long")
    muts = spark.createDataFrame([(m, 10 * m, "A", "C") for m in range(42)], "mut_id long, position long, ref string, alt string")
    samples = spark.createDataFrame([(s, s // 2, None) for s in range(20)], "sample_idx long, individual_idx long, pop_id int")
    g = edit.build(x, muts, samples, rounds=0)
    smaller, saved = edit.reduce_edges(g, least=2, share=0.3)
    for own in (g, smaller, edit.simplify(smaller)):
        assert sorted((r.mut_id, r.sample_idx) for r in propagate.carriers(own).collect()) == sorted(rows)
    assert smaller.num_edges() == g.num_edges() - saved <= len(rows)


def test_hwe(spark):
    def exact(het, a, b):
        from math import comb

        n, rare = het + a + b, 2 * min(a, b) + het
        if n == 0:
            return 1.0
        p = {h: 2**h * comb(n, h) * comb(n - h, (rare - h) // 2) for h in range(rare % 2, rare + 1, 2)}
        return min(1.0, sum(v for v in p.values() if v <= p[het]) / sum(p.values()))

    rng = random.Random(2)
    cases = [(0, 0, 0), (0, 10, 0), (10, 0, 0), (5, 0, 5), (1, 0, 0), *[(rng.randrange(40), rng.randrange(40), rng.randrange(40)) for _ in range(60)]]
    df = spark.createDataFrame(cases, "h int, a int, b int").select("h", "a", "b", stats.hwe_p(F.col("h"), F.col("a"), F.col("b")).alias("p"))
    for r in df.collect():
        assert abs(r.p - exact(r.h, r.a, r.b)) < 1e-9, r


def test_windows(spark):
    got = [tuple(r) for r in windows.by_bp(spark, 0, 10, 4, 2).orderBy("window_id").collect()]
    assert got == [(0, 0, 4), (1, 2, 6), (2, 4, 8), (3, 6, 10), (4, 8, 12)]
    with pytest.raises(ValueError):
        windows.by_bp(spark, 0, 10, 3, 2)


def test_coalescence_counts_travel(spark):
    """Sums of the counts along paths are complete individuals, in built, reduced, subset and simplified graphs."""
    import random

    from pyspark.sql import functions as F

    from lociweave.operators import edit, matmul, propagate

    rng = random.Random(6)
    blocks = [rng.sample(range(24), 9) for _ in range(4)]
    rows = sorted({(m, s) for m in range(40) for b in rng.sample(blocks, 2) for s in (*b, rng.randrange(24))})
    x = spark.createDataFrame(rows, "mut_id long, sample_idx long")
    muts = spark.createDataFrame([(m, m, "A", "C") for m in range(41)], "mut_id long, position long, ref string, alt string")
    samples = spark.range(24).select(F.col("id").alias("sample_idx"), F.expr("id div 2").alias("individual_idx"), F.lit(None).cast("int").alias("pop_id"))
    flat = edit.build(x, muts, samples)
    reduced, saved = edit.reduce_edges(flat, least=2, share=0.1)
    assert saved > 0
    kept = edit.subset_samples(reduced, [0, 1, 6, 7, 8, 9, 22, 23, 10, 11])
    for g in (flat, reduced, kept, edit.simplify(kept)):
        own = propagate.carriers(g).where("n_paths > 0").join(g.samples, "sample_idx").groupBy("mut_id", "individual_idx").agg(F.sum("n_paths").alias("k")).collect()
        want = {}
        for r in own:
            want[r.mut_id] = want.get(r.mut_id, 0) + r.k**2
        v = g.samples.select(F.lit(0).alias("row"), F.col("sample_idx").alias("idx"), F.lit(1).cast("long").alias("value"))
        values = matmul.node_values(g, v, "up", init=matmul.init_xtx(g, v))
        got = {r.mut_id: r.value for r in matmul.read_mutations(g, values).collect() if r.value}
        assert got == want
