"""What the steps of large graphs store and shuffle, on small ones: no table of theirs grows faster than the input."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

from lociweave.model import from_rows
from lociweave.operators import edit, propagate, stats, traverse


def matrix(spark, rows, n_samples, n_muts, first=0):
    """Carriers, mutations and samples of (mut_id, sample_idx)."""
    x = spark.createDataFrame(sorted(rows), "mut_id long, sample_idx long")
    muts = spark.createDataFrame([(m, 10 * m, "A", "C") for m in range(first, first + n_muts)], "mut_id long, position long, ref string, alt string")
    return x, muts, spark.range(n_samples).select(F.col("id").alias("sample_idx"), F.expr("id div 2").alias("individual_idx"), F.lit(None).cast("int").alias("pop_id"))


def carried(graph):
    return sorted((r.mut_id, r.sample_idx) for r in propagate.carriers(graph).collect())


@pytest.fixture
def stored(monkeypatch):
    """Rows of every table that propagation stores."""
    sizes, real = [], propagate.cut

    def cut(df, *args, **kw):
        out = real(df, *args, **kw)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(propagate, "cut", cut)
    return sizes


def refuse(*args, **kw):
    raise AssertionError("not to be called")


def test_mapping_compares_candidates_only(spark, monkeypatch):
    """Mutations that contain no node but samples need no comparison in Python."""
    x, muts, samples = matrix(spark, [(m, s) for m in range(4) for s in (2 * m, 2 * m + 1, 10)], 12, 4)
    new = [(m, s) for m in range(4, 8) for s in (2 * (m - 4), 9, 11)]
    more, new_muts, _ = matrix(spark, new, 12, 4, first=4)
    g = edit.build(x, muts, samples)
    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandas", refuse)
    out, stats = edit.map_mutations(g, new_muts, more)
    assert sorted(map(tuple, stats.collect())) == [(m, 3, 0, 3) for m in range(4, 8)]
    assert carried(out) == sorted([tuple(r) for r in x.collect()] + new)


def test_mapping_takes_the_largest_nodes(spark):
    """Against the greedy rule over all contained nodes, samples included."""
    rng = random.Random(3)
    blocks = [rng.sample(range(30), k) for k in (2, 3, 4, 6, 9, 9, 12)]
    old = {(m, s) for m in range(20) for s in rng.choice(blocks)}
    new = {(m, s) for m in range(20, 50) for b in rng.sample(blocks, rng.randrange(3)) for s in (*b, rng.randrange(30))}
    x, muts, samples = matrix(spark, old, 30, 20)
    more, new_muts, _ = matrix(spark, new, 30, 30, first=20)
    g = edit.build(x, muts, samples)
    below = {}
    for r in traverse.samples_beneath(g).collect():
        below.setdefault(r.node_id, set()).add(r.sample_idx)
    want = []
    for m in sorted({m for m, _ in new}):
        left, taken = {s for k, s in new if k == m}, []
        for node in sorted(below, key=lambda n: (-len(below[n]), n)):
            if below[node] <= left:
                left -= below[node]
                taken.append(node)
        want.append((m, sum(len(below[n]) for n in taken), sum(n >= 30 for n in taken), sum(n < 30 for n in taken)))
    out, stats = edit.map_mutations(g, new_muts, more)
    assert sorted(map(tuple, stats.collect())) == want and max(w[2] for w in want) > 1
    assert carried(out) == sorted(old | new)


def test_mapping_statistics_read_one_table(spark):
    x, muts, samples = matrix(spark, [(m, s) for m in range(4) for s in (2 * m, 2 * m + 1, 10)], 12, 4)
    more, new_muts, _ = matrix(spark, [(m, s) for m in range(4, 8) for s in (2 * (m - 4), 9)], 12, 4, first=4)
    _, stats = edit.map_mutations(edit.build(x, muts, samples), new_muts, more)
    assert "Join" not in stats._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, stats.collect())) == [(m, 2, 0, 2) for m in range(4, 8)]


def test_building_walks_no_paths(spark, monkeypatch):
    """A built graph is flat: its coalescence counts come from its edges, when they are read."""
    rows = [(m, s) for m in range(6) for s in range(m, m + 5)]
    monkeypatch.setattr(edit, "samples_beneath", refuse)
    g = edit.build(*matrix(spark, rows, 12, 6))
    assert carried(g) == rows
    assert sorted(r.num_coals for r in g.nodes.where("not is_sample").collect()) == [2] * 6


def test_reducing_recounts_what_changed(spark, monkeypatch):
    rng = random.Random(8)
    blocks = [rng.sample(range(24), 9) for _ in range(4)]
    rows = {(m, s) for m in range(30) for b in rng.sample(blocks, 2) for s in (*b, rng.randrange(24))}
    g = edit.build(*matrix(spark, rows, 24, 30))
    with monkeypatch.context() as m:
        m.setattr(edit, "count_coalescences", refuse)
        small, saved = edit.reduce_edges(g, least=2, share=0.1)
    assert saved > 0 and carried(small) == sorted(rows)
    counts = lambda graph: sorted((r.node_id, r.num_coals) for r in graph.nodes.where("not is_sample").collect())
    assert counts(small) == counts(edit.count_coalescences(small))


def halves(spark):
    rows = [(m, s) for m in range(20) for s in range(m, m + 9)]
    parts = [matrix(spark, [r for r in rows if (r[0] < 10) == half], 30, 10, first=0 if half else 10) for half in (True, False)]
    return rows, [edit.build(x, m.where("mut_id >= 10") if i else m, s) for i, (x, m, s) in enumerate(parts)]


def test_merging_by_samples_stores_no_pairs(spark, stored):
    rows, graphs = halves(spark)
    one = edit.merge([graphs[0], graphs[1].having(mutations=graphs[1].mutations.withColumn("mut_id", F.col("mut_id") - 10), mutation_node=graphs[1].mutation_node.withColumn("mut_id", F.col("mut_id") - 10))], by_samples=True)
    assert carried(one) == rows and max(stored) < len(rows) / 2


def test_missing_data_stores_no_pairs(spark, stored):
    rows = [(m, s) for m in range(10) for s in range(m, m + 9)]
    gaps = [(10 * m, s) for m in range(10) for s in range(m + 10, m + 20)]
    x, muts, samples = matrix(spark, rows, 30, 10)
    g = edit.build(x, muts, samples, miss=spark.createDataFrame(gaps, "position long, sample_idx long"))
    assert sorted((10 * r.mut_id, r.sample_idx) for r in propagate.miss_carriers(g).collect()) == gaps and max(stored) < len(gaps) / 2


def test_merging_by_children_stores_no_pairs(spark, stored, monkeypatch):
    """Children that are samples need no level of their own."""
    rows, graphs = halves(spark)
    monkeypatch.setattr(edit, "heights", refuse)
    one = edit.merge([graphs[0], graphs[1].having(mutations=graphs[1].mutations.withColumn("mut_id", F.col("mut_id") - 10), mutation_node=graphs[1].mutation_node.withColumn("mut_id", F.col("mut_id") - 10))])
    assert carried(one) == rows and max(stored) < len(rows) / 2


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_difference_groups_both_sides_once(spark):
    rng = random.Random(9)
    one, two = ([(rng.randrange(3), "A", "C", rng.randrange(4)) for _ in range(60)] for _ in range(2))
    schema = "position long, ref string, alt string, sample_idx long"
    got = stats.matrix_difference(spark.createDataFrame([*one, (None, "A", None, 1)], schema), spark.createDataFrame([*two, (None, "A", None, 1), (None, None, "C", 2)], schema))
    a, b = Counter(one), Counter(two) + Counter([(None, None, "C", 2)])
    want = Counter()
    for side, rest in (("first", a - b), ("second", b - a)):
        for (*key, _), n in rest.items():
            want[*key, side] += n
    assert Counter({tuple(r[:4]): r.n for r in got.collect()}) == want
    assert "replicaterows" not in plan_of(got).lower()


def test_exact_test_works_once_for_equal_counts(spark):
    """States of fixed size; a large middle has as many terms as any other."""
    rows = [(i, 3000, 4000, 4000) if i % 2 else (i, i % 3, 5, 2) for i in range(20)]
    out = {r.mut_id: r.p for r in stats.hwe(spark.createDataFrame(rows, "mut_id long, het int, hom_a int, hom_b int")).collect()}
    assert len(out) == 20 and out[1] == pytest.approx(0, abs=1e-9) and len(set(out.values())) == 4
    assert "concat" not in str(stats.hwe_p(F.col("h"), F.col("a"), F.col("b")))


def test_closure_deals_rows_before_grouping(spark):
    """No task groups more than its share of the pairs: nothing is grouped before it is dealt."""
    edges = spark.createDataFrame([(p, c) for p in range(100, 140) for c in range(10, 20)] + [(c, c % 3) for c in range(10, 20)], "parent long, child long")
    found = propagate.closure(edges, spark.createDataFrame([(p,) for p in range(100, 140)], "node long"), "down")
    first = plan_of(found).split("Exchange ")
    assert len(first) == 2 and "REPARTITION_BY_NUM" in first[1] and "partial_sum" not in first[1]
    assert sorted(r.n_paths for r in found.where("node < 3").collect()) == sorted([3, 3, 4] * 40)


def test_many_mutations_of_a_node_are_dealt(spark, monkeypatch):
    """One node's mutations times its samples are not one task's; diamonds count paths."""
    for name, size in (("MUTATIONS", 16), ("SAMPLES", 8)):
        monkeypatch.setattr(propagate, name, size, raising=False)
    edges = [(40, s) for s in range(30)] + [(41, s) for s in range(20, 40)] + [(42, 40), (42, 41)]
    g = from_rows(spark, 40, edges, [(m, "A", "C", 42 if m < 100 else m - 100) for m in range(103)])
    out = propagate.carriers(g).withColumn("part", F.spark_partition_id()).collect()
    want = [(m, s, 1 + (20 <= s < 30)) for m in range(100) for s in range(40)] + [(100 + s, s, 1) for s in range(3)]
    assert sorted((r.mut_id, r.sample_idx, r.n_paths) for r in out) == want
    assert len({r.part for r in out if r.mut_id < 100}) > 1


def test_copies_above_the_same_nodes_walk_once(spark, stored):
    """New nodes above copies of a mutation share what is beneath them, and keys join before samples."""
    edges = [(40, s) for s in range(20)] + [(41, s) for s in range(20, 40)]
    g = from_rows(spark, 40, edges, [(m, "A", "C", 40 + k) for m in range(70) for k in (0, 1)])
    one = edit.ensure_unique_mutations(g)
    assert propagate.carriers(one).count() == 70 * 40 and max(stored) <= 140
    assert propagate.carriers(one, edit.KEY).columns == ["position", "ref", "alt", "sample_idx", "n_paths"]


def test_nodes_left_by_simplifying_are_dealt(spark, monkeypatch):
    for name, size in (("MUTATIONS", 16), ("SAMPLES", 8)):
        monkeypatch.setattr(propagate, name, size, raising=False)
    g = edit.simplify(from_rows(spark, 40, [(40, s) for s in range(40)] + [(41, 40)], [(m, "A", "C", 41) for m in range(100)]))
    out = propagate.carriers(g).withColumn("part", F.spark_partition_id()).collect()
    assert sorted((r.mut_id, r.sample_idx) for r in out) == [(m, s) for m in range(100) for s in range(40)]
    assert len({r.part for r in out}) > 1


def test_subsets_with_moved_samples_are_dealt(spark, monkeypatch):
    """Samples that are no longer their own nodes' ids."""
    for name, size in (("MUTATIONS", 16), ("SAMPLES", 8)):
        monkeypatch.setattr(propagate, name, size, raising=False)
    g = edit.subset_samples(from_rows(spark, 40, [(40, s) for s in range(40)] + [(41, 40)], [(m, "A", "C", 41) for m in range(100)]), list(range(39, 19, -1)))
    out = propagate.carriers(g).withColumn("part", F.spark_partition_id()).collect()
    assert sorted((r.mut_id, r.sample_idx) for r in out) == [(m, s) for m in range(100) for s in range(20)]
    assert len({r.part for r in out}) > 1
