"""Registered queries over whole small tables, against brute force; ids reach past every constant of their SQL."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lociweave.operators import assoc
from lociweave.plans import catalogue
from lociweave.sources import star

CUSTOMERS, PARTS = 40, 460
Q = catalogue.QUERIES


@pytest.fixture(scope="module")
def star_dir(spark, tmp_path_factory):
    rng, at = random.Random(5), tmp_path_factory.mktemp("star")
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    put("region", [(i, f"R{i}") for i in range(5)], "r_regionkey long, r_name string")
    put("nation", [(i, f"N{i}", i % 5) for i in range(25)], "n_nationkey long, n_name string, n_regionkey long")
    put("customer", [(i, i * 7 % 25, "ABCDE"[i % 5], rng.uniform(-900, 9000)) for i in range(CUSTOMERS)], "c_custkey long, c_nationkey long, c_mktsegment string, c_acctbal double")
    put("part", [(i, f"B{i % 3}", f"T{i}") for i in range(PARTS)], "p_partkey long, p_brand string, p_type string")
    put("orders", [(i, rng.randrange(CUSTOMERS)) for i in range(600)], "o_orderkey long, o_custkey long")
    put("lineitem", [(rng.randrange(600), rng.randrange(PARTS), rng.choice("NNNR")) for _ in range(2500)], "l_orderkey long, l_partkey long, l_returnflag string")
    return str(at)


def position(mut_id):
    return 1000 + 10 * (mut_id // 2)


@pytest.fixture(scope="module")
def carried(spark, star_dir):
    """All (mut_id, sample_idx), without the sources' code."""
    read = lambda name: spark.read.parquet(f"{star_dir}/{name}.parquet").collect()
    customer = {r.o_orderkey: r.o_custkey for r in read("orders")}
    return {(r.l_partkey, customer[r.l_orderkey]) for r in read("lineitem") if r.l_returnflag != "R"}


def keyed(pairs):
    return sorted((position(m), f"B{m % 3}", f"T{m}", s) for m, s in pairs)


def run(spark, star_dir, name):
    return sorted(tuple(r) for r in Q[name](spark, star_dir).collect())


def test_graphs_hold_every_carrier(spark, star_dir, carried):
    assert max(m for m, _ in carried) > 400
    for name in ("f11_merge", "f12_merge_by_samples"):
        assert run(spark, star_dir, name) == keyed(carried)
    for name in ("f13_reduce", "f26_map_mutations"):
        assert run(spark, star_dir, name) == sorted(carried)
    second = Counter(m for m, _ in carried if m >= PARTS // 2)
    assert run(spark, star_dir, "f27_mapping_stats") == sorted(second.items())


def test_transforms_read_every_carrier(spark, star_dir, carried):
    rows = keyed(carried)
    assert run(spark, star_dir, "b01_explode") == sorted((m // 2, "R", "AC"[m % 2], s) for m, s in carried)
    assert run(spark, star_dir, "b02_binary") == sorted((p, r, "1", s) for p, r, _, s in rows)
    by_key = defaultdict(list)
    for p, r, a, s in rows:
        by_key[p, r, a].append(s)
    assert run(spark, star_dir, "b06_merge_dups") == sorted((*k, ",".join(map(str, v))) for k, v in by_key.items())
    assert run(spark, star_dir, "b08_keep") == sorted((p, r, a, s // 8 * 2 + s % 2) for p, r, a, s in rows if s // 2 % 4 == 0)
    assert run(spark, star_dir, "b09_trim") == [x for x in rows if x[3] < 50]
    noisy = set(run(spark, star_dir, "b11_noise"))
    assert len(noisy ^ set(rows)) < 0.1 * len(rows) and max(p for p, *_ in noisy) > position(400)
    odd = {(m - 1, s) for m, s in carried if m % 2}
    assert run(spark, star_dir, "f35_nested_mutations") == sorted({(m, s) for m, s in carried if m % 2 == 0} - odd)


def test_windows_cover_every_position(spark, star_dir, carried):
    last = position(PARTS - 1)
    inside = [(i, m) for i in range((last - 1000) // 250 + 1) for m in range(PARTS) if 1000 + i * 250 <= position(m) < 1500 + i * 250]
    assert run(spark, star_dir, "f24_mutations_in_window") == sorted(inside)
    assert run(spark, star_dir, "f25_split") == sorted(((position(m) - 1000) // 2000, m, s) for m, s in carried)


def test_windows_follow_the_positions(spark, star_dir, tmp_path):
    """More positions than the constants of the SQL reach: none is left out."""
    for name in ("customer", "orders", "lineitem"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{star_dir}/{name}.parquet")
    n = 4000
    spark.createDataFrame([(i, "B", f"T{i}") for i in range(n)], "p_partkey long, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    assert {m for _, m in run(spark, str(tmp_path), "f24_mutations_in_window")} == set(range(n))


def test_regression_on_every_mutation(spark, star_dir, carried):
    y = defaultdict(list)
    for r in spark.read.parquet(f"{star_dir}/customer.parquet").collect():
        y[r.c_custkey // 2].append(r.c_acctbal)
    y = np.array([np.mean(y[i]) for i in range(CUSTOMERS // 2)])
    x = np.zeros((PARTS, CUSTOMERS // 2))
    for m, s in carried:
        x[m, s // 2] += 1
    got = {r.mut_id: r for r in Q["i01_gwas"](spark, star_dir).collect()}
    assert set(got) == {m for m in range(PARTS) if x[m].std() > 0} and max(got) > 300
    for m, r in got.items():
        beta, b0 = np.polyfit(x[m], y, 1)
        assert r.n_carried == x[m].sum() and r.beta == pytest.approx(beta, abs=1e-3) and r.b0 == pytest.approx(b0, abs=1e-3)
        assert r.r2 == pytest.approx(np.corrcoef(x[m], y)[0, 1] ** 2, abs=1e-4)


# the hierarchy


@pytest.fixture(scope="module")
def placed():
    """mut_id, node, missingness node and samples beneath by node, of all parts."""
    n = CUSTOMERS
    at = {m: n + 125 + m * 7 % 30 if m % 13 else None for m in range(PARTS)}
    miss = {m: n + 125 + m * 3 % 25 if m % 4 == 0 else None for m in range(PARTS)}
    beneath = defaultdict(set)
    for c in range(n):
        nation = c * 7 % 25
        beneath[n + 125 + nation].add(c)
        beneath[n + 150 + nation % 5].add(c)
    return at, miss, beneath


def test_hierarchy_holds_every_part(spark, star_dir, placed):
    at, miss, beneath = placed
    got = dict(run(spark, star_dir, "g08_stats"))
    assert got["num_mutations"] == PARTS and got["end_position"] == position(PARTS - 1) + 1
    order = sorted(range(PARTS), key=lambda m: (at[m] is not None, at[m] or 0, m))
    assert run(spark, star_dir, "d13_node_mut_pairs") == [(i, at[m], m, miss[m]) for i, m in enumerate(order)]
    assert run(spark, star_dir, "d17_unmapped") == [(m,) for m in range(0, PARTS, 13)]
    assert {n for (n,) in run(spark, star_dir, "d19_nodes_with_mutations")} == {n for n in at.values() if n}
    pairs = sorted((m, s, 1) for m, n in at.items() if n for s in beneath[n])
    assert run(spark, star_dir, "e15_carriers") == pairs
    assert run(spark, star_dir, "f17_simplify") == pairs
    assert run(spark, star_dir, "f19_subset_samples") == sorted((m, s // 20 * 2 + s % 2, 1) for m, s, _ in pairs if s // 2 % 10 == 0)


def test_copies_of_every_part(spark, star_dir, placed):
    at, _, beneath = placed
    nodes = {m: {at[m]} | ({at[m + 1]} if m % 10 == 1 and m + 1 < PARTS else set()) for m in range(PARTS)}
    want = Counter((position(m), f"B{m % 3}", f"T{m}", s) for m, own in nodes.items() for n in own if n for s in beneath[n])
    assert run(spark, star_dir, "f09_ensure_unique") == sorted((*k, v) for k, v in want.items())


def test_values_at_every_part(spark, star_dir, placed):
    at, _, beneath = placed
    for name, init in (("h06_init_vector", lambda node, row: row + 1), ("h07_init_matrix", lambda node, row: (node + row) % 5)):
        edges = [(r.parent, r.child) for r in star.hierarchy(spark, star_dir).edges.collect()]
        kids = defaultdict(list)
        for p, c in edges:
            kids[p].append(c)
        value = lambda node, row: init(node, row) + ((node * 7 + row * 3) % 11 if node < CUSTOMERS else sum(value(c, row) for c in kids[node]))  # noqa: B023, E731
        known = {n for e in edges for n in e}
        got = {(r.row, r.mut_id): r.value for r in Q[name](spark, star_dir).collect()}
        assert got == {(row, m): value(n, row) if n in known else 0 for row in range(3) for m, n in at.items()}


def test_subset_of_every_part(spark, star_dir, placed):
    at, miss, _ = placed
    edges = [(r.parent, r.child) for r in star.hierarchy(spark, star_dir).edges.collect()]
    below = {n for m in range(3, PARTS, 7) for n in (at[m], miss[m])}
    while more := {c for p, c in edges if p in below} - below:
        below |= more
    assert run(spark, star_dir, "f18_subset_mutations") == sorted((p, c) for p, c in edges if p in below)


# principal components


def relationship(x):
    f = x.sum(axis=1, keepdims=True) / (2 * x.shape[1])
    sigma = np.sqrt(2 * f * (1 - f))
    z = np.divide(x - 2 * f, sigma, out=np.zeros_like(x), where=sigma > 0)
    return z.T @ z / len(x)


def test_eigenvalues_are_exact(spark, star_dir, carried):
    x = np.zeros((PARTS, CUSTOMERS // 2))
    for m, s in carried:
        x[m, s // 2] += 1
    exact = np.linalg.eigvalsh(relationship(x))[::-1][:2]
    assert [r.eigenvalue for r in sorted(Q["i03_pca_eigenvalues"](spark, star_dir).collect())] == pytest.approx(exact, rel=1e-6)


def test_components_of_a_close_spectrum(spark):
    rng = np.random.default_rng(2)
    x = rng.binomial(2, 0.2, size=(300, 150)).astype(float)
    tables = [
        spark.createDataFrame([(int(m), int(i), int(x[m, i])) for m, i in zip(*np.nonzero(x), strict=True)], "mut_id long, individual_idx long, dosage long"),
        spark.range(300).withColumnRenamed("id", "mut_id"),
        spark.range(150).withColumnRenamed("id", "individual_idx"),
    ]
    a = relationship(x)
    exact, vectors = np.linalg.eigh(a)
    values, pcs = assoc.principal_components(*tables, k=2)
    assert values == pytest.approx(exact[::-1][:2], rel=1e-5)
    got = np.array([r[1:] for r in sorted(pcs.collect())])
    assert np.abs(a @ got - got * values).max() < 1e-2 and got.T @ got == pytest.approx(np.eye(2), abs=1e-8)
    with pytest.raises(RuntimeError):
        assoc.principal_components(*tables, k=2, rounds=2)
