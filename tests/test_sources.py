import random

import pytest

from lociweave.operators import transforms
from lociweave.sources import files

HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\tS3\n"


def vcf(tmp_path, rows, name="x.vcf"):
    p = tmp_path / name
    p.write_text(HEAD + "".join("\t".join([c, str(pos), ".", ref, alt, ".", ".", ".", "GT", *g]) + "\n" for c, pos, ref, alt, g in rows))
    return str(p)


def test_variant_text(spark, tmp_path):
    rows = [("1", 4000, "A", "C", ["0|1", "1|1", "0|0"]), ("1", 4500, "A", "C,G", ["1|2", "2|2", ".|1"]), ("1", 7777, "T", "TA", ["0|0", "0|0", "0|0"])]
    path = vcf(tmp_path, rows)
    got = {(r.position, r.alt): r.samples for r in files.variant_lists(files.read_variants(spark, path)).collect()}
    assert got == {(4000, "C"): [1, 2, 3], (4500, "."): [4], (4500, "C"): [0, 5], (4500, "G"): [1, 2, 3]}
    assert [r.alt for r in files.variant_lists(files.read_variants(spark, path, 4500, 4501)).collect()][0] == "."
    assert files.metadata(spark, path) == {"ploidy": 2, "individuals": 3, "phased": True}
    assert [r.individual_id for r in files.individual_ids(spark, path).orderBy("individual_idx").collect()] == ["S1", "S2", "S3"]
    rows_ = files.read_variants(spark, path)
    assert files.count_variants(rows_) == 4 and files.count_variants(rows_, 4000, 4001) == 1
    assert {r.alt for r in files.restrict(rows_, 1, 3, "variant").collect()} == {".", "C"}
    assert files.restrict(rows_, 0.0, 0.5, "share").select("position").distinct().count() == 1
    with pytest.raises(ValueError):
        files.read_variants(spark, "x.unknown")
    with pytest.raises(ValueError):
        files.genotypes(spark, vcf(tmp_path, [rows[0], ("2", 5, "A", "C", ["0|1"] * 3)], "y.vcf"))


def test_small_tables(spark, tmp_path):
    (tmp_path / "m.txt").write_text("Position(bp)\tMap(cM)\n1\t0.0\n5\t1.5\n")
    assert [tuple(r) for r in files.read_recombination_map(spark, str(tmp_path / "m.txt")).collect()] == [(1, 0.0), (5, 1.5)]
    (tmp_path / "n.txt").write_text("3\n\n5\n")
    assert sorted(r.node_id for r in files.read_node_ids(spark, str(tmp_path / "n.txt")).collect()) == [3, 5]
    (tmp_path / "r.txt").write_text("0 10\n10 20\n")
    assert sorted(map(tuple, files.read_ranges(spark, str(tmp_path / "r.txt")).collect())) == [(0, 0, 10), (1, 10, 20)]
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx\n1\ty\n2\tz\n")
    assert files.read_map(spark, str(tmp_path / "t.tsv"), "a", "b").count() == 2


def test_flip(spark):
    rows = [(5, "A", "C", s) for s in range(5)] + [(5, "A", "G", 5), (9, "A", "C", 0)]
    samples = spark.createDataFrame([(s,) for s in range(8)], "sample_idx long")
    got = transforms.flip_to_major(spark.createDataFrame(rows, "position long, ref string, alt string, sample_idx long"), samples)
    assert sorted(map(tuple, got.collect())) == [(5, "C", "A", 6), (5, "C", "A", 7), (5, "C", "G", 5), (9, "A", "C", 0)]


def test_populations(spark):
    people = spark.createDataFrame(list(enumerate(["X1", "X2", "X3", "A1", "Z1"])), "individual_idx long, individual_id string")
    mapping = [("Z1", "P2"), ("X1", "P4"), ("X2", "P1"), ("A1", "P1"), ("X3", "P4")]
    own, pops = transforms.assign_populations(people, spark.createDataFrame(mapping, "individual_id string, population string"))
    assert [r.description for r in pops.orderBy("pop_id").collect()] == ["P4", "P1", "P2"]
    assert dict(map(tuple, own.collect())) == {0: 0, 1: 1, 2: 0, 3: 1, 4: 2}
    with pytest.raises(ValueError):
        transforms.assign_populations(people, spark.createDataFrame(mapping[:3], "individual_id string, population string"))


def test_tree_sequence(spark):
    nodes = spark.createDataFrame([(i, i < 4) for i in range(7)], "id long, is_sample boolean")
    edges = spark.createDataFrame([(0.0, 10.0, 4, 0), (0.0, 10.0, 4, 1), (0.0, 5.0, 5, 2), (5.0, 10.0, 4, 2), (0.0, 10.0, 5, 3), (0.0, 10.0, 6, 4), (0.0, 10.0, 6, 5)], "left double, right double, parent long, child long")
    sites = spark.createDataFrame([(0, 1.0, "A"), (1, 7.0, "A"), (2, 8.0, "A")], "id long, position double, ancestral_state string")
    muts = spark.createDataFrame([(0, 0, 5, "C", -1), (1, 1, 4, "C", -1), (2, 2, 6, "G", -1), (3, 2, 4, "A", 2)], "id long, site long, node long, derived_state string, parent long")
    got = sorted(map(tuple, files.from_tree_sequence(nodes, edges, sites, muts).collect()))
    assert got == [(1, "A", "C", 2), (1, "A", "C", 3), (7, "A", "C", 0), (7, "A", "C", 1), (7, "A", "C", 2), (8, "A", "G", 3)]


def test_noise_is_bounded(spark):
    rng = random.Random(1)
    rows = [(m, "A", "C", s) for m in range(20) for s in range(50) if rng.random() < 0.4]
    samples = spark.createDataFrame([(s,) for s in range(50)], "sample_idx long")
    df = spark.createDataFrame(rows, "position long, ref string, alt string, sample_idx long")
    assert sorted(map(tuple, transforms.add_noise(df, samples, 0.0, 0.0).collect())) == sorted(rows)
    assert transforms.add_noise(df, samples, 1.0, 0.0).count() == 0
