from lociweave.cli import main

from .test_sources import vcf


def test_construct_process_merge(spark, tmp_path):
    one = vcf(tmp_path, [("1", 10, "A", "C", ["0|1", "1|1", "0|0"]), ("1", 20, "A", "C,G", ["1|2", "2|2", "0|1"])], "a.vcf")
    two = vcf(tmp_path, [("1", 30, "T", "G", ["1|1", "0|0", "0|0"])], "b.vcf")
    at = lambda n: str(tmp_path / n)
    main(["construct", one, at("a.graph")], spark)
    main(["construct", two, at("b.graph")], spark)
    main(["merge", at("ab.graph"), at("a.graph"), at("b.graph") + ":5"], spark)
    main(["process", "freq", at("ab.graph"), at("freq.tsv")], spark)
    got = {(r.position, r.alt): (r.alt_count, r.total) for r in spark.read.csv(at("freq.tsv"), sep="\t", header=True).collect()}
    assert got == {("10", "C"): ("3", "6"), ("20", "C"): ("2", "6"), ("20", "G"): ("3", "6"), ("35", "G"): ("2", "6")}
    main(["process", "zygosity", at("a.graph"), at("zyg.tsv")], spark)
    got = {(r.position, r.alt): (r.n_aa0, r.n_het, r.n_hom) for r in spark.read.csv(at("zyg.tsv"), sep="\t", header=True).collect()}
    assert got == {("10", "C"): ("1", "1", "1"), ("20", "C"): ("1", "2", "0"), ("20", "G"): ("1", "1", "1")}
    main(["split", at("a.graph"), at("parts"), "--size", "10"], spark)
    assert spark.read.parquet(at("parts")).select("window_id").distinct().count() == 2


def test_missing_data_is_kept(spark, tmp_path):
    source = vcf(tmp_path, [("1", 10, "A", "C", ["0|1", ".|.", "0|0"]), ("1", 20, "A", "C", ["1|1", "0|.", "0|1"])], "m.vcf")
    at = lambda n: str(tmp_path / n)
    for name, options, want in (("a", [], {("10", "C"): ("1", "2"), ("20", "C"): ("3", "1")}), ("b", ["--ignore-missing"], {("10", "C"): ("1", "0"), ("20", "C"): ("3", "0")})):
        main(["construct", source, at(name + ".graph"), *options], spark)
        main(["process", "freq", at(name + ".graph"), at(name + ".tsv")], spark)
        got = {(r.position, r.alt): (r.alt_count, r.miss_count) for r in spark.read.csv(at(name + ".tsv"), sep="\t", header=True).collect()}
        assert got == want
