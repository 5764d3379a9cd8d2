"""Operators on texts against brute force, with nulls, empty and long texts, ties and repeated rows."""

import fractions
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociweave.llm import langid, line_dedup, rules, substring_dedup, topk, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# substring dedup


def brute_substrings(rows, window=50):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone.update(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def passages(seed, n=70):
    rng = random.Random(seed)
    vocab = [f"v{k}" for k in range(60)] + ["a", "é", "Ω\x1c"]
    shared = [[rng.choice(vocab) for _ in range(rng.choice([49, 50, 51, 80, 130]))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(0, 4)):
            w += rng.choice(shared) if rng.random() < 0.6 else [rng.choice(vocab) for _ in range(rng.randrange(0, 70))]
        rows.append((i * 3 % n, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(500, None), (501, ""), (None, rows[3][1]), (502, rows[5][1]), (502, rows[5][1]), (503, "x " * 400), (504, "x " * 300)]
    return rows


def test_substrings(spark):
    rows = passages(1)
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string")
    got = sorted(map(tuple, substring_dedup.digest(substring_dedup.dedup(docs)).collect()), key=str)
    assert got == brute_substrings(rows)
    assert substring_dedup.dedup(docs.limit(0)).count() == 0


def test_levels():
    assert substring_dedup.levels(50) == [13, 25, 50] and substring_dedup.levels(10) == [10]


# line dedup


def test_lines(spark):
    rows = [(i, f"Header\nbody {i}\n  Header \n\n tail", "s1") for i in range(20)] + [(100 + i, f"line {i % 3}\nx{i}", None) for i in range(9)] + [(200, None, "s1"), (201, "", "s1"), (202, "Header", "s1"), (203, "Header", "s2")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, salt int")
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(docs).collect()}
    assert len(got) == len(rows)
    pages, seen = Counter(r[2] for r in rows), defaultdict(set)
    for i, t, s in rows:
        for line in (t or "").split("\n"):
            if line.strip(" "):
                seen[s, line.strip(" ")].add(i)
    for i, t, s in rows:
        keep = [x for x in t.split("\n") if not x.strip(" ") or not (len(seen[s, x.strip(" ")]) >= line_dedup.MIN_PAGES and len(seen[s, x.strip(" ")]) > line_dedup.MAX_RATIO * pages[s])] if t is not None else None
        assert got[i].text == (None if t is None else "\n".join(keep)) and got[i].salt == 5
    assert line_dedup.drop_boilerplate(docs.limit(0)).count() == 0


def test_lines_of_odd_tables(spark):
    """Repeated rows, a very long text, columns named like internal ones."""
    long = "\n".join(["Header", *(f"line {k}" for k in range(60_000))])
    rows = [(1, "Header\nsame", "s")] * 30 + [(2, long, "s")] + [(3, None, "s")] * 40
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, source string, part int, `LINES` int, _ld_h int, spread int")
    got = line_dedup.drop_boilerplate(docs)
    assert got.columns == [*docs.columns, "_ld_dropped"]
    found = got.groupBy("doc_id", "text", "_ld_dropped", "part", "LINES", "_ld_h", "spread").count().collect()
    assert sorted((r.doc_id, r["count"], r._ld_dropped, len(r.text) if r.text is not None else None, r.part, r.LINES, r._ld_h, r.spread) for r in found) == [(1, 30, 2, 0, 1, 2, 3, 4), (2, 1, 1, len(long) - 7, 1, 2, 3, 4), (3, 40, 0, None, 1, 2, 3, 4)]


def test_substrings_of_odd_tables(spark):
    """Columns named like internal ones, a very long text, repeated rows without an id."""
    words = " ".join(f"w{k}" for k in range(120_000))
    rows = [(1, words), (2, "x " + words + " y"), (None, words), (None, words)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, _sd_key int, `at` int, starts int")
    got = substring_dedup.dedup(docs)
    assert {(r.doc_id, r._sd_words, r._sd_removed, r._sd_key, r["at"], r.starts) for r in got.collect()} == {(1, 120_000, 0, 1, 2, 3), (2, 120_002, 120_000, 1, 2, 3), (None, 120_000, 0, 1, 2, 3)}
    with pytest.raises(ValueError):
        substring_dedup.dedup(docs.withColumnRenamed("at", "_sd_kept"))


# quality rules


def test_rules(spark):
    rng = random.Random(3)
    texts = [None, "", " \n", "a b c", "a " * 60, "word another third " * 30, "# % & $ x " * 20, "ok line here\n" * 40, "\n".join(f"some words in line {i}" for i in range(40)), "é" * 2000]
    texts += [" ".join(rng.choice(["aa", "bb", "cc", "d#", "e\n"]) for _ in range(rng.randrange(120))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    book = rules.ledger(docs).persist()
    for r in rules.apply_policy(book, 2).collect():
        t = texts[r.doc_id] or ""
        w = WORD.findall(t)
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {k + j for k in range(len(w) - 2) if tri[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.base_failed and r.kept)
    bits = [r.fail_bits for r in book.collect()]
    for r in rules.ablation(book, 2).collect():
        bit, mask = 1 << rules.RULES[r.rule], rules.mask(2)
        assert r.n_failed == sum(1 for b in bits if b & bit) and r.n_only == sum(1 for b in bits if b & mask == bit)
    assert rules.ledger(docs.limit(0)).count() == 0


# exact top-k


def test_topk(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(2)]) for i in range(230)]
    rows += [(500 + i, [0.5] * 6) for i in range(12)] + [(600, None), (650, [None] * 6), (700, [float("nan")] * 6), (750, [float("inf")] * 6), (800, [1.0, 2.0]), (850, [0.0] * 6), (500, [0.5] * 6), (900, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, dim int")
    own = {(i, tuple(np.floor(np.array(v) * 256).astype(int).tolist())) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q, a in sorted(own):
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in own if i != q and len(b) == len(a))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    got = sorted(map(tuple, topk.search(df, F.col("vec_id") % 50 == 0, block=40).collect()))
    assert got == sorted(want)
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    named = df.toDF("id", "vec_id", "b")
    assert sorted(map(tuple, topk.search(named, F.col("vec_id") % 50 == 0, id_col="id", vec_col="vec_id", block=1000).collect())) == sorted(want)


def test_topk_of_large_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=4) * 10.0 ** rng.integers(0, 7)]) for i in range(120)]
    rows += [(200, [3.0e9, 1.0, 0.0, 0.25]), (201, [-3.0e9, 1.0, 0.0, 0.5]), (202, [1.0e300, 0.0, 0.0, 0.0]), (203, [0.0, 70000.5, 2.0**21, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    own = {i: [math.floor(fractions.Fraction(x) * 256) for x in v] for i, v in rows}
    asked = [(i, v) for i, v in rows if i % 20 == 7]
    queries = [(1000 + i, [0.0, *v[1:]]) for i, v in asked]  # their scores fit
    own |= {i: [math.floor(fractions.Fraction(x) * 256) for x in v] for i, v in queries}
    want = []
    for q, _ in queries:
        scores = sorted((-sum(x * y for x, y in zip(own[q], b, strict=True)), i) for i, b in own.items() if i != q)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    assert all(abs(s) < 1 << 63 for *_, s in want) and {i for _, _, i, _ in want} & {200, 201, 203}
    both = df.union(spark.createDataFrame(queries, df.schema))
    assert sorted(map(tuple, topk.search(both, F.col("vec_id") >= 1000, block=50).collect())) == sorted(want)
    with pytest.raises(Exception, match="64 bits"):
        topk.search(df, F.col("vec_id") == 200).collect()


def test_topk_stops_early():
    v = np.zeros((5000, 2), dtype=np.int64)
    v[:, 0] = np.arange(5000)
    lists = topk.Lists(np.arange(5000), v)
    read = []
    lists.values = type("V", (), {"__getitem__": lambda s, k: (read.append(k), np.sort(v, axis=0).T[k])[1]})()
    assert lists.search(4999, np.array([1, 0]), 3) == [(4998, 4998), (4997, 4997), (4996, 4996)] and len(read) <= 2


# language


def test_language(spark):
    rng = random.Random(1)
    syll = {"en": ["th", "ing", "er"], "de": ["sch", "ung", "ei"], "fr": ["eau", "oi", "é"], "es": ["ción", "ñ", "os"]}
    make = lambda v: " ".join("".join(rng.choice(syll[v]) for _ in range(3)) for _ in range(30))
    rows = [(i, make(v), v) for i in range(40) for v in [sorted(syll)[i % 4]]]
    docs = spark.createDataFrame([*rows, (90, None, "en"), (91, "123 !!", "en"), (92, "", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(got[i].lang_pred == v for i, _, v in rows) and {got[i].lang_pred for i in (90, 91, 92)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [r.doc_id for r in langid.predict(spark.createDataFrame([(None, "x")], "doc_id long, text string"), model).collect()] == [None]
    assert langid.Model([]).predict("hello") == ("und", 0.0)
    assert langid.Model([("hello", "en")]).predict("hello")[0] == "en"
    assert langid.predict(docs.limit(0), model).count() == 0


def test_language_trains_on_whole_texts_and_all_languages(spark):
    rng = random.Random(2)
    tail = {"aa": "zorbu quilx ", "bb": "mneta frosp "}
    rows = [(i, "1234567890 " * 2000 + tail[v] * 20, v) for i in range(24) for v in [("aa", "bb")[i % 2]]]
    rows += rows[:3] + [(500, rows[0][1], "bb"), (None, rows[1][1], "bb")]  # repeated rows, a tie of texts, no id
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, h long, place int")
    model = langid.fit(docs)
    assert model.predict(tail["aa"])[0] == "aa" and model.predict(tail["bb"])[0] == "bb"
    assert langid.predict(docs, model).count() == len(rows)
    assert langid.predict(docs, langid.fit(docs.limit(0))).select("lang_pred").distinct().collect()[0][0] == "und"
    letters = [chr(0x4E00 + k) for k in range(700)]
    many = [(f"{letters[k]}{letters[k + 1]} " * 5 + letters[k // 25], f"l{k:03}") for k in range(600) for _ in range(2)]
    model = langid.Model(many)
    assert sum(model.predict(t)[0] == v for t, v in many[::20]) >= 57


# toxicity


def toy(n, rng):
    bad = ["idiot", "clown", "zzvile"]
    rows = []
    for _ in range(n):
        w = ["".join(rng.choice(["ta", "ro", "mi", "lu", "se"]) for _ in range(3)) for _ in range(rng.randrange(5, 90))]
        y = rng.random() < 0.3
        for _ in range(rng.randrange(1, 4) if y else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((" ".join(w), int(y)))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = toy(300, random.Random(1))
    return toxicity.train([t.encode() for t, _ in rows], [y for _, y in rows], rounds=3)


def test_toxicity_held_out(model):
    rows = toy(200, random.Random(2))
    got = model.score([t.encode() for t, _ in rows])
    right = sum((s >= 0.7) == bool(y) for s, (_, y) in zip(got, rows, strict=True))
    assert right >= 195 and got.min() >= 0 and got.max() <= 1


def test_toxicity_windows_see_the_whole_text(model):
    long = "talumi " * 5000
    clean, toxic = model.score([long.encode(), (long + "you idiot clown idiot").encode()])
    assert clean < 0.7 <= toxic


def test_gradients():
    net, rng = toxicity.Network(1), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.normal(size=(3, toxicity.SPAN, toxicity.INPUT))
    want = np.array([1.0, 0.0, 1.0])
    loss = lambda: float(-(want * np.log(toxicity._sigmoid(net.forward(x))) + (1 - want) * np.log(1 - toxicity._sigmoid(net.forward(x)))).sum())
    logits, kept = net.forward(x, keep=True)
    grads, dx = net.backward(toxicity._sigmoid(logits) - want, kept)
    for name, g in grads.items():
        at = tuple(rng.integers(0, s) for s in net.p[name].shape)
        old, e = net.p[name][at], 1e-2
        net.p[name][at] = old + e
        up = loss()
        net.p[name][at] = old - e
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / (2 * e) - g[at]) < 2e-2 * max(1, abs(g[at])), name
    assert dx.shape == x.shape


def test_toxicity_scores_every_start():
    """A text's score is that of the best window at any of its words, by scoring each alone."""
    rng = random.Random(9)
    tell = [b"tell%d" % k for k in range(4)]
    model = toxicity.train([b" ".join([b"plain%d" % rng.randrange(50) for _ in range(12)] + (tell if y else [])) for y in [0, 1] * 60], [0, 1] * 60, rounds=2)
    for before in range(16):
        words = [b"plain%d" % (k % 50) for k in range(60)]
        words[before + 10], words[before + 23] = tell[0], tell[1]
        each = model.logits([b" ".join(words[k : k + toxicity.SPAN]) for k in range(len(words) - toxicity.SPAN + 1)])
        assert model.logits([b" ".join(words)])[0] == pytest.approx(each.max(), abs=1e-5)


def test_toxicity_trains_on_whole_texts(spark):
    long = "plain words here " * 1200  # over 12,000 characters before the telling part
    rows = [(i, (long if i % 2 else "some other text ") + ("vile awful scum" if i % 2 else f"n{i}")) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    words, *_ = toxicity.features([b"scum"])
    assert model.words.find(words)[0] >= 0


def test_toxicity_finds_all_entries():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 16_384, dtype=np.uint64)
    known = toxicity.Entries(keys)
    assert len(known.shared) and (known.find(keys) == np.arange(len(keys))).all() and (known.find(keys + np.uint64(1)) == -1).all()


def test_toxicity_edges(spark, model):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "idiot clown idiot", 0.5), (3, "idiot clown idiot", 0.5), (None, "talumi", 0.5)], "doc_id long, text string, score double")
    got = sorted((r.doc_id or 0, r.score >= 0.7) for r in toxicity.score(docs, model).collect())
    assert got == [(0, False), (1, False), (2, False), (3, True), (3, True)]
    assert toxicity.keep_clean(docs, model).count() == 3 and toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.train([b"a"], [0]).score([b"a"]).tolist() == [0.0]
