import random
import re

import pytest

from lociweave.llm import jaccard_join
from lociweave.llm.components import components


def brute(rows):
    """doc_id, n, component of each row, by all pairs."""
    sets, nodes = [], {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
        if i is not None:
            nodes.setdefault(i, i)

    def root(x):
        while nodes[x] != x:
            x = nodes[x]
        return x

    for p in range(len(rows)):
        for q in range(p):
            a, b = sets[p], sets[q]
            if a and b and rows[p][0] is not None and rows[q][0] is not None and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(rows[p][0]), root(rows[q][0])))
                nodes[y] = x
    return sorted(((i, len(s), None if i is None else root(i)) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocab) for _ in range(30)]
    base = [[rng.choice(vocab) for _ in range(rng.randrange(5, 120))] for _ in range(12)]
    rows = []
    for i in range(n):
        kind = rng.random()
        w = list(rng.choice(base))
        if kind < 0.5:
            for _ in range(rng.randrange(0, 7)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        elif kind < 0.6:
            w = w[: rng.randrange(1, len(w) + 1)]
        elif kind < 0.8:
            w = passage + [rng.choice(vocab) for _ in range(rng.randrange(0, 60))]
        else:
            w = [rng.choice(vocab) for _ in range(rng.randrange(0, 9))]
        text = " ".join(x.upper() if rng.random() < 0.1 else x for x in w)
        rows.append((i, text))
    return rows


ODD = [(900, None), (901, ""), (902, "  \n"), (None, "a b c"), (903, "A b C"), (904, "a B c"), (904, "a B c"), (905, "one text"), (905, "x y z"), (906, "x y z")]


@pytest.mark.parametrize("seed,block", [(32, 1 << 16), (3, 400), (2, 60)])
def test_equals_all_pairs(spark, seed, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "ROW", 0)
    rows = corpus(seed) + ODD
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, rep int, lm string")
    got = sorted(map(tuple, jaccard_join.join(docs).collect()), key=str)
    assert got == brute(rows)


def test_recursion_of_three_levels(spark, monkeypatch):
    """Chains of near copies that share regions: several pivots' regions hold more than a block."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 30)
    monkeypatch.setattr(jaccard_join, "ROW", 0)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    monkeypatch.setattr(jaccard_join, "SHRINK", 1.0)
    levels, deal = [], jaccard_join.dealt
    monkeypatch.setattr(jaccard_join, "dealt", lambda cells, level: levels.append(level) or deal(cells, level))
    rng = random.Random(8)
    text = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(140):
        for _ in range(rng.randrange(0, 3)):
            text[rng.randrange(60)] = f"w{rng.randrange(300)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.join(docs).collect()), key=str) == brute(rows)
    assert len(levels) >= 3


def test_very_long_text(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(50_000)}" for _ in range(90_000)]
    rows = [(0, " ".join(words)), (1, " ".join([*words[:-9], "x"])), (2, " ".join(words[:60_000])), (3, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.component_id for r in jaccard_join.join(docs).orderBy("doc_id").collect()] == [0, 0, 2, 3]


def test_frequent_cells_only_reorder(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(jaccard_join, "frequent", lambda d: np.packbits(np.random.default_rng(1).random(jaccard_join.CELLS) < 0.5))
    rows = corpus(11, 90)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.join(docs).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.join(docs).count() == 0


def test_components(spark):
    rng = random.Random(5)
    links = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, 300)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {x: root(x) for x in up if x != 300 and any(x in e and e[0] != e[1] for e in links)}
