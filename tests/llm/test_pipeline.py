"""The pipeline against brute force, stage by stage, on a small table."""

import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from lociweave.llm import line_dedup
from lociweave.llm.queries import toxicity_model

from .test_jaccard_join import brute as brute_components
from .test_text_operators import WORD, brute_substrings


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    vocab = ["".join(rng.choice(["ta", "ro", "mi", "lu", "se", "no"]) for _ in range(3)) for _ in range(400)]
    passage = " ".join(rng.choice(vocab) for _ in range(70))
    rows, labels = [], []
    for i in range(160):
        toxic = rng.random() < 0.25
        w = [rng.choice(vocab) for _ in range(rng.randrange(3, 120))]
        for _ in range(3 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "scum", "moron"]))
        text = " ".join(w)
        if rng.random() < 0.2:
            text = text + " " + passage
        if rng.random() < 0.3:
            text = "Share this page\n" + text
        if i % 9 == 8:
            text = rows[rng.randrange(len(rows))][1] or ""
        rows.append((i, text, rng.choice(["en", None]), rng.choice(["s1", "s2", None]), len(text), 7))
        if rng.random() < 0.8:
            labels.append((i, 1, int("idiot" in text or "scum" in text or "moron" in text)))
    rows += [(900, None, None, "s1", None, 7), (901, "", "en", None, 0, 7), (None, "no id here", "en", "s1", 10, 7)]
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, length int").write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    return str(at), rows


def test_stages_equal_brute_force(spark, folder):
    at, rows = folder
    model = toxicity_model(spark, at)
    kept = [r for r, s in zip(rows, model.score([(r[1] or "").encode() for r in rows]), strict=True) if s < 0.7]
    assert 0 < len(kept) < len(rows)

    docs, got = spark.read.parquet(f"{at}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, at).persist()
        got[name] = sorted(map(tuple, docs.collect()), key=str)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "length"]
    assert got["toxicity"] == sorted(kept, key=str)

    pages, seen = Counter(r[3] for r in kept), defaultdict(int)
    for r in kept:
        for line in {x.strip(" ") for x in (r[1] or "").split("\n")} - {""}:
            seen[r[3], line] += 1
    stays = lambda x, s: not x.strip(" ") or not (seen[s, x.strip(" ")] >= line_dedup.MIN_PAGES and seen[s, x.strip(" ")] > line_dedup.MAX_RATIO * pages[s])
    lines = [(r[0], None if r[1] is None else "\n".join(x for x in r[1].split("\n") if stays(x, r[3])), *r[2:]) for r in kept]
    assert got["line_dedup"] == sorted(lines, key=str)

    group = {i: c for i, _, c in brute_components([(r[0], r[1]) for r in lines])}
    one = [r for r in lines if r[0] is None or group[r[0]] == r[0]]
    assert got["ngram_jaccard_join"] == sorted(one, key=str) and len(one) < len(lines)

    gone = {i: n for i, _, n, _ in brute_substrings([(r[0], r[1]) for r in one])}
    last = {r[0]: r for r in got["substring_dedup"]}
    assert len(last) == len(one) and any(gone.values())
    for r in one:
        assert last[r[0]][1] == r[1] if not gone[r[0]] else len(WORD.findall(last[r[0]][1])) == len(WORD.findall(r[1])) - gone[r[0]]

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    fill, pieces = Counter(), defaultdict(list)
    for p in corpus_pipeline.STAGES[-1][1](spark, docs, at).collect():
        fill[p.sequence_id] += p.length
        pieces[p.doc_id].append(p)
    for i, r in last.items():
        ids = whole.encode(r[1] or "", add_special_tokens=False).ids + [0]
        assert sum(p.length for p in pieces[i]) == len(ids)
        assert sorted(pieces[i], key=lambda p: p.piece)[0].ids_crc32 == zlib.crc32(np.array(ids[:2048], "<u4").tobytes())
    assert max(fill.values()) <= 2048


def test_run_is_the_stages(spark, folder):
    at, _ = folder
    assert corpus_pipeline.run(spark, at).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
