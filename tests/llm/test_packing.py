import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from lociweave.llm import packing
from lociweave.llm.packing import fullest, pack_documents, plan, word_ids

PATH = P.path("word_bpe_49k.json")


def test_word_ids_equal_library():
    own, whole = word_ids(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(3)
    chars = [" ", " ", "\n", "\t", "'", "'s", "'re", "S", "r", "e", "the", "É", "é", "ß", "İ", "ª", "²", "1", "9", "!", "$", "　", "日", "🙂", "é", "\x1c", "\x85", "\xa0", "Σ", "<|endoftext|>", "ǆ", "ŉ", "ﬁ"]
    for _ in range(3000):
        text = "".join(rng.choice(chars) for _ in range(rng.randrange(30)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_seen_once_take_no_memory(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    own, whole = packing.WordIds(PATH), Tokenizer.from_file(PATH)
    for text in [*(f"word{i}" for i in range(1000)), "Often said, often said", "often said"]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    assert "often" in own and "said" in own and len(own) <= 50 and "word500" not in own


def test_fullest_is_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        items = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 9))]
        room = rng.randrange(0, 60)
        best = max(s for k in range(len(items) + 1) for c in itertools.combinations(items, k) if (s := sum(c)) <= room)
        got = fullest(Counter(items), room)
        assert sum(k * n for k, n in got.items()) == best and not got - Counter(items)


def test_plan_uses_all_pieces():
    rng = random.Random(2)
    counts = Counter(rng.choice([rng.randrange(1, 2049), 2048, 7]) for _ in range(20000))
    made = plan(counts)
    used = Counter()
    for found, times in made:
        assert sum(k * n for k, n in found.items()) <= 2048 and times > 0
        for k, n in found.items():
            used[k] += n * times
    assert used == counts
    total, bins = sum(k * n for k, n in counts.items()), sum(t for _, t in made)
    assert bins <= total / 2048 * 1.003 + 1


def test_query(spark):
    rng = random.Random(4)
    texts = [None, "", "hello world", "a <|endoftext|> b<|startoftext|>c", "word " * 5000, "x1y2 " * 900] + ["lorem ipsum dolor " * rng.randrange(1, 300) for _ in range(150)] + ["same text here"] * 120
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    rows = pack_documents(docs, PATH).collect()
    whole = Tokenizer.from_file(PATH)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        want = [(k, at, min(2048, len(ids) - at), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in own] == want
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_seq) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert pack_documents(docs.limit(0), PATH).count() == 0
    nobody = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted(r.length for r in pack_documents(nobody, PATH).collect()) == [1, 3]
    twice = pack_documents(docs.union(docs).where("doc_id < 4"), PATH).collect()
    assert len(twice) == 8 and len({(r.sequence_id, r.offset) for r in twice}) == 8
