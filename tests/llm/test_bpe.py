import hashlib
import random

import public_tokenizers as P
import pytest

from lociweave.llm.bpe import codec, decode, encode, round_trip

PATH = P.path("byte_bpe_50k.tiktoken")
CHARS = [" ", " ", "\n", "\t", "'", "s", "r", "e", "a", "the", "é", "ß", "1", "9", "!", "$", "　", "日", "🙂", "́", "\x1c", "\x85"]


@pytest.fixture(scope="module")
def own():
    return codec(PATH, P.PATTERN)


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 64])
def test_tree_equals_library(own, leaf, monkeypatch):
    monkeypatch.setattr("lociweave.llm.bpe.LEAF_CHARS", leaf)
    monkeypatch.setattr("lociweave.llm.bpe.LEAF_BYTES", leaf)
    rng = random.Random(leaf)
    for _ in range(1500):
        text = "".join(rng.choice(CHARS) for _ in range(rng.randrange(60)))
        assert own.encode(text) == own.core.encode_ordinary(text), text
        assert own.decode(own.encode(text)) == text.encode()


def test_long_matches(own):
    for text in ("a" * 9001, "ab" * 7000, "the" * 5000 + " x", " " * 5000, "é!" * 4000, "=" * 3333):
        assert own.encode(text) == own.core.encode_ordinary(text)
        assert own.encode_match(text.encode()) == own._merge(text.encode())


def test_random_bytes_in_a_match(own):
    rng = random.Random(5)
    for _ in range(300):
        piece = bytes(rng.choice(b"aeinrstth \xc3\xa9") for _ in range(rng.randrange(1, 2000)))
        assert own.encode_match(piece) == own._merge(piece)


def test_query(spark, own):
    docs = spark.createDataFrame([(1, "Hello there", 7), (2, None, 7), (3, "", 7), (3, "", 7), (4, "x " * 3000, None)], "doc_id long, text string, ids int")
    got = sorted(map(tuple, round_trip(docs, PATH, P.PATTERN).collect()))
    want = []
    for i, t in ((1, "Hello there"), (2, ""), (3, ""), (3, ""), (4, "x " * 3000)):
        ids = own.core.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == want
    nobody = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    assert [(r.doc_id, r.n_tokens) for r in round_trip(nobody, PATH, P.PATTERN).collect()] == [(None, 2)]
    assert round_trip(docs.limit(0), PATH, P.PATTERN).count() == 0
    back = {r.doc_id: bytes(r.bytes) for r in decode(encode(docs, PATH, P.PATTERN), PATH, P.PATTERN).collect()}
    assert back[1] == b"Hello there" and back[2] == b""
