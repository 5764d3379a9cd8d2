"""Quality rules as a ledger of bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed
rule; a policy is a versioned set of rules (a mask), so applying another policy, or asking what a
rule costs, reads the ledger and never the texts.

Defined results: null text counts as empty (no words, fails the length rule); an empty text
likewise; repeated rows give repeated rows; an empty table gives none; other columns are ignored.
A measurement equal to a limit passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import doc_texts, tidy

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Rule -> bit. Bits are never given anew: a policy of any version reads any ledger.
RULES = {"few_words": 0, "repeated_words": 1, "short_words": 2, "long_words": 3, "symbols": 4, "repeated_lines": 5}
#: The rules that decide ``base_failed``.
BASE = ("few_words", "repeated_words")
#: Version -> rules of the policy.
POLICIES = {1: BASE, 2: (*BASE, "short_words", "long_words", "symbols", "repeated_lines")}
SYMBOLS = b"#*$%&|<>"


def failures() -> dict[str, Column]:
    """Rule -> failed, over the measurements. Integers only: the same result everywhere."""
    c = F.col
    return {
        "few_words": c("n_words") < 50,
        "repeated_words": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "short_words": c("word_chars") < 2 * c("n_words"),
        "long_words": c("word_chars") > 20 * c("n_words"),
        "symbols": 10 * c("n_symbols") > 5 * c("n_words"),
        "repeated_lines": 100 * c("n_dup_lines") > 50 * c("n_lines"),
    }


def mask(version: int) -> int:
    return sum(1 << RULES[r] for r in POLICIES[version])


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
#: Bytes that begin a character of a word, and symbols.
_STARTS = ~_SPACE & ((np.arange(256) & 0xC0) != 0x80)
_SIGNS = np.isin(np.arange(256), list(SYMBOLS))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that the text has twice or more."""
    if len(words) < 4:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    t = h[:-2] * _MIX[0] + h[1:-1] * _MIX[1] + h[2:] * _MIX[2]
    s = np.sort(t)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    at = np.isin(t, twice)
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : k + len(t)] |= at
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """``MEASURES`` of one UTF-8 text. bytes.split() parts at the six white-space characters."""
    words = text.split()
    if not words:
        return (0,) * len(MEASURES)
    b = np.frombuffer(text, dtype=np.uint8)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return (len(words), int(np.count_nonzero(_STARTS[b])), int(np.count_nonzero(_SIGNS[b])), len(lines) - len(set(lines)), repeated_words(words), len(lines))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, measurements and fail_bits long of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            rows = [measure(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts]
            cols = zip(*rows, strict=True) if rows else [[]] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in cols)], ["doc_id", *MEASURES])

    out = doc_texts(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = F.lit(0).cast("long")
    for rule, failed in failures().items():
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << RULES[rule])).otherwise(F.lit(0)).cast("long"))
    return out.withColumn("fail_bits", bits)


def apply_policy(book: DataFrame, version: int) -> DataFrame:
    """Add base_failed and kept to a ledger."""
    failed = lambda m: F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")) != 0
    return book.withColumns({"base_failed": failed(sum(1 << RULES[r] for r in BASE)), "kept": ~failed(mask(version))})


def ablation(book: DataFrame, version: int) -> DataFrame:
    """rule, n_failed, n_only (failed by this rule alone: what leaving it out would keep), bits_with.

    The ledger is first summed by its bits (at most 2^rules rows), then by rule.
    """
    of = F.col("fail_bits").bitwiseAND(F.lit(mask(version)).cast("long"))
    sums = book.groupBy(of.alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r]).cast("long").alias("bit")) for r in POLICIES[version]])
    each = sums.withColumn("r", F.explode(rules)).select("bits", "n", "r.rule", "r.bit")
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(fails, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only"),
        F.coalesce(F.bit_or(F.when(fails, F.col("bits"))), F.lit(0).cast("long")).alias("bits_with"),
    )


#: The same for DuckDB, over the view documents (doc_id unique).
SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
tri AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w),
tri2 AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM tri),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri2),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(3) r(k) WHERE rep.n > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n, count(*) AS n_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(dup.n_lines, 0) AS n_lines FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_symbols > 5 * n_words OR 100 * n_dup_lines > 50 * n_lines AS more_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT more_failed AS kept FROM f
"""
