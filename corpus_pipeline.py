"""Corpus pipeline over ``documents``: five stages, each written as Parquet and read again.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Rows with a null doc_id stay through the filters and take no part in the joins; null and empty
texts stay to the end, as a piece each; rows with one doc_id stay or go together in the near-duplicate stage;
an empty table gives no rows; very long texts are read whole. Only the stages' tables in the shared folder that
the result reads are left when ``run`` returns, until the session ends.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.llm import jaccard_join, line_dedup, packing, substring_dedup, toxicity
from lociweave.llm.queries import toxicity_model
from lociweave.llm.runtime import discard, materialize, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score at least the threshold. The model is trained on the labelled rows of
    the documents table that aren't held out."""
    return toxicity.keep_clean(docs, toxicity_model(spark, sf_dir))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop each source's boilerplate lines."""
    return line_dedup.drop_boilerplate(docs).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest document of each component of near duplicates."""
    found = jaccard_join.join(docs).where("component_id is null or component_id = doc_id").select("doc_id").distinct()
    gone = docs["doc_id"].isNotNull()
    return docs.where(gone).join(found, "doc_id", "left_semi").select(*docs.columns).union(docs.where(~gone))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages that an earlier document has; texts that lose nothing stay as they are."""
    out = substring_dedup.dedup(docs)
    text = F.when(F.col("_sd_removed") > 0, F.col("_sd_kept")).otherwise(F.col("text"))
    return out.withColumn("text", text).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all texts into sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can't express the trained model of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
