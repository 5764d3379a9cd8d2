"""Site-relative line dedup, in DataFrame functions only.

For every host, the pages that contain a line are divided by the host's pages; lines over
``MAX_RATIO`` that at least ``MIN_PAGES`` pages have are boilerplate of that host and are dropped
from all of its pages. Lines are compared after trimming spaces; blank lines are never dropped.

Counting sees two 64-bit hashes of a line in place of the line (a line is taken for another one only
if both agree), once per page, and is summed per task before the shuffle. A host has less than
(lines per page / MAX_RATIO) such lines, so they travel as one array per host. Where that array is joined by
a shuffle, the pages of a host with more than a ``SHARES``th of all pages are spread over parts of about so
many pages: at most ``SHARES`` hosts are that large, so the list of them is broadcast. Pages are spread by a
hash of the row and of the partition it is read in, so copies of one text, or null texts, aren't kept together.

Defined results: null text stays null and counts as a page without lines; a text all of whose lines
go is ''; a null host is a host of its own; repeated rows count as pages; an empty table gives
none; very long texts are read whole. All columns are kept, whatever their names; only an input column called
``_ld_dropped`` is an error, as the result has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import discard, free_names, materialize

#: A line is boilerplate if over this share of its host's pages has it ...
MAX_RATIO = 0.10
#: ... and at least so many pages.
MIN_PAGES = 5
#: Hosts with more than one of so many shares of all pages are spread.
SHARES = 1000


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(F.trim(line)).alias("a"), F.xxhash64(F.lit("line"), F.trim(line)).alias("b"))


def boilerplate(pages: DataFrame, totals: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, lines array<struct<a,b>>: each host's lines to drop, as hashes. pages: host, text; totals: host, pages."""
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), _key))
    each = pages.select("host", F.explode(lines).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    over = each.join(totals.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > F.lit(max_ratio) * F.col("pages"))
    return over.groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """All columns, the text without boilerplate lines, and _ld_dropped long: how many went."""
    if "_ld_dropped" in (c.lower() for c in docs.columns):
        raise ValueError("column of the result: _ld_dropped")
    big, spread, part, own_host, own_part, lines, kept = free_names(docs.columns, "big", "spread", "part", "own_host", "own_part", "lines", "kept")
    site, text = F.col(f"`{host}`"), F.col(f"`{text_col}`")
    pages = docs.select(site.alias("host"), text.alias("text"))
    totals = materialize(pages.groupBy("host").agg(F.count("*").alias("pages")), "hosts")
    share = max(1, (totals.agg(F.sum("pages")).first()[0] or 0) // SHARES)
    parts = F.ceil(F.col("pages") / F.lit(share)).cast("int")
    found = materialize(boilerplate(pages, totals, max_ratio, min_pages).join(totals.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).select("host", "lines", parts.alias("parts")), "boilerplate")
    large = [(r.host, r.parts) for r in totals.where(F.col("pages") > share).select("host", parts.alias("parts")).collect()]  # at most SHARES rows
    discard(totals)
    hot = docs.sparkSession.createDataFrame(large, docs.select(site.alias(big), F.lit(1).alias(spread)).schema)
    right = found.select(F.col("host").alias(own_host), F.col("lines").alias(lines), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(own_part))
    row = F.xxhash64(text, site, F.spark_partition_id())
    own = docs.withColumn(part, row).join(F.broadcast(hot), site.eqNullSafe(F.col(big)), "left").withColumn(part, F.pmod(F.col(part), F.coalesce(spread, F.lit(1))).cast("int"))
    joined = own.join(right, site.eqNullSafe(F.col(own_host)) & (F.col(part) == F.col(own_part)), "left")
    split = F.split(text, "\n")
    changed = F.col(lines).isNotNull()
    out = joined.withColumn(kept, F.when(changed, F.filter(split, lambda x: (F.trim(x) == "") | ~F.array_contains(lines, _key(x)))))
    out = out.withColumn("_ld_dropped", F.when(changed & text.isNotNull(), F.size(split) - F.size(kept)).otherwise(0).cast("long"))
    out = out.withColumn(text_col, F.when(F.col("_ld_dropped") > 0, F.array_join(kept, "\n")).otherwise(text))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "_ld_dropped")


#: The same for DuckDB, over the view documents.
SQL = f"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
n AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
l AS (SELECT doc_id, source, unnest(list_distinct(list_transform(ls, lambda x: trim(x, ' ')))) AS line FROM d),
b AS (SELECT l.source, line FROM l JOIN n ON l.source IS NOT DISTINCT FROM n.source WHERE line <> '' GROUP BY l.source, line, pages HAVING count(*) >= {MIN_PAGES} AND count(*) > {MAX_RATIO} * pages),
h AS (SELECT source, list(line) AS bad FROM b GROUP BY source),
k AS (SELECT doc_id, text, ls, CASE WHEN bad IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(bad, trim(x, ' '))) END AS kept FROM d LEFT JOIN h ON d.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, coalesce(len(ls) - len(kept), 0)::BIGINT AS n_dropped,
  CASE WHEN len(kept) < len(ls) THEN coalesce(array_to_string(kept, chr(10)), '') ELSE text END AS text FROM k
"""
