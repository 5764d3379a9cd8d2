"""Chat formatting over reply trees.

Messages form trees by their parent. Iterative self-joins double the reach of every message's link
towards its root, adding up scores and depth on the way; leaves are ranked by the summed score of
their path (ties: the longer path, then the smaller message id); the chosen paths are spelled out by
the same links, and each becomes one conversation. A path of d messages takes log2(d) joins.

Template of a turn: ``<turn>ROLE<text>TEXT</turn>`` and a line feed. In role and text a backslash
is put before every ``\\`` and ``<``, so no control string can occur inside, and reading back drops
it again. The loss mask is the spans of the assistants' texts in the output, in code points.

Defined results: null text and role count as ''; a null conversation id is a conversation of its own;
a parent that doesn't exist makes a root; messages on a cycle are on no path; equal rows are separate
messages; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize, tidy

ASSISTANT = "assistant"
_UNSAFE, _SAFE = re.compile(r"[\\<]"), re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<turn>((?:[^\\<]|\\.)*)<text>((?:[^\\<]|\\.)*)</turn>\n", re.DOTALL)
FORMATTED = "conv_id long, leaf_id long, branch int, score double, formatted string, loss_mask array<struct<start:long,length:long>>"


def escape(text: str) -> str:
    return _UNSAFE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _SAFE.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]], roles: tuple[str, ...] = (ASSISTANT,)) -> tuple[str, list[tuple[int, int]]]:
    """The conversation and its loss mask, as (start, length)."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body, tail = f"<turn>{escape(role)}<text>", escape(text), "</turn>\n"
        if role in roles:
            spans.append((at + len(head), len(body)))
        out += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(out), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def reply_chain(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages of conversations that are lists: each turn replies to the one before it."""
    own = rows.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return own.select("conv_id", n.alias("msg_id"), F.when(n > 1, n - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """key, leaf, branch, total, node, depth: the messages of each conversation's best paths.

    messages: durable rows of key string, node, parent, score.
    """
    m = messages.select("key", "node", "parent", "score")
    parents = m.select("key", F.col("node").alias("parent"), F.lit(True).alias("known"))
    state = m.join(parents, ["key", "parent"], "left").select("key", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total"))
    links = materialize(state, "links")
    done, open_, levels = [links.where("up is null")], links.where("up is not null"), []
    most, n = 1, links.count()
    while most <= n and open_.limit(1).count():
        levels.append(open_.select("key", "node", "up"))  # level k: links over 2^k replies
        above = functools.reduce(DataFrame.union, [*done, open_]).select("key", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("total").alias("t2"))
        links = materialize(open_.join(above, ["key", "up"]).select("key", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("total") + F.col("t2")).alias("total")), "links")
        done.append(links.where("up is null"))
        open_ = links.where("up is not null")  # messages whose link has not met its root
        most *= 2
    ends = functools.reduce(DataFrame.union, done)  # on a cycle the link never ends
    inner = m.where("parent is not null").select("key", F.col("parent").alias("node")).distinct()
    order = Window.partitionBy("key").orderBy(F.desc("total"), F.desc("depth"), "node")
    leaves = ends.join(inner, ["key", "node"], "left_anti").withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= branches)
    paths = leaves.select("key", F.col("node").alias("leaf"), "branch", F.col("total").alias("path_total"), "node")
    for level in reversed(levels):
        paths = materialize(paths.union(paths.join(level, ["key", "node"]).select("key", "leaf", "branch", "path_total", F.col("up").alias("node"))), "paths")
    return paths.join(ends.select("key", "node", "depth"), ["key", "node"])


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Columns of ``FORMATTED``: the best ``branches`` paths of every conversation.

    messages: conv_id, msg_id, parent_id, role, text, score.
    """
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    rows = materialize(messages.select(key.alias("key"), "conv_id", F.col("msg_id").alias("node"), F.col("parent_id").alias("parent"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score")), "messages")
    chosen = best_paths(rows, branches).join(rows.select("key", "node", "conv_id", "role", "text"), ["key", "node"])
    turns = chosen.groupBy("key", "leaf", "branch").agg(F.first("conv_id").alias("conv_id"), F.first("path_total").alias("score"), F.array_sort(F.collect_list(F.struct("depth", "node", "role", "text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [format_turns([(t["role"], t["text"]) for t in x.as_py()]) for x in b.column(4)]
            spans = pa.array([[{"start": s, "length": n} for s, n in m] for _, m in made], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([t for t, _ in made], pa.string()), spans], ["conv_id", "leaf_id", "branch", "score", "formatted", "loss_mask"])

    return turns.select("conv_id", F.col("leaf").cast("long").alias("leaf_id"), "branch", "score", "turns").mapInArrow(tidy(run), FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what a reader gets out of formatted conversations and their loss masks."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text, mask in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                turns = parse_turns(text)
                loss = "".join(unescape(text[s["start"] : s["start"] + s["length"]]) for s in mask)
                digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
                rows.append((i, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return formatted.select("conv_id", "formatted", "loss_mask").mapInArrow(tidy(run), schema)


#: The same for DuckDB, over the view conversations (turn unique in a conversation).
SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS turns,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '') AS loss,
  sum(20 + length(role) + length(text) + len(regexp_extract_all(role || text, '[\\<]'))) AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM a
"""
