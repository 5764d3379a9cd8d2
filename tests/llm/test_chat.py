import itertools
import random

from lociweave.llm.chat import escape, format_trees, format_turns, parse_turns, read_back, reply_chain, unescape


def test_round_trip():
    rng = random.Random(1)
    parts = ["\\", "<", ">", "<turn>", "</turn>", "<text>", "\n", "a", "é", "### Assistant:", "\\<", "🙂"]
    for _ in range(500):
        turns = [("".join(rng.choices(parts, k=rng.randrange(3))), "".join(rng.choices(parts, k=rng.randrange(6)))) for _ in range(rng.randrange(4))]
        made, mask = format_turns([*turns, ("assistant", "x<y\\")])
        assert parse_turns(made) == [*turns, ("assistant", "x<y\\")]
        assert unescape(made[mask[-1][0] : mask[-1][0] + mask[-1][1]]) == "x<y\\"
        assert all(unescape(escape(t)) == t for _, t in turns)


def brute(rows, branches):
    """(conv, leaf, branch) -> texts from root to leaf."""
    out = {}
    for conv, own in itertools.groupby(sorted(rows, key=lambda r: (r[0], r[1])), key=lambda r: r[0]):
        own = {r[1]: r for r in own}
        inner = {r[2] for r in own.values()}
        found = []
        for leaf in own:
            if leaf in inner:
                continue
            path, at = [], leaf
            while at in own and len(path) <= len(own):
                path.append(own[at])
                at = own[at][2]
            if len(path) <= len(own):
                found.append((-sum(r[5] for r in path), -len(path), leaf, [(r[3], r[4]) for r in reversed(path)]))
        for k, (_, _, leaf, turns) in enumerate(sorted(found)[:branches]):
            out[conv, leaf, k + 1] = turns
    return out


def test_trees(spark):
    rng = random.Random(7)
    rows = []
    for conv in range(12):
        for i in range(rng.randrange(1, 40)):
            parent = rng.choice([None, i - 1, rng.randrange(i)]) if i else None
            rows.append((conv, i, parent, rng.choice(["user", "assistant"]), f"t{conv}.{i}<", float(rng.randrange(3))))
    rows += [(50, 0, 1, "user", "cycle", 1.0), (50, 1, 0, "user", "cycle", 1.0), (51, 3, 99, "user", "orphan", 0.0)]
    messages = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    got = {(r.conv_id, r.leaf_id, r.branch): parse_turns(r.formatted) for r in format_trees(messages, 2).collect()}
    assert got == brute(rows, 2)


def test_chain_and_nulls(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, 5, None, "b"), (None, 0, "assistant", "c"), *[(3, k, "user", str(k)) for k in range(70)]]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as node", "2 as key")
    got = {r.conv_id: r for r in read_back(format_trees(reply_chain(table))).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, 2: 1, 3: 70, None: 1}
    assert got[None].loss_chars == 1 and got[2].loss_chars == 0
    assert read_back(format_trees(reply_chain(table.limit(0)))).count() == 0
