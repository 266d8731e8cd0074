"""Operator 12: search trees, shards and their merging against a tree of nested dictionaries."""

import hashlib
import random
import zlib

import duckdb
import pytest

from ledgerprep.llm import trie
from ledgerprep.llm.q_trie import ORACLES, op12_prefix_trie, rebuilt

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]


def expected(members):
    """Nodes of conversations {conv: [(role, text), ...]}."""
    nodes = {}
    for conv, turns in members.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(conv)
    out = set()
    for path, convs in nodes.items():
        inside = [p for p in nodes if p[: len(path)] == path]
        children = lambda p: sum(q[:-1] == p and len(q) == len(p) + 1 for q in inside)
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in inside if p)
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(members[c]) == len(path)))
        out.add(
            (min(convs), len(path), min(nodes[path[:-1]]) if path else None, len(convs), children(path),
             sum(not children(p) for p in inside), saved, hashlib.sha256(ends.encode()).hexdigest())
        )
    return out


def table(rng, convs):
    """Conversations with shared beginnings, copies, nulls, repeated turns, and a long one."""
    rows = []
    for conv in convs:
        for turn in range(rng.randint(1, 10)):
            rows.append((conv, turn, rng.choice(["user", "assistant"]) if rng.random() < 0.2 else "user", rng.choice(["a", "bé", "a", "a", "ccc"])))
    rows += [(3, None, None, "first"), (5, 1, "user", "tie"), (5, 1, "user", "tie"), (5, 1, "assistant", "tie"), (7, 2, "user", None)]
    rows += [(None, 0, "user", "lost")] + [(max(convs) + 1, t, "user", "a") for t in range(300)]
    return rows


def spliced(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [(r, t) for _, r, t in sorted(x)] for c, x in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        source = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = turns.get(source, [])[:h] + own[h:]
    return out


@pytest.mark.parametrize("seed, shard", [(1, 10**6), (3, 7), (4, 150)])
def test_against_nested_dictionaries(spark, tmp_path, monkeypatch, seed, shard):
    monkeypatch.setattr(trie, "SHARD_TURNS", shard)
    rng = random.Random(seed)
    rows = table(rng, [*range(0, 45), -3, -7, 1000])
    rng.shuffle(rows)
    folder = tmp_path / "sf"
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS conv", "2 AS code", "3 AS shard", "'x' AS key", "0 AS depth")
    df.repartition(3).write.parquet(f"{folder}/conversations.parquet")
    got = [tuple(r) for r in op12_prefix_trie(spark, str(folder)).collect()]
    want = expected(spliced(rows))
    assert len(got) == len(want) and set(got) == want


def test_sql_gives_the_same(spark, tmp_path):
    rows = table(random.Random(9), [*range(0, 30), -3])[:-280]
    folder = tmp_path / "sf"
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    assert set(con.execute(ORACLES["op12_prefix_trie"]).fetchall()) == expected(spliced(rows))


def given(spark, members):
    """Sequences over letters: a letter is its own number, and its text has as many bytes."""
    rows = [(c, list(map(ord, s)), [ord(x) % 7 for x in s]) for c, s in members.items()]
    return spark.createDataFrame(rows, "conv long, codes array<bigint>, sizes array<int>")


@pytest.mark.parametrize("shard", [1, 5, 30])
def test_shards_merge(spark, scratch, monkeypatch, shard):
    monkeypatch.setattr(trie, "SHARD_TURNS", shard)
    rng = random.Random(shard)
    members = {c: "".join(rng.choices("ab", weights=[8, 1], k=rng.randint(0, 14))) for c in range(60)}
    members |= {100 + c: "ab" for c in range(40)} | {200: "", 201: "aaaaaaaaaaaaaaaaaaaaaaaaaa"}
    got = {tuple(r) for r in trie.prefix_trie(given(spark, members), scratch).select(*COLUMNS).collect()}
    nodes = {}
    for c, s in members.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    assert len(got) == len(nodes)
    for path, convs in nodes.items():
        inside = [p for p in nodes if p.startswith(path)]
        leaves = sum(not any(q[:-1] == p and q for q in nodes) for p in inside)
        saved = sum((len(nodes[p]) - 1) * (ord(p[-1]) % 7) for p in inside if p)
        ends = ",".join(str(c) for c in sorted(c for c in convs if members[c] == path))
        row = (min(convs), len(path), min(nodes[path[:-1]]) if path else None, len(convs), sum(q[:-1] == path and q != "" for q in nodes), leaves, saved)
        assert (*row, hashlib.sha256(ends.encode()).hexdigest()) in got


def test_tree_is_balanced_and_keeps_paths():
    tree = trie.Tree()
    letters = [[i] for i in range(1000)]
    where = {}
    for m in trie.medians(1000):
        where[m] = tree.insert(letters[m], [1])
    assert sorted(where) == list(range(1000))
    steps, at = 0, tree.child[0]
    while at >= 0:
        steps, at = steps + 1, tree.high[at]
    assert steps <= 10
    assert tree.insert([5, 6, 7], [1, 1, 1]) == len(tree.code) - 1
    assert [tree.code[i] for i in tree.path(len(tree.code) - 1, 2)] == [0, 5, 6]


def test_common_turns_get_the_same_numbers(spark, scratch):
    rows = [(c, t, "user", "yes" if t else str(c % 3)) for c in range(200) for t in range(4)]
    out = {r.conv: r for r in trie.sequences(spark.createDataFrame(rows, SCHEMA), scratch).collect()}
    assert len({tuple(r.codes[1:]) for r in out.values()}) == 1 and len({r.codes[0] for r in out.values()}) == 3
    assert out[0].sizes == [1, 3, 3, 3]


def test_text_ids_and_empty_table(spark, scratch):
    rows = [("abc", 0, "user", "x"), ("7", 0, "user", "y"), (None, 0, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    assert [r.conv for r in trie.sequences(df, scratch).collect()] == [7]
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(rebuilt(trie.sequences(empty, scratch)), scratch).collect() == []


def test_runs_import_what_they_use(monkeypatch):
    # A worker may have imported pyarrow alone: pyarrow.compute is a module of its own.
    values = trie.pa.array([1, 1, 2])
    monkeypatch.delattr(trie.pa, "compute", raising=False)
    assert trie._runs(values) == [0, 2, 3]
