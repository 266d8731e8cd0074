"""Operator 8: template, tree and stream, read back exactly."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerprep.llm import chat
from ledgerprep.llm.token_shards import VOCABULARY, _encoder

PARTS = st.sampled_from(["\\", "<turn>", "</turn>", "### ", "### x: ", ":", " ", "\n", "a", "é", "<", "/", "#"])
TEXTS = st.lists(PARTS, max_size=8).map("".join)


@given(st.lists(st.tuples(TEXTS, TEXTS), max_size=4))
@settings(max_examples=500, deadline=None)
def test_template_reads_back(turns):
    formatted = "".join(chat.OPEN + chat.escape(r, True) + chat.SEPARATOR + chat.escape(t) + chat.CLOSE for r, t in turns)
    assert chat.parse(formatted) == turns


def table(rng):
    """conv_id, turn, role, text: shared beginnings of every depth, repeats, nulls."""
    pool = [["system", "user"][n % 2] + str(n) for n in range(3)]
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(rng.randint(1, 7)):
            role = rng.choice(["user", "assistant"]) if turn else "user"
            text = rng.choice(pool) if rng.random() < 0.8 else rng.choice(["", None, r"\### Assistant: </turn> ok", "x" * 3000])
            rows.append((conv, turn, role, text))
    return rows + [(3, None, None, "first"), (5, 1, "user", "tie"), (5, 1, "user", "tie"), (5, 1, "assistant", "tie")]


def expected(rows):
    out, by_conv = set(), {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    for conv, turns in by_conv.items():
        turns = [(r, t) for _, r, t in sorted(turns)]
        learned = "".join(t for r, t in turns if r == "assistant")
        formatted = "".join(chat.OPEN + chat.escape(r, True) + chat.SEPARATOR + chat.escape(t) + chat.CLOSE for r, t in turns)
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        out.add((conv, len(turns), digest, len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(formatted)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_conversations_read_back(spark, scratch, seed):
    rows = table(random.Random(seed))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS node", "2 AS place")
    stream, paths = chat.format_chats(df, scratch)
    assert {tuple(r) for r in chat.read_back(stream, paths).collect()} == expected(rows)
    tokens, at = [], 0
    nodes = {}
    for r in stream.orderBy("place").collect():
        assert r.place == at  # one stream without gaps, each node once
        ids = np.frombuffer(r.ids, dtype="<u2").tolist()
        tokens += ids
        at += len(ids)
        assert bytes(r.node) not in nodes
        nodes[bytes(r.node)] = r
    with open(VOCABULARY, "rb") as file:
        plain = _encoder(file.read()).plain
    before = {}
    for r in paths.orderBy("conv", "depth").collect():
        node, prefix = nodes[bytes(r.node)], before.get(r.conv, [])
        seen = [t for a in node.ancestors for t in tokens[a.begin : a.stop]]
        assert seen == prefix and node.position == len(prefix)  # exactly what stands before, in order
        before[r.conv] = prefix + np.frombuffer(node.ids, dtype="<u2").tolist()
        assert plain.decode_bytes(before[r.conv]).decode().count(chat.OPEN) >= r.depth
    order = [bytes(n.node) for n in sorted(nodes.values(), key=lambda n: n.place)]
    parents = {bytes(r.node): bytes(r.parent) for r in chat.turns(df).collect()}
    open_ = []
    for node in order:  # depth first: a node's parent is among the open ones
        while open_ and open_[-1] != parents[node]:
            open_.pop()
        assert open_ or parents[node] == b""
        open_.append(node)


def test_empty_table(spark, scratch):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    stream, paths = chat.format_chats(df, scratch)
    assert stream.collect() == [] and chat.read_back(stream, paths).collect() == []
