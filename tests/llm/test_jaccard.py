"""Operator 2 against brute force."""

import re

import numpy as np
import pyarrow as pa
import pytest

from ledgerprep.llm import jaccard
from ledgerprep.operators.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text, k):
    words = WORD.findall((text or "").encode().translate(LOWER))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    out = []
    for n, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if group[m] == group[n] and rows[m][0] is not None]
        out.append((i, len(sets[n]), min(ids) if ids else None))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100), (1, 50, 100)])
def test_components(documents, corpus, scratch, k, num, den):
    found = jaccard.near_duplicates(documents(corpus, extra=True), scratch, k, num, den)
    assert got(found) == brute(corpus, k, num, den)


def chain(size, seed):
    """Texts of which each is near the next and far from most others."""
    rng = np.random.default_rng(seed)
    words, out = [f"w{i}" for i in range(120)], []
    for i in range(size):
        words = list(words)
        for at in rng.integers(0, len(words), 2):
            words[at] = f"n{seed}x{i}x{at}"
        out.append(" ".join(words))
    return out


def test_families_of_many_leaves(documents, scratch, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF_ROWS", 6)
    monkeypatch.setattr(jaccard, "SHARED_ROWS", 3)
    monkeypatch.setattr(jaccard, "FLUSH", 50)
    texts = chain(60, 1) + chain(30, 2) + chain(60, 1)[::2]
    rows = [((i * 37) % 1000, t) for i, t in enumerate(texts)]
    found = jaccard.near_duplicates(documents(rows), scratch, 2, 85, 100)
    assert got(found) == brute(rows, 2, 85, 100)


def test_one_of_each(documents, corpus, scratch):
    kept = jaccard.one_of_each(documents(corpus, extra=True), scratch).collect()
    expected = brute(corpus, 5, 80, 100)
    firsts = {c for _, n, c in expected if n}
    bare = sum(1 for _, n, _ in expected if not n)
    assert sorted(r.doc_id for r in kept if shingles(r.text, 5)) == sorted(firsts)
    assert sum(1 for r in kept if not shingles(r.text, 5)) == bare
    assert list(kept[0].asDict()) == documents(corpus, extra=True).columns


def test_repeated_rows_leave_one(documents, scratch):
    rows = [(1, "a b c d e f g")] * 5 + [(None, "h i j k l m")] * 3
    assert sorted(str(r.doc_id) for r in jaccard.one_of_each(documents(rows), scratch).collect()) == ["1", "None"]


def test_empty_table(documents, scratch):
    assert jaccard.near_duplicates(documents([]), scratch).collect() == []
    assert jaccard.one_of_each(documents([]), scratch).collect() == []


@pytest.mark.parametrize("num,den", [(90, 100), (80, 100), (50, 100), (2, 3)])
def test_bands_hold_all_sizes_that_link(num, den):
    begin, differ, groups, spare = jaccard.bands(num, den)
    band = lambda n: int(np.searchsorted(begin, n, side="right")) - 1
    for n in range(1, 400):
        for m in range(n, n * den // num + 1):
            assert band(m) - band(n) in (0, 1)
            for common in range(1, n + 1):
                if den * common >= num * (n + m - common):
                    assert n + m - 2 * common <= differ[band(n)]
    assert (groups == differ + 1 + spare).all()


def test_common_passages_tie_no_texts(documents, scratch):
    """Texts that share a passage and no more are of no common family; near copies still are, and so are texts of it alone."""
    rng = np.random.default_rng(8)
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 10**9, 75)) + f" {passage} " + " ".join(f"w{x}" for x in rng.integers(0, 10**9, 75))) for i in range(160)]
    rows += [(200 + i, f"new {rows[i][1]} end") for i in range(20)] + [(300, passage), (301, f"{passage} end")]
    docs = documents(rows)
    found = components(jaccard.shared_groups(docs, 5, 80, 100, 0), scratch).collect()
    assert 21 <= len(found) <= 24
    assert got(jaccard.near_duplicates(docs, scratch)) == brute(rows, 5, 80, 100)


@pytest.mark.parametrize("hottest", [2, 3, 1000])
@pytest.mark.parametrize("size", [1, 4, 200])
def test_nodes_of_a_signature_across_batches(monkeypatch, hottest, size):
    monkeypatch.setattr(jaccard, "HOTTEST", hottest)
    rng = np.random.default_rng(size)
    rows = sorted((int(s), int(n), int(n) % 5) for s, n in zip(rng.geometric(0.2, 120), rng.integers(-9, 9, 120), strict=True))
    table = pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], names=["sign", "node", "spare"])
    out = pa.Table.from_batches(jaccard._shared(iter(table.to_batches(max_chunksize=size)))).to_pylist()
    nodes = {}
    for sign, node, _ in rows:
        nodes.setdefault(sign, set()).add(node)
    expected = [(s, n, d, min(len(nodes[s]), hottest), min(nodes[s])) for s, n, d in sorted(set(rows)) if len(nodes[s]) > 1]
    assert [tuple(r.values()) for r in out] == expected


def test_components_of_paths_and_stars(spark, scratch):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 199)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)} | {200: 199}
