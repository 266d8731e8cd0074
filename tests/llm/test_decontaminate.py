"""Operator 3 against brute force."""

import re

import random
import time

import pyarrow as pa
import pytest

from ledgerprep.llm.decontaminate import _block, _find, judged, matches, suffix_array
from ledgerprep.llm.words import NO_ALNUM, words_of

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def split(text):
    return WORD.findall((text or "").encode().translate(LOWER))


def brute(rows, items, window):
    out = []
    for i, text in rows:
        words, hit, ids = split(text), set(), set()
        for item, content in items:
            w = split(content)
            n = min(window, len(w))
            if item is None or not n:
                continue
            for a in range(len(w) - n + 1):
                for at in range(len(words) - n + 1):
                    if words[at : at + n] == w[a : a + n]:
                        hit.update(range(at, at + n))
                        ids.add(item)
        out.append((i, len(words), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window,block", [(13, 1 << 24), (13, 300), (3, 1 << 24), (3, 300)])
def test_hits(spark, documents, corpus, scratch, window, block):
    rows = [r for r in corpus if r[0] != 99]
    passage = corpus[50][1]
    items = [(1, passage), (1, passage), (2, "Changed, changed. CHANGED"), (3, "one"), (4, None), (None, passage), (5, ""), (6, corpus[3][1]), (7, "é Ü")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = judged(matches(documents(rows, extra=True), bench, scratch, window, block)).collect()
    got = sorted(((r.row.doc_id, r.n_words, r.n_hit, r.match["items"], r.contaminated) for r in found), key=repr)
    assert got == brute(rows, items, window)
    assert list(found[0].row.asDict()) == documents(rows, extra=True).columns


def test_longest_match(spark, documents, scratch):
    item = " ".join(f"w{i}" for i in range(40))
    text = "a b " + " ".join(f"w{i}" for i in range(5, 30)) + " c " + " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    (row,) = matches(documents([(1, text)]), bench, scratch).collect()
    assert (row.match.longest, row.match.longest_item, row.match.longest_at) == (25, 9, 2)
    assert [(h.begin, h.stop) for h in row.match.hits] == [(2, 27), (28, 48)]


@pytest.mark.parametrize("block", [1 << 24, 300])
def test_items_without_an_id_hit(spark, documents, scratch, block):
    words = [f"w{i}" for i in range(60)]
    items = [(None, " ".join(words[:20])), (None, " ".join(words[5:25])), (9, " ".join(words[30:45])), (1 << 60, " ".join(words[30:45])), (None, None)]
    rows = [(1, " ".join(words[:26])), (2, " ".join(words)), (3, " ".join(words[28:])), (4, "other words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = judged(matches(documents(rows), bench, scratch, block_bytes=block)).collect()
    got = {r.row.doc_id: (r.n_hit, r.match["items"], r.match.unnamed, r.contaminated) for r in found}
    assert got == {1: (25, [], True, True), 2: (40, [9, 1 << 60], True, True), 3: (15, [9, 1 << 60], False, True), 4: (0, [], False, False)}


def test_query_counts_items_without_an_id(spark, documents, tmp_path):
    import duckdb

    from ledgerprep.llm.q_decontaminate import ORACLES, op3_decontaminate

    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words[:26])), (2, " ".join(words)), (3, None), (4, "w30")]
    items = [(None, " ".join(words[:20])), (9, " ".join(words[30:45])), (None, " ".join(words[30:45])), (10, "w2 w3")]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, op3_decontaminate(spark, str(tmp_path)).collect()))
    with duckdb.connect() as db:
        for table in ("documents", "benchmark"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        assert got == sorted(db.execute(ORACLES["op3_decontaminate"]).fetchall())


def test_empty_tables(spark, documents, corpus, scratch):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in judged(matches(documents(corpus), bench, scratch)).collect()} == {0}
    assert judged(matches(documents([]), bench, scratch)).collect() == []


def brute_longest(text, items, window):
    """(length, item, place) of the longest match: of equal ones the first item, then the first place."""
    words, best = split(text), (0, None, 0)
    for item, content in items:
        w = split(content)
        n = min(window, len(w))
        for at in range(len(words)):
            for a in range(len(w) - n + 1 if n else 0):
                size = 0
                while at + size < len(words) and a + size < len(w) and words[at + size] == w[a + size]:
                    size += 1
                if size >= n and (-size, item, at) < (-best[0], best[1] if best[1] is not None else 1 << 60, best[2]):
                    best = (size, item, at)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_texts_of_few_words(seed):
    chance = random.Random(seed)

    def some(least, most, letters):
        return " ".join(chance.choice(letters) for _ in range(chance.randint(least, most)))

    window = chance.choice([2, 4, 13])
    letters = ["ab", "aab", "aaaaaaaaab"][seed % 3]
    rows = [(i, some(0, 60, letters)) for i in range(25)]
    items = sorted({(i // 2, some(0, 40, letters)) for i in range(12)} | {(7, rows[3][1]), (8, rows[3][1])})
    block = _block(pa.table({"item_id": [i for i, _ in items], "text": [t for _, t in items]}), window)
    words = words_of(pa.array([t for _, t in rows]), NO_ALNUM, lower=True)
    found = _find(words, block)
    for (i, n, hit, ids, _), (_, text) in zip(sorted(brute(rows, items, window)), rows, strict=True):
        edges, held, *longest = found.get(i, ([], set(), 0, None, 0))
        assert (sum(b - a for a, b in edges), sorted(held)) == (hit, ids)
        assert tuple(longest) == brute_longest(text, items, window)


def test_one_word_a_million_times():
    started = time.time()
    block = _block(pa.table({"item_id": [1, 2, 3], "text": ["0 " * 5000, "0 " * 4000, "0 0 0"]}), 13)
    found = _find(words_of(pa.array(["x " + "0 " * 1_000_000, "0 0"]), NO_ALNUM, lower=True), block)
    assert found == {0: ([[1, 1_000_001]], {1, 2, 3}, 5000, 1, 1)}
    assert time.time() - started < 60


def test_suffix_array_is_sorted():
    words = words_of(pa.array(["a b a b a", "b a", "", "a b a b"]), NO_ALNUM)
    order = suffix_array(words).tolist()
    stop = words.first[words.row + 1].tolist()
    suffixes = [words.hash[i : stop[i]].tolist() for i in order]
    assert suffixes == sorted(suffixes)
    assert sorted(order) == list(range(11))
