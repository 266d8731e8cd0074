"""Operator 7: targets against brute force, and what pivotal rounding promises."""

import random
import re
from collections import Counter, defaultdict

import pytest

from ledgerprep.llm import mixing
from ledgerprep.llm.mixing import copies_of_sized

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def size(text):
    return len(WORD.findall((text or "").encode()))


def targets(sizes):
    """By source, from sizes by source: shares by weight, capped at three times the source."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: n % 3 + 1 for n, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        share = (total - sum(capped.values())) / sum(weight[s] for s in free) if free else 0
        above = {s: 3.0 * sizes[s] for s in free if share * weight[s] > 3 * sizes[s]}
        if not above:
            return capped | {s: share * weight[s] for s in free}
        capped |= above


def sized(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, size long")


@pytest.mark.parametrize("block", [256, 4])
def test_targets_and_copies(spark, scratch, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "b", "b", "B", "é", "z", None]), rng.choice([0, 1, 5, 40, 300])) for i in range(700)]
    rows += [(1000, "tiny", 2), (None, "b", 30), (2000, "empty", 0)]
    found = copies_of_sized(sized(spark, rows), scratch).collect()
    sizes, largest, taken = Counter(), defaultdict(int), Counter()
    by_key = {(r.doc_id, r.source): r for r in found}
    for i, s, n in rows:
        sizes[s] += n
        largest[s] = max(largest[s], n)
        taken[s] += n * by_key[i, s].copies
    wanted, empty = targets(sizes), {(i, s) for i, s, n in rows if not n}
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(wanted[r.source], rel=1e-9)
        share = r.target / r.source_size if r.source_size else 0
        if (r.doc_id, r.source) not in empty:
            assert share - 1 - 1e-9 < r.copies < share + 1 + 1e-9 and 0 <= r.copies <= 3
        else:
            assert r.copies == 0
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= largest[s] + 1e-6
    again = copies_of_sized(sized(spark, rows).repartition(5), scratch).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_every_document_has_its_chance(spark, scratch):
    rows = [(i, "abc"[i % 3], 10) for i in range(30)]
    counts = Counter()
    for seed in range(12):
        for r in copies_of_sized(sized(spark, rows), scratch, seed).collect():
            counts[r.doc_id] += r.copies
    means = [sum(counts[i] for i in range(s, 30, 3)) / 10 / 12 for s in range(3)]
    assert means == pytest.approx([0.5, 1.0, 1.5])
    assert len({counts[i] for i in range(0, 30, 3)}) > 1


def test_rows_of_the_mix(documents, corpus, scratch):
    docs = documents(corpus, extra=True)
    out = mixing.mixed(docs, scratch).collect()
    copies = {(r.doc_id, r.source): r.copies for r in mixing.copies(docs, scratch).collect()}
    wanted = Counter()
    for r in docs.collect():
        wanted[r] += copies[r.doc_id, r.source]
    assert Counter(out) == +wanted
    assert not [r for r in out if size(r.text) == 0]


def test_no_words(documents, scratch):
    assert mixing.copies(documents([]), scratch).collect() == []
    assert [r.copies for r in mixing.copies(documents([(1, None), (2, "")]), scratch).collect()] == [0, 0]
