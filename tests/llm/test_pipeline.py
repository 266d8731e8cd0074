"""The corpus pipeline: every stage against brute force on a small corpus, and the whole run."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from ledgerprep.llm import token_shards

GIVEN = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text, pattern=WORD):
    return pattern.findall((text or "").encode().translate(LOWER))


def first_of_each(rows):
    """Rows that stay when links of five-word shingles at 0.8 leave the smallest doc_id."""
    sets = []
    for r in rows:
        w = words(r.text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for r, g in zip(rows, group, strict=True):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    return [r for r, g in zip(rows, group, strict=True) if r.doc_id == least[g]]


def clean(rows, items):
    """Rows of which less than a twentieth of the words lies in a benchmark window."""
    windows = defaultdict(set)
    for item in items:
        w = words(item.text, ALNUM)
        n = min(13, len(w))
        windows[n] |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    out = []
    for r in rows:
        w, hit = words(r.text, ALNUM), set()
        for n, known in windows.items():
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i : i + n]) in known:
                    hit.update(range(i, i + n))
        if not hit or 20 * len(hit) < len(w):
            out.append(r)
    return out


def mix_targets(rows):
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(words(r.text))
    order = sorted((s for s in sizes if s is not None), key=str.encode) + [None] * (None in sizes)
    weight, capped = {s: n % 3 + 1 for n, s in enumerate(order)}, {}
    while True:
        free = [s for s in order if s not in capped]
        share = (sum(sizes.values()) - sum(capped.values())) / sum(weight[s] for s in free) if free else 0
        above = {s: 3 * sizes[s] for s in free if share * weight[s] > 3 * sizes[s]}
        if not above:
            return capped | {s: share * weight[s] for s in free}
        capped |= above


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    docs = spark.read.parquet(f"{GIVEN}/documents.parquet")
    items = spark.read.parquet(f"{GIVEN}/benchmark.parquet")
    rows = docs.collect()
    known = next(i.text for i in items.collect() if len(words(i.text, ALNUM)) >= 13)
    base = max(r.doc_id for r in rows)
    texts = [None, "", "123 456", rows[0].text, f"{rows[1].text} end", known]
    more = [{**rows[0].asDict(), "doc_id": base + 1 + n, "text": t} for n, t in enumerate(texts)]
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(f"{path}/documents.parquet")
    items.write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_and_run(spark, scratch, folder):
    given = spark.read.parquet(f"{folder}/documents.parquet")
    docs, steps = given, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, folder))
        steps[name] = docs.collect()
    rows, told, one, kept, mixed = given.collect(), *(steps[name] for name, _ in corpus_pipeline.STAGES[:-1])

    assert not Counter(told) - Counter(rows)
    assert not [r for r in told if not re.search(r"[^\W\d_]", r.text or "")]
    assert len(told) >= 0.9 * sum(1 for r in rows if len(words(r.text)) >= 20)

    expected = first_of_each(told)
    assert len(expected) < len(told) and Counter(one) == Counter(expected)

    items = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    expected = clean(one, items)
    assert len(expected) < len(one) and Counter(kept) == Counter(expected)

    wanted, taken, largest = mix_targets(kept), Counter(), Counter()
    assert not set(mixed) - set(kept) and max(Counter(mixed).values()) <= 3
    for r in mixed:
        taken[r.source] += len(words(r.text))
    for r in kept:
        largest[r.source] = max(largest[r.source], len(words(r.text)))
    for source, target in wanted.items():
        assert abs(taken[source] - target) <= largest[source] + 1e-6

    with open(token_shards.VOCABULARY, "rb") as file:
        encoder = token_shards._encoder(file.read())
    length = sum(len(encoder.encode(r.text)) // 2 + 1 for r in mixed)  # two bytes a token, and an end
    for found in (steps["token_output"], corpus_pipeline.run(spark, folder).collect()):
        assert sorted(r.slot for r in found) == list(range(-(-length // token_shards.LENGTH)))
        assert all(re.fullmatch("[0-9a-f]{64}", r.ids_sha256) for r in found)
    assert Counter(r.ids_sha256 for r in found) == Counter(r.ids_sha256 for r in steps["token_output"])
