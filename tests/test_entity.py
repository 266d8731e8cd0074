"""Matching and clustering, against literal cases and a plain loop on random names."""

import random
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerprep.functions import closeness
from ledgerprep.functions.similarity import similarity
from ledgerprep.functions.text import strip_legal_form
from ledgerprep.operators import entity
from ledgerprep.operators.components import components
from ledgerprep.session import Scratch, cut, drop_cuts


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def score_of(a, b, scorer):
    total = len(a) + len(b)
    if scorer == "levenshtein":
        return 100 * (total - edit_distance(a, b)) / total
    return 200 * lcs(a, b) / total


def groups(members):
    found = {}
    for r in members.orderBy("group_id", "rank_key").collect():
        found.setdefault(r["group_id"], []).append((r["row_id"], r["match_type"]))
    return found


def random_names(seed, n, stems=("CONSTRUCCIONES METALICAS ", "CON", "CONTRATAS Y OBRAS ", "TALLER ")):
    rng = random.Random(seed)
    names = []
    while len(names) < n:
        if names and rng.random() < 0.6:
            text = list(rng.choice(names))
            for _ in range(rng.randint(1, 5)):
                at = rng.randrange(len(text))
                what = rng.random()
                if what < 0.4:
                    text[at] = rng.choice("ABCDE")
                elif what < 0.7:
                    text.insert(at, rng.choice("ABCDE"))
                elif len(text) > 4:
                    del text[at]
            name = "".join(text)
        else:
            name = rng.choice(stems) + "".join(rng.choice("ABCDE") for _ in range(rng.randint(0, 12)))
        name = name.strip()
        if len(name) > 1:
            names.append(name)
    return names


def test_legal_forms(table):
    cases = {
        "BODEGAS TORRES S.A.": "BODEGAS TORRES", "FREIXENET, S.L.U.": "FREIXENET",
        "CODORNIU SA": "CODORNIU", "S.A. CONSTRUCTORA": "S.A. CONSTRUCTORA",
        "BODEGA LIMITADA S.L.": "BODEGA LIMITADA", "COMPAÑIA SOCIEDAD ANONIMA": "COMPAÑIA",
        "S.A.": "", "Viñas s. coop.": "VIÑAS",
    }
    got = table({"V": list(cases)}).select("V", strip_legal_form(F.col("V")).alias("C")).collect()
    assert {r["V"]: r["C"] for r in got} == cases


@pytest.mark.parametrize("scorer", ["indel", "levenshtein"])
def test_similarity(table, scorer):
    a = ["BODEGAS TORRES", "BODEGAS TORRES", "", "ABC", "X" * 70 + "ABC"]
    b = ["BODEGAS TORRES", "BODEGA TORRES", "SOMETHING", "XYZ", "X" * 70 + "ACB"]
    rows = table({"A": a, "B": b}).select(
        "A", "B", similarity(F.col("A"), F.col("B"), scorer).alias("S")
    ).collect()
    for r in rows:
        want = 0.0 if not r["A"] or not r["B"] else score_of(r["A"], r["B"], scorer)
        assert r["S"] == pytest.approx(want)


def test_groups_by_name(table):
    df = table({"N": ["BODEGAS TORRES S.A.", "BODEGA TORRES", "FREIXENET S.A.", "FREIXENET", "CODORNIU", "BODEGAS TORRES S.A."]})
    got = groups(entity.find_duplicates(df, "row_id", "N", threshold=75.0))
    assert got == {
        0: [(0, "primary"), (5, "primary"), (1, "fuzzy")],
        2: [(2, "primary"), (3, "fuzzy")],
    }


def test_groups_by_tax_id(table):
    df = table({
        "N": ["BODEGAS TORRES", "TORRES BODEGAS SL", "OTRO CLIENTE S.A.", "OTRO CLIENTE"],
        "T": ["A08000001", "A-08000001", "B28000002", "b28000002"],
    })
    got = groups(entity.find_duplicates(df, "row_id", "N", tax_id="T", threshold=75.0))
    assert got == {0: [(0, "primary"), (1, "tax_id")], 2: [(2, "primary"), (3, "tax_id")]}


def test_key_duplicates_follow_their_representative(table):
    """Row 2 has the key of row 1, whose name group is led by row 0; row 3 has no name."""
    df = table({
        "N": ["ACEROS DEL SUR", "ACEROS DEL SUR", "OTRO NOMBRE", None, "LEJANO"],
        "T": [None, "A11111111", "A11111111", "B22222222", "B22222222"],
    })
    got = groups(entity.find_duplicates(df, "row_id", "N", tax_id="T"))
    assert got == {
        0: [(0, "primary"), (1, "primary"), (2, "tax_id")],
        3: [(3, "primary"), (4, "tax_id")],
    }


def test_blocking_by_postal_code(table):
    df = table({"N": ["RAMON BILBAO S.A."] * 3, "P": ["26200", "28001", "26201"]})
    got = groups(
        entity.find_duplicates(df, "row_id", "N", postal="P", threshold=95.0, blocking="postal_code_2")
    )
    assert got == {0: [(0, "primary"), (2, "primary")]}


@pytest.mark.parametrize(
    "blocking, want",
    [
        ("none", ["_all_"] * 3), ("first_char", ["A", "A", "_empty_"]),
        ("first_3_chars", ["ACE", "AB", "_empty_"]), ("postal_code_2", ["08", "AB", "28"]),
        ("province", ["MADRID", "AB", "NAN"]), ("unheard of", ["ACE", "AB", "_empty_"]),
    ],
)
def test_block_keys(table, blocking, want):
    df = table({"N": ["Aceros", "ab", "S.A."], "P": ["8770", "-", "28001"], "R": [" madrid", "-", None]})
    rows = entity.matching_rows(df, "row_id", "N", postal="P", province="R", blocking=blocking)
    assert [r["block"] for r in rows.orderBy("row_id").collect()] == want


def expected_clusters(names, threshold, scorer, prefix):
    """The greedy rule, name by name."""
    leader = {}
    for i, a in enumerate(names):
        if i in leader:
            continue
        leader[i] = i
        for j in range(i + 1, len(names)):
            b = names[j]
            if j not in leader and a[:prefix] == b[:prefix]:
                if a == b or score_of(a, b, scorer) >= threshold:
                    leader[j] = i
    return leader


@pytest.mark.parametrize(
    "seed, threshold, scorer, blocking, prefix, limit",
    [
        (1, 85.0, "indel", "first_3_chars", 3, 1000), (2, 85.0, "indel", "first_3_chars", 3, 8),
        (3, 70.0, "indel", "none", 0, 16), (4, 92.5, "levenshtein", "first_char", 1, 8),
        (5, 75.0, "levenshtein", "none", 0, 16),
    ],
)
def test_clusters_equal_the_greedy_loop(table, seed, threshold, scorer, blocking, prefix, limit):
    """``limit`` 8 and 16 split blocks into components, some of which are larger than a task may hold."""
    names = list(dict.fromkeys(random_names(seed, 90)))
    df = table({"N": names})
    clean = [r[0] for r in df.orderBy("row_id").select(strip_legal_form(F.col("N"))).collect()]
    keyed = entity.exact_key_groups(entity.matching_rows(df, "row_id", "N", blocking=blocking))
    got = entity.leader_clusters(entity.collapse_names(keyed), threshold, scorer, limit).collect()
    want = expected_clusters(clean, threshold, scorer, prefix)
    assert {r["rep"]: r["leader"] for r in got} == want
    for r in got:
        a, b = clean[r["rep"]], clean[r["leader"]]
        assert r["score"] == pytest.approx(100 if a == b else score_of(a, b, scorer))


@pytest.mark.parametrize("scorer, threshold, part", [("indel", 85.0, 4096), ("indel", 62.0, 20), ("levenshtein", 80.0, 3), ("indel", 40.0, 64)])
def test_tiles_lose_no_pair(table, scorer, threshold, part):
    names = list(dict.fromkeys(random_names(11, 220)))
    df = table({"N": names})
    keyed = entity.exact_key_groups(entity.matching_rows(df, "row_id", "N"))
    pairs = entity.fuzzy_pairs(entity.collapse_names(keyed), threshold, scorer, part_names=part).collect()
    clean = {}
    for i, n in enumerate(r[0] for r in df.orderBy("row_id").select(strip_legal_form(F.col("N"))).collect()):
        clean.setdefault(n, i)
    items = sorted((i, n) for n, i in clean.items())
    want = {
        (i, j): score_of(a, b, scorer) for i, a in items for j, b in items
        if i < j and a[:3] == b[:3] and score_of(a, b, scorer) >= threshold
    }
    assert {(r["a"], r["b"]): r["score"] for r in pairs} == pytest.approx(want) and len(pairs) == len(want)


TEXTS = st.text(alphabet="AAABBCÉ 漢", min_size=1, max_size=20) | st.text(alphabet="ABC", min_size=60, max_size=70)


@given(st.lists(TEXTS, min_size=1, max_size=12, unique=True), st.sampled_from([40.0, 75.0, 85.0, 100.0]), st.sampled_from(["indel", "levenshtein"]))
@settings(max_examples=150, deadline=None)
def test_names_compared_in_a_task(texts, threshold, scorer):
    names, every = closeness.Names(texts, threshold, scorer), np.arange(len(texts))
    got = {(int(i), int(j)): s for part in names.pairs(every, every, True) for i, j, s in zip(*part, strict=True)}
    want = {(i, j): s for i in every.tolist() for j in range(i + 1, len(texts)) if (s := score_of(texts[i], texts[j], scorer)) >= threshold}
    assert got == pytest.approx(want)
    leader = expected_clusters(texts, threshold, scorer, 0)
    assert dict(enumerate(names.led()[0].tolist())) == leader

    def parts(pairs):
        root = list(range(len(texts)))
        for i, j in pairs:
            a, b = root[i], root[j]
            root = [min(a, b) if x in (a, b) else x for x in root]
        return root

    assert parts(zip(*names.forest(every, every), strict=True)) == parts(want)


def test_many_letters_need_no_tables(monkeypatch):
    monkeypatch.setattr(closeness, "SYMBOLS", 2)
    names = closeness.Names(["ABCDEF", "ABCDEG", "ZZZZ"], 80.0, "levenshtein")
    assert [x.tolist() for x in names.near(*names.candidates(np.arange(3), np.arange(3)))[:2]] == [[0, 0, 1, 1, 2], [0, 1, 0, 1, 2]]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)]
    root = {}
    for a, b in edges * len(edges):
        least = min(root.get(a, a), root.get(b, b))
        root[a] = root[b] = least
    scratch = Scratch(spark)
    got = components(spark.createDataFrame(edges, "a long, b long"), scratch)
    assert {r["node"]: r["root"] for r in got.collect()} == {n: r for n, r in root.items() if n != r}
    scratch.drop()


def test_copies_of_a_session_are_dropped(spark):
    kept = cut(spark.range(3))
    folder = Path(kept.inputFiles()[0].removeprefix("file://")).parent
    assert folder.exists()
    drop_cuts(spark)
    assert not folder.exists() and cut(spark.range(2)).count() == 2


def test_names_that_cannot_be_near_are_not_compared(table, monkeypatch):
    """At 100 only equal names are near, however many a block has; at 95 short ones have no near one but long ones do."""
    def compared(parted, *_):
        raise AssertionError(parted.collect())

    short = [f"ABC {i}" for i in range(40)]
    keyed = lambda names: entity.exact_key_groups(entity.matching_rows(table({"N": names}), "row_id", "N"))
    with monkeypatch.context() as patched:
        patched.setattr(entity, "links", compared)
        for threshold in (100.0, 95.0):
            got = entity.leader_clusters(entity.collapse_names(keyed([*short, *short])), threshold, part_names=4).collect()
            assert {r["rep"]: (r["leader"], r["rows"], r["score"]) for r in got} == {i: (i, 2, 100.0) for i in range(40)}
    long = ["ABC " + "X" * 40, "ABC " + "X" * 41]
    got = entity.leader_clusters(entity.collapse_names(keyed([*short, *long])), 95.0, part_names=4).collect()
    assert {r["rep"]: r["leader"] for r in got} == {i: min(i, 40) for i in range(42)}
