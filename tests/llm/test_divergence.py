"""Operator 11: terms, skybands and tiles against plain counting."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from ledgerprep.llm import divergence
from ledgerprep.llm.q_divergence import ORACLES, op11_source_divergence, parts

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def expected(rows, min_docs=30, top=50):
    """Rows of (lang, source, text)."""
    groups, docs, of_lang = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source, found = lang or "", source or "", terms(text)
        groups[lang, source].update(found)
        of_lang[lang].update(found)
        docs[lang].update(set(found))
    out = set()
    for (lang, source), count in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def shares(c, kept=kept):
            whole = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // whole for t in kept}

        mine, all_ = shares(count), shares(of_lang[lang])
        pairs = [(-sum(abs(mine[t] - p) for t, p in shares(c).items()), s.encode(), s) for (la, s), c in groups.items() if la == lang and s != source]
        found = [(all_[t] - mine[t], t.encode(), t) for t in kept if count[t] and mine[t] > all_[t]]
        for part, values in (("pair", sorted(pairs)), ("term", sorted(found)[:top])):
            out |= {(lang, source, part, item, -value, rank) for rank, (value, _, item) in enumerate(values, 1)}
    return out


def table(rng, n, sources):
    pool = ["".join(rng.choices("abcé", k=rng.randint(1, 3))) for _ in range(160)] + ["Été", "x-y", "ß　z", "\U0001f600"]
    rows = []
    for _ in range(n):
        lang = rng.choice(["en", "en", "en", "de", None, "rare"])
        favourite = pool[hash(lang) % 7 : 60]
        words = rng.choices(pool, k=rng.randint(0, 40)) + rng.choices(favourite, k=rng.randint(0, 10))
        rows.append((lang, rng.choice(sources), " ".join(words).replace("a", rng.choice("aA")) if rng.random() < 0.95 else rng.choice([None, "", "1 2"])))
    return rows + [("alone", "one", "word"), ("none", "a", None), ("none", "b", None), ("en", "silent", "")]


def stored(spark, rows, folder):
    df = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr(
        "*", "1 AS term", "2 AS n", "3 AS v", "4 AS at", "'x' AS docs", "5 AS rank", "6 AS total"
    )
    df.repartition(5).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("seed, tile, bucket, held", [(1, 128, 10**6, 10**6), (2, 3, 40, 50), (3, 1, 500, 1)])
def test_against_plain_counting(spark, scratch, tmp_path, seed, tile, bucket, held):
    rows = table(random.Random(seed), 500, ["s1", "s2", "s10", "é", None, "S1", "z"])
    folder = stored(spark, rows, tmp_path / "sf")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = [tuple(r) for r in parts(divergence.Audit(docs, scratch, tile=tile, bucket_rows=bucket, held_rows=held)).collect()]
    want = expected(rows)
    assert len(got) == len(want) and set(got) == want
    if seed == 1:
        assert {tuple(r) for r in op11_source_divergence(spark, folder).collect()} == want
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        assert set(con.execute(ORACLES["op11_source_divergence"]).fetchall()) == want


def test_terms_of_texts():
    texts = ["One-two é3É x_y", None, "", "--", "ABC", "ÀB\x7fç　d", "end", "begin"]
    found, row = divergence.terms_of(pa.array(texts))
    assert [(r, t) for r, t in zip(row.tolist(), found.to_pylist(), strict=True)] == [(i, t) for i, x in enumerate(texts) for t in terms(x)]


@pytest.mark.parametrize("k", [1, 3, 50])
def test_skyband_is_what_fewer_than_k_dominate(spark, k):
    rng = random.Random(k)
    points = [("l", "s", f"t{i:05d}", rng.randint(1, 40), rng.randint(1, 60)) for i in range(1500)]
    df = spark.createDataFrame(points, divergence._BAND)
    got = {r.term for r in divergence.skyband(df.coalesce(1), k).collect()}
    want = {p[2] for p in points if sum(o[2] < p[2] and o[3] >= p[3] and o[4] <= p[4] for o in points) < k}
    assert got == want
    merged = divergence.skyband(divergence.skyband(df.repartition(7), k).coalesce(1), k)
    assert {r.term for r in merged.collect()} == want


def test_long_text_repeated_rows_and_empty_table(spark, scratch):
    rows = [("en", "a", "long " * 400_000)] * 2 + [("en", "b", "x" * 2_000_000)] + [("en", "b", "long short")] * 29
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    audit = divergence.Audit(df, scratch)
    got = {("pair", *r) for r in audit.pairs().collect()} | {("term", *r) for r in audit.top_terms().collect()}
    assert got == {(p, la, s, i, v, r) for la, s, p, i, v, r in expected(rows)}
    none = divergence.Audit(df.limit(0), scratch)
    assert none.pairs().collect() == [] and none.top_terms().collect() == []


def test_shares_beyond_64_bits(spark):
    df = spark.range(1).selectExpr("900000000000000 AS n", "1000000000000000 AS t", "7 AS v")
    share = df.select(divergence._share(df.n, df.t, df.v)).first()[0]
    assert share == 1 + 10**9 * (900000000000000 + 5) // (1000000000000000 + 35)
