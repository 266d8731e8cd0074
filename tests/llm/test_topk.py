"""Operator 5 against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerprep.llm.topk import top_k


def brute(rows, k):
    whole = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [math.floor(64 * x) for x in v]))
    out = []
    for i, q in {(i, tuple(q)) for i, q in whole if i % 20 == 0}:
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), j) for j, v in whole if j != i and len(v) == len(q))
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard,block", [(8192, 4096), (7, 2)])
def test_top_k(spark, scratch, shard, block):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, 0.25, 1 / 3, 0.0]) for _ in range(6)]) for i in range(150)]
    rows += [(i, [0.5] * 6) for i in range(150, 170)]
    rows += [(200, None), (220, []), (240, [1.0, None, 2.0, 1.0, 1.0, 1.0]), (260, [float("nan")] * 6), (280, [float("inf")] * 6)]
    rows += [(None, [1.0] * 6), (300, [1.0, 2.0]), (301, [3.0, 4.0]), (302, [600.0, -700.0]), (320, [1.0] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("vector", F.lit(1)).withColumn("shard", F.lit(None))
    got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 20 == 0, scratch, 20, shard, block).collect())
    assert got == brute(rows, 20)


def test_large_components_and_repeated_ids(spark, scratch):
    rows = [(0, [1e9, 1e9]), (1, [3e9, -2e9]), (2, [1e15, 1e15]), (20, [1.0, 1.0]), (20, [1.0, 1.0]), (3, [0.1, 0.2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = top_k(df, F.col("vec_id") % 20 == 0, scratch, 3).select("query_id", "vec_id", "score").collect()
    by_query = {}
    for q, v, s in map(tuple, found):
        by_query.setdefault(q, []).append((v, s))
    assert by_query[0][:2] == [(1, 2**63 - 1), (2, 2**63 - 1)]  # held at the largest number, so a tie
    assert all(v != 20 for v, _ in by_query[20]) and (1, 64 * 64 * 10**9) in by_query[20]


def test_empty_table(spark, scratch):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(df, F.col("vec_id") % 20 == 0, scratch).collect() == []
