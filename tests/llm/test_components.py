"""Connected components: the smallest node of each against a plain search, and how much the driver does for them."""

import random

import pytest

from ledgerprep.operators import components as module
from ledgerprep.operators.components import components

EDGE = "a long, b long"


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root if find(x) != x}


def graphs():
    rng = random.Random(4)
    path = list(range(-60, 60))
    rng.shuffle(path)
    return {
        "path": list(zip(path, path[1:])),
        "star": [(i, 500) for i in range(300)],
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] * 2,
        "odd": [(1, 1), (None, 2), (3, None), (7, 6), (6, 7), (-(2**63), 2**63 - 1)],
        "none": [],
    }


@pytest.fixture
def parted(spark):
    """Partitions of a shuffle are left as many as they are, so that edges of one component lie in several tasks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("name", graphs())
@pytest.mark.parametrize("at_once", [1, 1 << 19])
def test_roots_across_tasks(spark, scratch, parted, monkeypatch, name, at_once):
    monkeypatch.setattr(module, "EDGES", at_once)
    edges = graphs()[name]
    rows = components(spark.createDataFrame(edges, EDGE).repartition(8), scratch).collect()
    found = {r.node: r.root for r in rows}
    assert found == plain(edges) and len(rows) == len(found)


def test_edges_of_one_task_take_no_round(spark, scratch):
    """The driver plans and keeps a table, shuffles and threads for each round, and once more for each broadcast."""
    edges = spark.createDataFrame(graphs()["path"] + graphs()["random"], EDGE)
    spark.sparkContext.setJobGroup("components", "components")
    try:
        found = components(edges, scratch)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert scratch._count == 1
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components")) <= 6
    assert found.count() > 0


def test_rounds_broadcast_nothing(spark, scratch, parted, monkeypatch):
    """A table that Spark broadcasts comes to the driver first."""
    plans, keep = [], scratch.keep

    def kept(df, *more):
        df.collect()  # so that the plan is the one that ran
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, *more)

    monkeypatch.setattr(scratch, "keep", kept)
    components(spark.createDataFrame(graphs()["path"], EDGE).repartition(8), scratch)
    assert len(plans) > 1
    assert not [p for p in plans if "Broadcast" in p]
