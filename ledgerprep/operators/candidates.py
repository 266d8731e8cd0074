"""Near pairs of names within a block, by tiles of bounded size.

The names of a block are dealt into parts of about ``PART_NAMES``, and a task compares two parts: it
holds no more than that, however large the block, and a block that holds much of the table is worked
on by many tasks. Most blocks are one part and one tile. Names of a tile are compared as
``functions.closeness`` does: bags of letters in one matrix product, then bit vectors for what is left.
So no pair is made but those that reach the threshold, and each is scored once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerprep.functions.closeness import Names

PART_NAMES = 4096


def with_parts(vertices: DataFrame, part_names: int = PART_NAMES) -> DataFrame:
    """The rows (block, vid, name) with the number of ``parts`` of their block, and the ``part`` they are in."""
    blocks = vertices.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / part_names).cast("int").alias("parts"))
    return vertices.join(blocks, "block").withColumn("part", F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int"))


def _tiles(parted: DataFrame, compare: Callable[[tuple, pa.Table], pa.Table], schema: str) -> DataFrame:
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = parted.select("block", "part", "vid", "name", other.alias("other"))
    tiles = dealt.groupBy("block", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"))
    return tiles.applyInArrow(lambda key, rows: compare(key, rows), schema)


def _sides(key: tuple, rows: pa.Table) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """vids and names of a tile in order, and the rows of its one part twice or of its two."""
    rows = rows.sort_by("vid")
    part, (_, a, b) = rows.column("part").to_numpy(), key
    return rows.column("vid").to_numpy(), rows.column("name").to_pylist(), *(np.flatnonzero(part == x.as_py()) for x in (a, b))


def near_pairs(parted: DataFrame, threshold: float, scorer: str) -> DataFrame:
    """All pairs a, b (a < b) of one block that reach the threshold, with their score."""

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        vid, texts, left, right = _sides(key, rows)
        found = list(Names(texts, threshold, scorer).pairs(left, right, key[1] == key[2]))
        if not found:
            return pa.table({"a": vid[:0], "b": vid[:0], "score": np.zeros(0)})
        i, j, score = (np.concatenate(c) for c in zip(*found, strict=True))
        a, b = vid[i], vid[j]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "score": score})

    return _tiles(parted, compare, "a long, b long, score double")


def links(parted: DataFrame, threshold: float, scorer: str) -> DataFrame:
    """Of the near pairs a, b of each block enough to connect all that they connect: fewer than a tile has names."""

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        vid, texts, left, right = _sides(key, rows)
        i, j = Names(texts, threshold, scorer).forest(left, right)
        return pa.table({"a": vid[np.array(i, dtype=np.int64)], "b": vid[np.array(j, dtype=np.int64)]})

    return _tiles(parted, compare, "a long, b long")
