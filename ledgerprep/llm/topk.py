"""Operator 5, exact top-k search by tiled matrix products.

Vectors are turned into whole numbers, queries are dealt into blocks and candidates into shards,
both of bounded size, by a hash of the id. Each pair of a block and a shard is one task: it
multiplies the block by the shard in tiles and keeps the best of each tile. The lists of a query
are merged in a tree, ``FAN`` lists at a time, after one shuffle by query.

Cases: a vector that is null, empty or holds a null or non-finite component, or whose id is null,
takes no part; only vectors of the same length are compared; equal scores are ordered by vec_id;
rows with the vec_id of the query are its own and no candidates; a repeated query id gets a list
for each different vector; a score beyond 64 bits is held at the largest number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerprep.session import Scratch

SHARD = 8192
BLOCK = 4096
FAN = 8
TILE = 256
SCALE = 64
_EXACT = float(1 << 53)
_LARGEST = (1 << 63) - 1

PACKED = "vec_id long, vector_key long, dim int, wide boolean, vector binary"
LISTS = "query_id long, vector_key long, shard long, best array<struct<less: bigint, vec_id: bigint>>"


def whole_numbers(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """Vectors as floor(scale * x) of each component, packed as 16-bit numbers where they fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors, dims, wide = [], [], [], []
            lists = batch.column("embedding")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            begin = 0
            for i, end in zip(batch.column("vec_id").to_pylist(), ends.tolist(), strict=True):
                x = flat[begin:end]
                begin = end
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(scale * x)
                if i is None or not len(x) or not np.isfinite(x).all():
                    continue
                small = np.abs(x).max() < 32768
                ids.append(i)
                dims.append(len(x))
                wide.append(not small)
                vectors.append(x.astype(np.int16 if small else np.float64).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array([0] * len(ids), pa.int64()), pa.array(dims, pa.int32()),
                    pa.array(wide, pa.bool_()), pa.array(vectors, pa.binary()),
                ],
                names=["vec_id", "vector_key", "dim", "wide", "vector"],
            )

    picked = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return picked.mapInArrow(run, PACKED).withColumn("vector_key", F.xxhash64("vector"))


def top_k(vectors: DataFrame, is_query: Column, scratch: Scratch, k: int = 20, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best candidates of every query (all, if fewer)."""
    packed = scratch.keep(whole_numbers(vectors))
    rows, asked = packed.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    shards, blocks = max(1, -(-rows // shard)), max(1, -(-asked // block))
    key = F.xxhash64("vec_id", F.lit(5))
    queries = packed.filter(is_query).dropDuplicates(["vec_id", "vector_key"]).select(
        "dim", F.pmod(key, F.lit(blocks)).alias("block"), _each(shards).alias("shard"),
        "vec_id", "vector_key", "wide", "vector",
    )
    candidates = packed.select(
        "dim", _each(blocks).alias("block"), F.pmod(key, F.lit(shards)).alias("shard"),
        "vec_id", "vector_key", "wide", "vector",
    )
    # The stated queries meet all rows, a block of queries and a shard of rows at a time.
    keys = ["dim", "block", "shard"]
    lists = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(lambda q, c: _tile(q, c, k), LISTS)
    lists = lists.repartition("query_id", "vector_key")
    while True:
        lists = lists.groupBy("query_id", "vector_key", F.floor(F.col("shard") / FAN).alias("shard")).agg(
            F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best")
        )
        if shards <= FAN:
            break
        shards = -(-shards // FAN)
    return lists.select("query_id", F.posexplode("best").alias("place", "b")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), "b.vec_id", (-F.col("b.less")).alias("score")
    )


def _each(count: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))


def _matrix(table: pa.Table) -> np.ndarray:
    vectors, wide = table.column("vector").to_pylist(), table.column("wide").to_pylist()
    return np.stack([np.frombuffer(v, np.float64 if w else np.int16).astype(np.float64) for v, w in zip(vectors, wide, strict=True)])


def _tile(asked: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    schema = pa.schema(
        [
            ("query_id", pa.int64()), ("vector_key", pa.int64()), ("shard", pa.int64()),
            ("best", pa.list_(pa.struct([("less", pa.int64()), ("vec_id", pa.int64())]))),
        ]
    )
    if not asked.num_rows or not rows.num_rows:
        return schema.empty_table()
    rows = rows.sort_by("vec_id")
    ids, query_ids = rows.column("vec_id").to_numpy(), asked.column("vec_id").to_numpy()
    a, b = _matrix(asked), _matrix(rows)
    bound = np.abs(a).max() * np.abs(b).max() * a.shape[1]
    best: list[list[dict]] = []
    if bound * 2 * len(ids) < _EXACT:  # score and place in one exact number
        dtype = np.float32 if bound < (1 << 24) else np.float64
        b, place = b.astype(dtype).T, np.arange(len(ids), dtype=np.float64)
        for at in range(0, len(query_ids), TILE):
            order = (a[at : at + TILE].astype(dtype) @ b).astype(np.float64)
            order *= -len(ids)
            order += place
            first, stop = (np.searchsorted(ids, query_ids[at : at + TILE], side=s) for s in ("left", "right"))
            for i, (x, y) in enumerate(zip(first.tolist(), stop.tolist(), strict=True)):
                order[i, x:y] = np.inf
            if k < len(ids):
                order = np.partition(order, k - 1, axis=1)[:, :k]
            order.sort(axis=1)
            for line in order:
                keys = line[np.isfinite(line)].astype(np.int64)
                chosen = keys % len(ids)
                best.append(
                    [{"less": s, "vec_id": v} for s, v in zip((keys // len(ids)).tolist(), ids[chosen].tolist(), strict=True)]
                )
    else:
        whole = [[int(x) for x in line] for line in b]
        for query, own in zip(a, query_ids.tolist(), strict=True):
            q = [int(x) for x in query]
            scores = (sum(x * y for x, y in zip(q, line, strict=True)) for line in whole)
            pairs = sorted((max(-_LARGEST, min(_LARGEST, -s)), v) for s, v in zip(scores, ids.tolist(), strict=True) if v != own)
            best.append([{"less": s, "vec_id": v} for s, v in pairs[:k]])
    shard = np.full(len(query_ids), rows.column("shard")[0].as_py())
    return pa.table(
        [asked.column("vec_id"), asked.column("vector_key"), pa.array(shard), pa.array(best, schema.field("best").type)], schema=schema
    )
