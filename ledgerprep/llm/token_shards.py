"""Operator 4, token ids in training order.

The tokens of all documents, each ended by ``end_id``, form one stream that is cut into sequences
of ``length`` tokens; only the last one is filled up with ``end_id``. A keyed Feistel permutation,
walked until it lands inside, gives sequence i its slot. Slots are dealt to shards of ``per_shard``
by range, and shard s is the file below ``shard=s`` with one record for each slot: ``length`` ids
of 16 bits, low byte first, and one line end. So slot n begins at byte
(n - s * per_shard) * (2 * length + 1) of its shard, and reading resumes at any slot.

Documents are tokenised once, into a table that keeps the order of the input's partitions. What
then moves is one compressed block of pieces for each task and shard.

Cases: a null text gives no tokens, an empty one only ``end_id``; repeated rows are written as
often as they come; no documents give no shards; texts are encoded as plain text, special tokens
in them included; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerprep.llm.words import mix, slices
from ledgerprep.session import Scratch

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the tokenizer of the vocabulary cuts a text before it merges bytes (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_ID = 50256
LENGTH = 1024
PER_SHARD = 16384
KEY = 2024
_ROUNDS = 6
_KNOWN_WORDS = 400_000
#: A blank beside other white space: there a text cannot be cut at single blanks.
_ODD = re.compile(r"\s | \s|^ | $")


class _Encoder:
    """Ids of a text as bytes; the ids of words that come again are kept, up to a bound."""

    def __init__(self, vocabulary: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.plain = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._first, self._after = _Words(self.whole, ""), _Words(self.whole, " ")

    def whole(self, text: str) -> bytes:
        ids = array("H", self.plain.encode_ordinary(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def clear(self) -> None:
        self._first.clear()
        self._after.clear()

    def encode(self, text: str) -> bytes:
        # The pattern always cuts before a single blank between other characters.
        if _ODD.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self._first[first] + b"".join(map(self._after.__getitem__, rest))


class _Words(dict):
    """Ids of words, each with ``before`` in front of it."""

    def __init__(self, whole: Callable[[str], bytes], before: str):
        self._whole, self._before = whole, before

    def __missing__(self, word: str) -> bytes:
        ids = self._whole(self._before + word)
        if len(word) <= 64:
            if len(self) >= _KNOWN_WORDS:
                self.clear()
            self[word] = ids
        return ids


@cache
def _encoder(vocabulary: bytes) -> _Encoder:
    return _Encoder(vocabulary)


def tokens(docs: DataFrame, vocabulary: bytes, end_id: int = END_ID) -> DataFrame:
    """doc_id, part, start, n and ids of every text; ``start`` counts the tokens before it in its partition."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    end = np.array([end_id], dtype="<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = _encoder(shared.value), TaskContext.get().partitionId(), 0
        for batch in (some for whole in batches for some in slices(whole, "text")):
            ids = [encoder.encode(text) + end for text in batch.column("text").to_pylist()]
            n = np.array([len(x) // 2 for x in ids], dtype=np.int64)
            at = start + np.cumsum(n) - n
            start += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(at), pa.array(n), pa.array(ids, pa.binary())],
                names=["doc_id", "part", "start", "n", "ids"],
            )
        encoder.clear()  # a worker that goes on to other work would keep the words for the session

    picked = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, part int, start long, n long, ids binary")


def slots(index: np.ndarray, count: int, key: int = KEY) -> np.ndarray:
    """Slots of sequence numbers: a permutation of 0 to ``count`` - 1 that ``key`` picks."""
    half = np.uint64(max(1, (max(1, count - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = mix(np.arange(1, _ROUNDS + 1, dtype=np.uint64) + np.uint64(key) * np.uint64(1 << 8))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        return (left << half) | right

    out = once(np.asarray(index, dtype=np.uint64))
    while True:  # numbers beyond the last slot walk on along their cycle
        beyond = np.flatnonzero(out >= np.uint64(count))
        if not len(beyond):
            return out.astype(np.int64)
        out[beyond] = once(out[beyond])


def _pieces(start: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parts of token runs by sequence: run, first token in the run, sequence, and size."""
    first, last = start // length, (start + n - 1) // length
    count = last - first + 1
    run = np.repeat(np.arange(len(n)), count)
    sequence = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.maximum(sequence * length, start[run])
    stop = np.minimum((sequence + 1) * length, (start + n)[run])
    return run, begin - start[run], sequence, stop - begin


def write_shards(
    docs: DataFrame, path: str, scratch: Scratch, vocabulary: str = VOCABULARY, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY
) -> DataFrame:
    """Write the shards below ``path``; returns the plan: slot, shard, byte and doc_ids of every sequence."""
    with open(vocabulary, "rb") as file:  # under a megabyte; tasks get it by broadcast
        content = file.read()
    table = scratch.keep(tokens(docs, content), "zstd")
    totals = table.groupBy("part").agg(F.max(F.col("start") + F.col("n")).alias("n")).orderBy("part").collect()  # one number a task
    base, total = {}, 0
    for row in totals:
        base[row["part"]] = total
        total += row["n"]
    count = -(-total // length)
    where = docs.sparkSession.sparkContext.broadcast(base)

    def global_start(batch: pa.RecordBatch) -> np.ndarray:
        part = batch.column("part").to_numpy()
        return batch.column("start").to_numpy() + np.array([where.value[p] for p in part.tolist()], dtype=np.int64)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3)
        for batch in batches:
            ids = [np.frombuffer(x, dtype="<u2") for x in batch.column("ids").to_pylist()]
            if not ids:
                continue
            run, begin, sequence, size = _pieces(global_start(batch), batch.column("n").to_numpy(), length)
            at = global_start(batch)[run] + begin - sequence * length
            slot = slots(sequence, count, key)
            order = np.lexsort((at, slot))
            shard = slot[order] // per_shard
            cuts = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard))
            columns: list[list] = [[], [], [], [], []]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                some = order[a:b]
                data = np.concatenate([ids[r][x : x + s] for r, x, s in zip(run[some].tolist(), begin[some].tolist(), size[some].tolist(), strict=True)])
                values = (int(shard[a]), slot[some].tobytes(), at[some].tobytes(), size[some].tobytes(), pack.compress(data.tobytes()))
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            kinds = [pa.int64(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["shard", "slot", "at", "size", "data"])

    def records(pieces: pa.Table) -> pa.Table:
        shard = pieces.column("shard")[0].as_py()
        first = shard * per_shard
        held = np.full((min(per_shard, count - first), length), END_ID, dtype="<u2")
        unpack = zstandard.ZstdDecompressor()
        for row in zip(*(pieces.column(c) for c in ("slot", "at", "size", "data")), strict=True):  # read in place, not copied
            slot, at, size, data = (x.as_buffer() for x in row)
            ids, done = np.frombuffer(unpack.decompress(data), dtype="<u2"), 0
            for s, a, n in zip(*(np.frombuffer(x, dtype=np.int64).tolist() for x in (slot, at, size)), strict=True):
                held[s - first, a : a + n] = ids[done : done + n]
                done += n
        offsets = np.arange(len(held) + 1, dtype=np.int32) * (2 * length)
        value = pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer(offsets), pa.py_buffer(held)])
        return pa.table([pa.array(np.full(len(held), shard)), pa.array(np.arange(len(held)) + first), value], names=["shard", "slot", "value"])

    moved = table.select("part", "start", "n", "ids").mapInArrow(blocks, "shard long, slot binary, at binary, size binary, data binary")
    rows = moved.groupBy("shard").applyInArrow(records, "shard long, slot long, value binary")
    (
        rows.sortWithinPartitions("shard", "slot")
        .select("shard", F.col("value").cast("string").alias("value"))
        .write.partitionBy("shard").option("compression", "none").text(path)
    )

    def owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            run, begin, sequence, _ = _pieces(global_start(batch), batch.column("n").to_numpy(), length)
            at = global_start(batch)[run] + begin - sequence * length
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots(sequence, count, key)), pa.array(at), batch.column("doc_id").take(pa.array(run))], names=["slot", "at", "doc_id"]
            )

    kind = table.schema["doc_id"].dataType.simpleString()
    plan = table.select("part", "start", "n", "doc_id").mapInArrow(owners, f"slot long, at long, doc_id {kind}")
    return plan.groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("at", "doc_id"))).alias("docs")).select(
        "slot", F.floor(F.col("slot") / per_shard).alias("shard"),
        (F.col("slot") % per_shard * (2 * length + 1)).alias("byte"), F.col("docs.doc_id").alias("doc_ids"),
    )


def read_shards(spark: SparkSession, path: str, length: int = LENGTH, per_shard: int = PER_SHARD, start: int = 0) -> DataFrame:
    """slot and ids (16-bit numbers, low byte first) of the sequences from slot ``start`` on.

    Folders of shards before that slot are not opened; an empty folder has no sequences."""

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    if "shard" not in files.columns:
        return spark.createDataFrame([], "slot long, ids binary")
    # A file is cut where it is read: as one cell it would be copied to Arrow and again to a Python worker.
    stride = 2 * length + 1
    first, size = F.col("shard").cast("long") * per_shard, F.octet_length("content")
    torn = F.concat(F.lit("not whole records in shard "), F.col("shard"))
    shards = files.filter(F.col("shard") >= start // per_shard).select(
        first.alias("first"), F.greatest(F.lit(0).cast("long"), start - first).alias("skip"),
        F.when(size % stride == 0, F.floor(size / stride)).otherwise(F.raise_error(torn)).alias("n"), "content",
    )
    each = shards.filter("skip < n").select("first", F.explode(F.expr("sequence(skip, n - 1)")).alias("at"), "content")
    ids = F.substring("content", (F.col("at") * stride + 1).cast("int"), F.lit(2 * length))
    return each.select((F.col("first") + F.col("at")).alias("slot"), ids.alias("ids"))
