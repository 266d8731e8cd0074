"""Shared minimiser positions ("anchors") of repeated word windows.

A window is ``window`` consecutive words of one text. Its minimiser is the ``seed``-word run
inside it with the smallest hash (the leftmost of equal ones), so equal windows have equal
minimisers at the same place. Consecutive windows with one minimiser form a super-k-mer, which
is a stretch of words and is named by its first window, its number of windows and its anchor.

A window can repeat in another document only if its anchor does. The first pass therefore moves
a few numbers for each anchor, and only stretches around anchors of two documents follow, with
their words. All stretches of an anchor meet in a bucket. An anchor that occurs more than
``bucket`` times has several buckets; each settles the windows that repeat inside it, and hands on
the rest, packed and dealt by the hash of the window, to a second round. So no task gets more
than about ``bucket`` stretches of an anchor, and no row is made for a single window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerprep.llm.words import BLANK, Words, mix, run_hash, signed, slices, words_of
from ledgerprep.session import Scratch

WINDOW = 50
SEED = 12
BUCKET = 4096

ANCHORS = "doc_id long, text_key long, anchor long, place long"
STRETCHES = "doc_id long, text_key long, bucket long, anchor long, chunks int, place long, packed binary"
FOUND = "doc_id long, text_key long, begin int, stop int, copy boolean, bucket long, rest binary"
_FOUND = pa.schema(
    [
        ("doc_id", pa.int64()), ("text_key", pa.int64()), ("begin", pa.int32()), ("stop", pa.int32()),
        ("copy", pa.bool_()), ("bucket", pa.int64()), ("rest", pa.binary()),
    ]
)
_BITS = 12
_LOW = (1 << _BITS) - 1


class Windows(NamedTuple):
    """Every window of some stretches: its stretch, its number there, its hash and its group (equal windows)."""

    stretch: np.ndarray
    number: np.ndarray
    hash: np.ndarray
    group: np.ndarray


def stretches_of(words: Words, window: int, seed: int) -> dict[str, np.ndarray]:
    """Super-k-mers of all texts: row, anchor, and at, first and windows as word numbers of the text."""
    span = window - seed + 1
    value = run_hash(words.hash, seed)
    n = len(value) - span + 1
    if n <= 0:
        empty = np.zeros(0, dtype=np.int64)
        return dict.fromkeys(("row", "at", "first", "windows"), empty) | {"anchor": empty.astype(np.uint64)}
    place = np.arange(len(value))
    size = 1
    while size * 2 <= span:
        value, place = _leftmost(value[:-size], place[:-size], value[size:], place[size:])
        size *= 2
    if span > size:
        gap = span - size
        value, place = _leftmost(value[:-gap], place[:-gap], value[gap:], place[gap:])
    row = words.row[:n]
    whole = np.arange(n) + window <= words.first[row + 1]
    begins = np.ones(n, dtype=bool)
    begins[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | ~whole[:-1]
    begin = np.flatnonzero(begins & whole)
    number = np.cumsum(begins & whole) - 1
    windows = np.bincount(number[whole], minlength=len(begin))
    row, base = row[begin], words.first[row[begin]]
    return {"row": row, "anchor": value[begin], "at": place[begin] - base, "first": begin - base, "windows": windows}


def _leftmost(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    left = a <= b
    return np.where(left, a, b), np.where(left, at_a, at_b)


def opened(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, anchor's distance from it, and number of windows."""
    return place >> 2 * _BITS, (place >> _BITS) & _LOW, place & _LOW


def keyed(docs: DataFrame) -> DataFrame:
    """The columns used here. Rows with the same id and text are one; a null id takes no part."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text")
    )


def owned(texts: DataFrame) -> DataFrame:
    """owner, text_key, body: the same columns for all joins with the texts. The names differ from
    those of the input, so that plans agree on them and Spark moves the texts once for all joins."""
    return texts.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("owner"), "text_key", F.col("text").alias("body"))


def anchors(texts: DataFrame, window: int, seed: int) -> DataFrame:
    """Every super-k-mer of ``keyed`` documents, without its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = stretches_of(words_of(part.column("text"), BLANK), window, seed)
                ids = part.select(["doc_id", "text_key"]).take(pa.array(found["row"]))
                place = found["first"] << 2 * _BITS | (found["at"] - found["first"]) << _BITS | found["windows"]
                yield pa.RecordBatch.from_arrays(
                    [*ids.columns, pa.array(signed(found["anchor"])), pa.array(place)], names=["doc_id", "text_key", "anchor", "place"]
                )

    return texts.filter("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, ANCHORS)


def shared_places(texts: DataFrame, scratch: Scratch, window: int, seed: int, bucket: int) -> DataFrame:
    """Places of the stretches whose anchor occurs in several documents, by text (doc_id, text_key, places)."""
    every = scratch.keep(anchors(texts, window, seed), "zstd")
    counted = every.groupBy("anchor").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("times")
    )
    shared = counted.filter("least < most").select("anchor", F.ceil(F.col("times") / bucket).cast("int").alias("chunks"))
    return (
        every.join(scratch.keep(shared), "anchor")
        .groupBy("doc_id", "text_key")
        # Repeated rows with the same id and text give equal places; a text bounds the number.
        .agg(F.array_sort(F.collect_set(F.struct("place", "anchor", "chunks"))).alias("places"))
    )


def packed(texts: DataFrame, window: int) -> DataFrame:
    """Stretches of ``texts`` (owner, text_key, body, places) with their words in one string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body"):
                words = words_of(part.column("body"), BLANK)
                places = part.column("places")
                flat = places.flatten()
                row = np.repeat(np.arange(part.num_rows), places.value_lengths().to_numpy(zero_copy_only=False))
                place, anchor, chunks = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("place", "anchor", "chunks"))
                first, _, windows = opened(place)
                begin = words.first[row] + first
                data = words.data.tobytes()
                lo, hi = words.start[begin], words.end[begin + windows + window - 2]
                strings = [data[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                ids = part.select(["owner", "text_key"]).take(pa.array(row))
                own = mix(ids.column("owner").to_numpy().view(np.uint64) ^ mix(place.view(np.uint64)))
                bucket = mix(anchor.view(np.uint64) ^ mix(own % chunks.astype(np.uint64) + np.uint64(1)))
                yield pa.RecordBatch.from_arrays(
                    [
                        *ids.columns, pa.array(signed(bucket)), pa.array(anchor), pa.array(chunks), pa.array(place),
                        pa.array(strings, type=pa.binary()),
                    ],
                    names=["doc_id", "text_key", "bucket", "anchor", "chunks", "place", "packed"],
                )

    return texts.mapInArrow(run, STRETCHES)


def _by_bucket(rows: DataFrame, judge: Callable[[pa.Table], pa.RecordBatch]) -> DataFrame:
    """``judge`` gets all rows of a bucket together, many buckets at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column("bucket").to_numpy()
            turns = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            if held and held[-1].column("bucket")[-1].as_py() != bucket[0]:
                turns = np.append(0, turns)
            if len(turns):  # all before the last turn is whole
                yield judge(pa.Table.from_batches([*held, batch.slice(0, int(turns[-1]))]))
                held = [batch.slice(int(turns[-1]))]
            else:
                held.append(batch)
        if held:
            yield judge(pa.Table.from_batches(held))

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, FOUND)


def words_packed(table: pa.Table) -> Words:
    return words_of(table.column("packed").combine_chunks().cast(pa.large_binary()).view(pa.large_string()), BLANK)


def windows_of(table: pa.Table, words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window: its stretch, its number there, and its hash."""
    _, _, windows = opened(table.column("place").to_numpy())
    stretch = np.repeat(np.arange(len(windows)), windows)
    number = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    hashed = run_hash(words.hash, window)
    return stretch, number, hashed[words.first[stretch] + number] if len(stretch) else hashed


def repeats(
    texts: DataFrame, places: DataFrame, window: int, windows: Callable[[pa.Table], Windows]
) -> DataFrame:
    """Word spans (doc_id, text_key, begin, stop, copy) of windows that several documents of ``owned`` texts hold.

    ``copy`` tells that a smaller doc_id holds the window too; the others are the first.
    ``windows`` finds the equal windows of the stretches of a bucket."""

    def first_round(table: pa.Table) -> pa.RecordBatch:
        found = windows(table)
        doc, key = (table.column(c).to_numpy()[found.stretch] for c in ("doc_id", "text_key"))
        first, _, _ = opened(table.column("place").to_numpy())
        chunks, anchor = (table.column(c).to_numpy()[found.stretch] for c in ("chunks", "anchor"))
        return _judged(doc, key, first[found.stretch] + found.number, found.hash, found.group, chunks, anchor, None)

    def second_round(table: pa.Table) -> pa.RecordBatch:
        waits = pc.is_valid(table.column("rest"))
        settled = table.filter(pc.invert(waits)).cast(_FOUND).combine_chunks()
        rest = [np.frombuffer(b, dtype=np.int64).reshape(-1, 5) for b in table.column("rest").filter(waits).to_pylist()]
        if not rest:
            return settled.to_batches()[0]
        doc, key, begin, hashed, shared = np.concatenate(rest).T
        group = np.unique(hashed, return_inverse=True)[1]
        more = _judged(doc, key, begin, hashed.view(np.uint64), group, np.ones(len(doc), dtype=np.int64), doc, shared.astype(bool))
        return pa.Table.from_batches([*settled.to_batches(), more.cast(_FOUND)]).combine_chunks().to_batches()[0]

    def _judged(doc, key, begin, hashed, group, chunks, anchor, known) -> pa.RecordBatch:  # noqa: ANN001
        order = np.lexsort((doc, group))
        new = np.ones(len(order), dtype=bool)
        new[1:] = group[order[1:]] != group[order[:-1]]
        opens = np.flatnonzero(new)
        closes = np.append(opens[1:], len(order)) - 1 if len(order) else opens
        which = np.cumsum(new) - 1
        least, most = doc[order[opens]][which], doc[order[closes]][which]
        copy, shared = np.empty(len(order), dtype=bool), np.empty(len(order), dtype=bool)
        copy[order], shared[order] = doc[order] > least, least < most
        if known is not None:
            shared |= known
        later = ~copy & (chunks > 1)  # another bucket may hold the window too
        lines, blobs, homes = np.flatnonzero(shared & ~later), [], []
        if later.any():
            at = np.flatnonzero(later)
            home = mix(anchor[at].view(np.uint64) ^ mix(hashed[at] % chunks[at].astype(np.uint64)))
            sorted_ = np.argsort(home, kind="stable")
            at, home = at[sorted_], home[sorted_]
            rest = np.stack([doc[at], key[at], begin[at], hashed[at].view(np.int64), shared[at].astype(np.int64)], axis=1)
            cuts = np.append(np.flatnonzero(np.append(True, home[1:] != home[:-1])), len(home))
            blobs = [rest[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            homes = home[cuts[:-1]].view(np.int64).tolist()
        lines = lines[np.lexsort((begin[lines], copy[lines], key[lines], doc[lines]))]
        a, b = lines[1:], lines[:-1]
        starts = np.ones(len(lines), dtype=bool)
        starts[1:] = (doc[a] != doc[b]) | (key[a] != key[b]) | (copy[a] != copy[b]) | (begin[a] > begin[b] + window)
        opens = np.flatnonzero(starts)
        closes = np.append(opens[1:], len(lines)) - 1 if len(lines) else opens
        head, tail, none = lines[opens], lines[closes], [None] * len(blobs)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*doc[head].tolist(), *none], pa.int64()), pa.array([*key[head].tolist(), *none], pa.int64()),
                pa.array([*begin[head].tolist(), *none], pa.int32()), pa.array([*(begin[tail] + window).tolist(), *none], pa.int32()),
                pa.array([*copy[head].tolist(), *none], pa.bool_()), pa.array([None] * len(head) + homes, pa.int64()),
                pa.array([None] * len(head) + blobs, pa.binary()),
            ],
            names=["doc_id", "text_key", "begin", "stop", "copy", "bucket", "rest"],
        )

    around = texts.join(places.withColumnRenamed("doc_id", "owner"), ["owner", "text_key"])
    first = _by_bucket(packed(around, window), first_round)
    # Settled spans pass the second round unchanged, so that one plan moves the texts once.
    second = _by_bucket(first.withColumn("bucket", F.coalesce("bucket", F.xxhash64("doc_id", "begin"))), second_round)
    return second.select("doc_id", "text_key", "begin", "stop", "copy")
