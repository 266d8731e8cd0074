"""Operator 3, benchmark decontamination by suffix arrays of the training texts.

Each task makes suffix arrays of shards of its documents: the suffixes of all words, sorted to a
depth of 16 words by doubling ranks. Every benchmark suffix that starts a window is binary-searched
in each shard, equal windows once; the range it finds holds all places of that window. Hit words of
both sides are ranked together, which gives the longest match and its place without trying pairs. Documents are not moved between tasks.

A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one
window. The benchmark is read in blocks of at most about ``block_bytes`` of text, each broadcast
once its size is known; with several blocks the documents are written and passed again.

Cases: a null or empty text has no words and no hits; an item with a null id hits words and
can be the longest match, but is not named (``unnamed`` says that one occurs); items with one id count once; every row of the documents gets a result of its own, also repeated ones,
and keeps all its columns whatever their names; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerprep.llm.words import NO_ALNUM, Words, slices, words_of
from ledgerprep.session import Scratch

WINDOW = 13
DEPTH = 16
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 16 << 20

MATCH = (
    "struct<n_words: bigint, hits: array<struct<begin: int, stop: int>>, items: array<bigint>,"
    " unnamed: boolean, longest: int, longest_item: bigint, longest_at: int>"
)


class Block(NamedTuple):
    """Windows of some items. Equal windows are one ``kind``, searched once however often it occurs."""

    words: np.ndarray
    ends: np.ndarray  # of the items in ``words``
    start: np.ndarray  # of each window
    kind: np.ndarray
    item: np.ndarray  # a place in ``ids``
    ids: list[int | None]
    first: np.ndarray  # a window of each kind
    need: np.ndarray  # words of each kind
    group: np.ndarray  # of each kind: a place in ``groups``
    groups: list[np.ndarray]  # sorted items that share a kind
    window: int


def matches(docs: DataFrame, items: DataFrame, scratch: Scratch, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``row`` (all columns of the document) and ``match``: n_words, hits (merged spans of hit words),
    items (ids with an occurring window), unnamed (a window of an item without an id occurs) and the longest verbatim match of at least a window
    (0 words if there is none), its item and its first word."""
    spark = docs.sparkSession
    if not 1 <= window <= DEPTH:
        raise ValueError(f"a window has 1 to {DEPTH} words")
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).dropna(subset=["text"]).dropDuplicates()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size * 2 // block_bytes)) if size > block_bytes else 1
    at = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = docs.select(
        F.struct("*").alias("row"), F.col("text").cast("string").alias("text"), F.lit(None).cast(MATCH).alias("match")
    )
    for number in range(blocks):
        rows = items.filter(at == number).orderBy(F.col("item_id").asc_nulls_last(), "text").toArrow()
        block = spark.sparkContext.broadcast(_block(rows, window))
        if number:
            out = scratch.keep(out, "zstd")
        out = out.mapInArrow(lambda batches, block=block: _search(batches, block.value), out.schema)
    return out.drop("text")


def _block(rows: pa.Table, window: int) -> Block:
    words = words_of(rows.column("text").combine_chunks(), NO_ALNUM, lower=True)
    count = np.diff(words.first)
    starts = np.where(count >= window, count - window + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(count)), starts)
    start = words.first[row] + np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts)
    need = np.minimum(count, window)[row]
    ids = rows.column("item_id").to_pylist()
    new = np.array([i > 0 and ids[i] != ids[i - 1] for i in range(len(ids))], dtype=np.int64)
    item, ids = np.cumsum(new)[row], list(dict.fromkeys(ids))
    kind = _kinds(words.hash, start, need)
    first = np.unique(kind, return_index=True)[1]
    held = np.unique(kind * max(1, len(ids)) + item)
    of_kind, held = held // max(1, len(ids)), held % max(1, len(ids))
    edges = np.searchsorted(of_kind, np.arange(len(first) + 1))
    groups = [np.array([i]) for i in range(len(ids))]
    group = held[edges[:-1]]
    numbers: dict[bytes, int] = {}
    for k in np.flatnonzero(np.diff(edges) > 1).tolist():
        shared = held[edges[k] : edges[k + 1]]
        group[k] = numbers.setdefault(shared.tobytes(), len(groups))
        if group[k] == len(groups):
            groups.append(shared)
    return Block(words.hash, words.first[1:], start, kind, item, ids, first, need[first], group, groups, window)


def _kinds(text: np.ndarray, start: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Number of each window, equal for equal words: two spans of a power of two cover it."""
    key = np.zeros((3, len(start)), dtype=np.int64)
    rank, step = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while len(start) and step <= need.max():
        mine = (need >= step) & (need < 2 * step)
        key[:, mine] = need[mine], rank[start[mine]], rank[start[mine] + need[mine] - step]
        following = np.zeros(len(rank), dtype=np.int64)
        following[:-step] = rank[step:]
        rank = np.unique(rank * (len(rank) + 1) + following, return_inverse=True)[1].astype(np.int64)
        step *= 2
    whole = np.unique(key[1] * (len(text) + 1) + key[2], return_inverse=True)[1].astype(np.int64)
    return np.unique(whole * (DEPTH + 1) + key[0], return_inverse=True)[1].astype(np.int64)


def suffix_array(words: Words) -> np.ndarray:
    """Word positions in the order of the next ``DEPTH`` words of their text (an ended text first)."""
    rank = np.unique(words.hash, return_inverse=True)[1].astype(np.int64) + 1
    left = words.first[words.row + 1] - np.arange(len(rank))
    step = 1
    while step < DEPTH:
        following = np.zeros(len(rank), dtype=np.int64)
        following[:-step] = rank[step:]
        following[left <= step] = 0
        rank = np.unique(rank * (len(rank) + 1) + following, return_inverse=True)[1].astype(np.int64) + 1
        step *= 2
    return np.argsort(rank, kind="stable")


def _bounds(words: Words, order: np.ndarray, block: Block, beyond: bool) -> np.ndarray:
    """First place in ``order`` not before (or, ``beyond``, after) each kind of window."""
    start = block.start[block.first]
    low = np.zeros(len(start), dtype=np.int64)
    high = np.full(len(start), len(order))
    ends = words.first[words.row + 1]
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        place, wanted, need = order[middle], start[open_], block.need[open_]
        after = np.full(len(open_), not beyond)  # of an equal suffix
        todo = np.arange(len(open_))
        for depth in range(int(need.max())):
            todo = todo[need[todo] > depth]
            if not len(todo):
                break
            at = place[todo] + depth
            there = at < ends[place[todo]]
            mine = words.hash[np.where(there, at, 0)]
            theirs = block.words[wanted[todo] + depth]
            equal = there & (mine == theirs)
            differs = ~equal
            after[todo[differs]] = (there & (mine > theirs))[differs]
            todo = todo[equal]
        high[open_[after]] = middle[after]
        low[open_[~after]] = middle[~after] + 1


def _search(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SHARD_BYTES):
            words = words_of(part.column("text"), NO_ALNUM, lower=True)
            found = _find(words, block) if len(block.start) and len(words.hash) else {}
            counts = np.diff(words.first).tolist()
            match = [
                _merge(before, count, found.get(i))
                for i, (before, count) in enumerate(zip(part.column("match").to_pylist(), counts, strict=True))
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("text"), pa.array(match, type=batch.schema.field("match").type)],
                names=["row", "text", "match"],
            )


def _find(words: Words, block: Block) -> dict[int, tuple[list, set, int, int, int]]:
    """By row: hit spans, items, and the longest match with its item and place.

    A word starts at most one kind of window of each length, so the places found are at most
    ``window`` times the words, also in texts and items of one repeated word."""
    order = suffix_array(words)
    low, high = _bounds(words, order, block, False), _bounds(words, order, block, True)
    times = high - low
    kind = np.repeat(np.arange(len(times)), times)
    if not len(kind):
        return {}
    place = order[np.repeat(low, times) + np.arange(len(kind)) - np.repeat(np.cumsum(times) - times, times)]
    row = np.searchsorted(words.first, place, side="right") - 1
    hit = _covered(len(words.hash), place, block.need[kind])
    out: dict[int, tuple[list, set, int, int, int]] = {}
    for r in np.unique(row).tolist():
        mine = np.concatenate(([False], hit[words.first[r] : words.first[r + 1]], [False]))
        edges = np.flatnonzero(mine[1:] != mine[:-1]).reshape(-1, 2).tolist()
        out[r] = (edges, set(), 0, 0, 0)
    shared = np.unique(row * len(block.groups) + block.group[kind])
    for r, group in zip((shared // len(block.groups)).tolist(), (shared % len(block.groups)).tolist(), strict=True):
        out[r][1].update(block.ids[i] for i in block.groups[group].tolist())
    length = block.need[kind].copy()
    item = np.array([g[0] for g in block.groups])[block.group[kind]]
    whole = np.flatnonzero(length == block.window)
    if len(whole):
        length[whole], item[whole] = _extended(words, block, row[whole], place[whole], kind[whole])
    best = np.lexsort((place, item, -length, row))
    best = best[np.append(True, row[best[1:]] != row[best[:-1]])]
    for r, n, i, at in zip(row[best].tolist(), length[best].tolist(), item[best].tolist(), place[best].tolist(), strict=True):
        out[r] = (*out[r][:2], n, block.ids[i], at - int(words.first[r]))
    return out


def _covered(size: int, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    change = np.zeros(size + 1, dtype=np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) > 0


def _extended(words: Words, block: Block, row: np.ndarray, place: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest match of each place that starts a whole window, and for the longest of a row the first
    item that has it (for others any number).

    A match consists of words that some window hits, in the document and in the item. These words of
    both sides are ranked together by doubling; the neighbours of a place among the windows of the
    items give its longest match, and a range of them the items that share it."""
    occurs = np.zeros(len(block.need), dtype=bool)
    occurs[kind] = True
    starts = np.flatnonzero(occurs[block.kind])
    ours = np.flatnonzero(_covered(len(words.hash), place, block.window))
    theirs = np.flatnonzero(_covered(len(block.words), block.start[starts], block.window))
    text = np.concatenate((words.hash[ours], block.words[theirs]))
    last = np.concatenate([_last(ours, words.first[1:]), _last(theirs, block.ends)])
    stops = np.flatnonzero(last)
    at = np.arange(len(text))
    left = stops[np.searchsorted(stops, at)] - at + 1
    levels = _levels(text, left, int(left[len(ours) :].max()))
    rank = levels[-1]
    inner = len(ours) + np.searchsorted(theirs, block.start[starts])
    by_rank = np.argsort(rank[inner], kind="stable")
    inner, item = inner[by_rank], block.item[starts][by_rank]
    here = np.searchsorted(ours, place)
    after = np.searchsorted(rank[inner], rank[here])
    right = np.minimum(after, len(inner) - 1)
    before = np.maximum(after - 1, 0)
    with_right = _common(levels, left, here, inner[right])
    with_before = _common(levels, left, here, inner[before])
    length = np.maximum(with_right, with_before)
    most = np.zeros(len(words.first), dtype=np.int64)
    np.maximum.at(most, row, length)
    best = np.flatnonzero(length == most[row])
    near = np.where(with_right >= with_before, right, before)[best]
    shared = _tables(_common(levels, left, inner[:-1], inner[1:]))
    low, high, wanted = near.copy(), near.copy(), length[best]
    for k in reversed(range(len(shared))):
        table, step = shared[k], 1 << k
        ok = high + step <= len(inner) - 1
        ok[ok] = table[high[ok]] >= wanted[ok]
        high[ok] += step
        ok = low >= step
        ok[ok] = table[low[ok] - step] >= wanted[ok]
        low[ok] -= step
    lowest = _tables(item)
    out = np.zeros(len(place), dtype=np.int64)
    size = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    for k in np.unique(size).tolist():
        mine = size == k
        out[best[mine]] = np.minimum(lowest[k][low[mine]], lowest[k][high[mine] + 1 - (1 << k)])
    return length, out


def _last(at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the word at each place is the last of its span or of its text."""
    return np.append(at[1:] != at[:-1] + 1, True) | np.isin(at + 1, ends)


def _levels(text: np.ndarray, left: np.ndarray, longest: int) -> list[np.ndarray]:
    """Ranks of the next 1, 2, 4 ... words of each place (an ended text first), until they tell all apart
    that differ within ``longest`` words."""
    rank = np.unique(text, return_inverse=True)[1]
    levels, step, known = [rank.astype(np.int32)], 1, -1
    while step < longest and rank.max() != known:
        known = rank.max()
        following = np.zeros(len(rank), dtype=np.int64)
        following[:-step] = rank[step:] + 1
        following[left <= step] = 0
        rank = np.unique(rank * (len(rank) + 1) + following, return_inverse=True)[1]
        levels.append(rank.astype(np.int32))
        step *= 2
    return levels


def _common(levels: list[np.ndarray], left: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Number of equal words from two places on."""
    most = np.minimum(left[one], left[other])
    equal = levels[-1][one] == levels[-1][other]
    n = np.where(equal, most, 0)
    for k in reversed(range(len(levels) - 1)):
        open_ = np.flatnonzero(n < most)
        same = levels[k][one[open_] + n[open_]] == levels[k][other[open_] + n[open_]]
        open_ = open_[same]
        n[open_] = np.minimum(n[open_] + (1 << k), most[open_])
    return n


def _tables(values: np.ndarray) -> list[np.ndarray]:
    """Smallest of 1, 2, 4 ... values from each place on."""
    tables = [values.astype(np.int32)] if len(values) else []
    while tables and len(tables[-1]) > 1 << (len(tables) - 1):
        step = 1 << (len(tables) - 1)
        tables.append(np.minimum(tables[-1][:-step], tables[-1][step:]))
    return tables


def _merge(before: dict | None, count: int, found: tuple | None) -> dict:
    before = before or {"hits": [], "items": [], "unnamed": False, "longest": 0, "longest_item": None, "longest_at": None}
    edges, items, longest, item, at = found or ([], set(), 0, 0, 0)
    spans: list[list[int]] = []
    for begin, stop in sorted([*edges, *([s["begin"], s["stop"]] for s in before["hits"])]):
        if spans and begin <= spans[-1][1]:
            spans[-1][1] = max(stop, spans[-1][1])
        else:
            spans.append([begin, stop])
    if longest > before["longest"]:
        before |= {"longest": longest, "longest_item": item, "longest_at": at}
    return before | {
        "n_words": count, "hits": [{"begin": a, "stop": b} for a, b in spans],
        "items": sorted({*items, *before["items"]} - {None}), "unnamed": before["unnamed"] or None in items,
    }


def judged(found: DataFrame) -> DataFrame:
    """Adds n_words, n_hit and contaminated: at least one word in twenty is hit."""
    n_hit = F.aggregate("match.hits", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["begin"])
    out = found.withColumn("n_words", F.col("match.n_words")).withColumn("n_hit", n_hit)
    return out.withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))
