"""Operator 13, byte-level BPE: texts to token ids, and ids back to bytes.

A text is cut into pre-tokens by the rules of ``PATTERN``, as array steps over its bytes. Two tiers
give their ids. A minimal perfect hash over the vocabulary answers for pre-tokens that are tokens:
each of its n slots holds one token, and the bytes in the slot are compared, so an unknown pre-token
never passes for a known one. For the rest a heap of ranks over linked bytes joins the pair of lowest
rank, the leftmost of equals, until no pair is a token. What a task has joined it keeps, up to a bound.

Texts are cut before white space into pieces of about a megabyte, where the pattern always cuts too,
so a task holds the ids of one text and the work of one piece. The tables that travel to the tasks
are made from the vocabulary alone. There is no shuffle.

Cases: null and empty texts have no tokens; texts are plain, special tokens in them too; repeated rows
are encoded as often as they come, a null doc_id as any other; an empty table gives no rows; other
columns are ignored. A single pre-token of megabytes is joined whole, in n log n steps.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerprep.llm.words import _bytes, mix, slices

#: Bytes of a text handled at once.
PIECE_BYTES = 1 << 20
#: Joined pre-tokens a task keeps.
KNOWN_WORDS = 400_000
#: Tokens a bucket of the hash holds on average.
_LOAD = 4

# The classes the pattern tells apart, and what may follow an apostrophe.
WHITE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
CLASSES = {LETTER: r"\p{L}", NUMBER: r"\p{N}", WHITE: r"\s"}
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT = b"stmd"
LONG = (b"re", b"ve", b"ll")

_POWER = 0x9FB21C651E98DF25


class Vocabulary(NamedTuple):
    """Tokens by slot of the hash, tokens by id, and the class of every code point."""

    size: int
    shift: np.ndarray
    factor: np.ndarray
    ids: np.ndarray
    start: np.ndarray
    length: np.ndarray
    data: np.ndarray
    by_id: np.ndarray
    classes: np.ndarray
    ranks: dict[bytes, int]


def _spread(x: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, first place and step of 64-bit hashes."""
    a, b = mix(x ^ np.uint64(0xA0761D6478BD642F)), mix(x ^ np.uint64(0xE7037ED1A0B428DB))
    return (x % np.uint64(buckets)).astype(np.int64), (a % np.uint64(n)).astype(np.int64), 1 + (b % np.uint64(max(1, n - 1))).astype(np.int64)


def _hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of parts of ``data`` that lie one behind the other without gaps."""
    length = stop - start
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(max(1, int(length.max(initial=0))), _POWER, dtype=np.uint64))
        at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        total = np.zeros(len(at) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[at], out=total[1:])
        ends = np.cumsum(length)
        return mix((total[ends] - total[ends - length]) ^ (length.astype(np.uint64) << np.uint64(48)))


def _perfect(hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """factor and shift of every bucket, and the slot of every hash: each slot is taken once.

    Buckets are placed from the largest on: the first free shift of the places of a bucket, with
    the next factor where its places fall together."""
    n = len(hashed)
    if len(np.unique(hashed)) < n:
        raise ValueError("two tokens have one hash")
    buckets = max(1, n // _LOAD)
    bucket, first, step = _spread(hashed, n, buckets)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    begin = np.cumsum(sizes) - sizes
    factor, shift = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
    free, slot = np.ones(2 * n, dtype=bool), np.zeros(n, dtype=np.int64)
    for b in np.argsort(-sizes, kind="stable").tolist():
        members = order[begin[b] : begin[b] + sizes[b]]
        for f in range(n if len(members) else 0):
            places = (first[members] + f * step[members]) % n
            if len(set(places.tolist())) < len(places):
                continue
            open_ = np.logical_and.reduce([free[p : p + n] for p in places.tolist()])
            s = int(open_.argmax())
            if open_[s]:
                factor[b], shift[b] = f, s
                slot[members] = (places + s) % n
                free[slot[members]] = free[slot[members] + n] = False
                break
        else:
            if len(members):
                raise ValueError("no perfect hash found")
    return factor, shift, slot


def classes() -> np.ndarray:
    """Class of every code point, as the library whose results are to match tells them."""
    chars = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    bytes_ = {bytes([i]): i for i in range(256)}
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for name, pattern in CLASSES.items():
        found = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=bytes_, special_tokens={}).encode_ordinary(chars)
        out[np.frombuffer(bytes(found).decode().encode("utf-32-le"), dtype=np.uint32)] = name
    return out


@cache
def vocabulary(path: str) -> Vocabulary:
    """Tables of a file of lines with a token in base 64 and its rank, which is its id."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.read().splitlines())}
    if any(bytes([i]) not in ranks for i in range(256)):
        raise ValueError("a byte is no token")
    tokens = list(ranks)
    length = np.array([len(t) for t in tokens], dtype=np.int64)
    data, stop = np.frombuffer(b"".join(tokens), dtype=np.uint8), np.cumsum(length)
    factor, shift, slot = _perfect(_hashes(data, stop - length, stop))
    order = np.argsort(slot)
    ids = np.array(list(ranks.values()), dtype=np.uint32)[order]
    by_id = np.full(int(ids.max()) + 1, -1, dtype=np.int64)
    by_id[ids] = np.arange(len(ids))
    return Vocabulary(len(tokens), shift, factor, ids, (stop - length)[order], length[order], data, by_id, classes(), ranks)


def _code_points(data: np.ndarray, lead: np.ndarray) -> np.ndarray:
    first = data[lead].astype(np.int32)
    out = first.copy()
    wide = np.flatnonzero(first >= 0xC0)
    for width, low, high, kept in ((2, 0xC0, 0xE0, 0x1F), (3, 0xE0, 0xF0, 0x0F), (4, 0xF0, 0x100, 0x07)):
        some = wide[(first[wide] >= low) & (first[wide] < high)]
        value = first[some] & kept
        for i in range(1, width):
            value = (value << 6) | (data[lead[some] + i] & 0x3F)
        out[some] = value
    return out


def pre_tokens(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where in ``data`` the pre-tokens of the texts between ``offsets`` begin; the first after a place ends it."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(lead)
    if not n:
        return lead
    point = _code_points(data, lead)
    kind = classes[point]
    first = np.zeros(n + 3, dtype=bool)  # characters that begin a text; the end counts as one
    first[np.searchsorted(lead, offsets)] = True
    first[n:] = True
    last, white = first[1 : n + 1], kind == WHITE
    begin = np.append(first[:n], [False] * 3)
    begin[1:n] |= kind[1:] != kind[:-1]
    # The last of several white characters stays with what follows, if it is a blank, or stands alone.
    inner = np.flatnonzero(white[:-1] & ~white[1:] & ~last[:-1])
    begin[inner] = True
    begin[inner + 1] = point[inner] != 0x20
    quote = np.flatnonzero((point == 0x27) & begin[:n] & ~last)
    if len(quote):
        after = np.append(point, [0, 0])
        one = np.isin(after[quote + 1], list(SHORT))
        two = np.zeros(len(quote), dtype=bool)
        for a, b in LONG:
            two |= (after[quote + 1] == a) & (after[quote + 2] == b) & ~first[quote + 2]
        begin[quote[one | two] + 1] = False
        begin[np.append(quote[one] + 2, quote[two] + 3)] = True
    return lead[begin[:n]]


def join(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: the pair of lowest rank is joined until none is a token."""
    n = len(word)
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = following[i]  # 0 where i was joined to what lies before
        if not middle or middle >= n or following[middle] != stop:
            continue
        following[i], following[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : following[stop]])) is not None:
                heapq.heappush(heap, (r, i, following[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : following[i]]])
        i = following[i]
    return out


def _looked_up(data: np.ndarray, start: np.ndarray, stop: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Slot of every part of ``data``, or -1 where it is no token."""
    bucket, first, step = _spread(_hashes(data, start, stop), v.size, len(v.shift))
    slot = (first + v.factor[bucket] * step + v.shift[bucket]) % v.size
    length = stop - start
    slot[v.length[slot] != length] = -1
    some = np.flatnonzero(slot >= 0)
    if len(some):
        size = length[some]
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1])) - np.repeat(ends - size, size)
        differs = data[np.repeat(start[some], size) + at] != v.data[np.repeat(v.start[slot[some]], size) + at]
        slot[some[np.logical_or.reduceat(differs, ends - size)]] = -1
    return slot


def encode_texts(data: np.ndarray, offsets: np.ndarray, v: Vocabulary, known: dict[bytes, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts between ``offsets``, one behind the other, and where those of each text begin."""
    start = pre_tokens(data, offsets, v.classes)
    if not len(start):
        return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64)
    stop = np.append(start[1:], len(data))
    slot = _looked_up(data, start, stop, v)
    missed, raw, joined = np.flatnonzero(slot < 0), data.tobytes(), []
    for a, b in zip(start[missed].tolist(), stop[missed].tolist(), strict=True):
        word = raw[a:b]
        ids = known.get(word)
        if ids is None:
            ids = join(word, v.ranks)
            if len(word) <= 64:
                if len(known) >= KNOWN_WORDS:
                    known.clear()
                known[word] = ids
        joined.append(ids)
    count = np.ones(len(start), dtype=np.int64)
    count[missed] = [len(ids) for ids in joined]
    begin = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(count, out=begin[1:])
    out = np.empty(begin[-1], dtype=np.uint32)
    hit = np.flatnonzero(slot >= 0)
    out[begin[hit]] = v.ids[slot[hit]]
    if len(missed):
        size = count[missed]
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(begin[missed], size) + at] = np.fromiter(chain.from_iterable(joined), dtype=np.uint32)
    return out, begin[np.searchsorted(start, offsets)]


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of a long text. A cut lies before white space behind a visible ASCII character."""
    at, n = 0, len(data)
    while n - at > PIECE_BYTES:
        to = at + PIECE_BYTES
        while to < n:
            seen = data[to - 1 : to + PIECE_BYTES]
            blank = (seen[1:] == 0x20) | ((seen[1:] >= 0x09) & (seen[1:] <= 0x0D))
            cuts = np.flatnonzero(blank & (seen[:-1] > 0x20) & (seen[:-1] < 0x7F))
            if len(cuts):
                to += int(cuts[0])
                break
            to += PIECE_BYTES
        if to >= n:
            break
        yield data[at:to]
        at = to
    yield data[at:]


def _binary(values: np.ndarray, offsets: np.ndarray, width: int) -> pa.Array:
    """Parts of ``values`` between ``offsets`` as binary values."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets * width)), pa.py_buffer(np.ascontiguousarray(values))]
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, buffers)


def _tables(spark, path: str) -> Broadcast:
    """The tables of a vocabulary for the tasks: a few megabytes, whatever the texts."""
    return spark.sparkContext.broadcast(vocabulary(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and ids (unsigned 32-bit numbers, low byte first) of every text."""
    shared = _tables(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, known = shared.value, {}
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = _bytes(part.column("text"))
                if part.num_rows == 1 and len(data) > PIECE_BYTES:
                    found = [encode_texts(p, np.array([0, len(p)]), v, known)[0] for p in _pieces(data)]
                    ids = np.concatenate(found)
                    begin = np.array([0, len(ids)], dtype=np.int64)
                else:
                    ids, begin = encode_texts(data, offsets, v, known)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(begin)), _binary(ids.astype("<u4"), begin, 4).cast(pa.binary())],
                    names=["doc_id", "n_tokens", "ids"],
                )

    picked = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encoded`` with ``decoded``, the bytes of their ``ids``; an id that is none ends the job."""
    shared = _tables(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for value in part.column("ids"):
                    ids = np.frombuffer(value.as_buffer() or b"", dtype="<u4")
                    slot = v.by_id[ids]
                    if (slot < 0).any():
                        raise ValueError("an id is no token")
                    size = v.length[slot]
                    places = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                    out.append(v.data[np.repeat(v.start[slot], size) + places].tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*part.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, decoded binary")
