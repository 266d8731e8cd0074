"""Operator 12, the prefix tree of conversations.

Every distinct turn (role, text) gets a number from a dictionary, so a conversation is a sequence of
numbers, and each distinct beginning of one is a node of the tree. Equal sequences become one with the
number of its members. The distinct ones are sorted into range shards of about ``SHARD_TURNS`` turns.
Each shard is a ternary search tree of its own: the median of its sorted sequences goes in first, then
those of both halves, so that the branches below a node are balanced. One pass over the nodes, children
before parents and without recursion, adds up members, leaves and saved bytes.

Only the nodes on the path that a shard's first or last sequence has in common with the shard next to it
lie in several shards. Every figure is a sum (or least) over shards there, because each such node counts
as a child, and with the bytes of its text, only in the first shard that holds it, and none is a leaf.
So one aggregate over these boundary nodes, by a digest of their sequence, merges the shards.

Turns are told apart by a 128-bit digest of role and text, sequences by one of 256 bits. A turn that is
more than a 64th of all rows is numbered by a broadcast of at most 64 rows, all others by a join. One
conversation's numbers (12 bytes a turn) are held by a task, and about 80 bytes a turn of a shard, so the
longest conversation is what bounds memory. The members that end at one node are listed by ranges of them,
and the lists hashed as a stream.

Cases: a null conv_id, or one that is no whole number, is no conversation and is left out; a null role
or text is empty; null turn numbers come first, equal ones are ordered by role and text; repeated rows
are turns as others; a conversation without turns is a member of the root; no conversations give no
nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerprep.session import Scratch

#: Turns of a range shard, about; a small table has fewer, so that all cores have a shard.
SHARD_TURNS = 200_000
LEAST_TURNS = 1000
#: A turn with a larger share of all rows than one in this many is numbered without a shuffle.
COMMON = 64

_SHARD = (
    "shard int, at int, parent_at int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
)
_NOTHING = hashlib.sha256(b"").hexdigest()


def _runs(values: pa.Array) -> list[int]:
    """Where runs of equal values begin, and the length."""
    if not len(values):
        return [0]
    changed = pc.not_equal(values.slice(1), values.slice(0, len(values) - 1))
    return [0, *(np.flatnonzero(changed.to_numpy(zero_copy_only=False)) + 1).tolist(), len(values)]


def turns(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 1), digest of role and text, and the bytes of the text of every turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pos = None, 0
        for batch in batches:
            places, digests, sizes = [], [], []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
                pos = pos + 1 if conv == last else 1
                last = conv
                first, second = role.encode(), text.encode()
                places.append(pos)
                digests.append(hashlib.blake2b(len(first).to_bytes(8, "little") + first + second, digest_size=16).digest())
                sizes.append(len(second))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), pa.array(places, pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32())],
                names=["conv", "pos", "digest", "size"],
            )

    rows = conversations.select(
        F.expr("try_cast(conv_id AS bigint)").alias("conv"), "turn",
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")),
    ).filter("conv IS NOT NULL")
    ordered = rows.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.select("conv", "role", "text").mapInArrow(run, "conv long, pos long, digest binary, size int")


def _gathered(rows: DataFrame) -> DataFrame:
    """conv, codes and sizes: one row for each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["conv", "codes", "sizes"], [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        held: list = []  # the conversation, and the arrays of its turns so far

        def rows_of(done: list) -> pa.RecordBatch:
            columns = [[d[0] for d in done], [np.concatenate(d[1]) for d in done], [np.concatenate(d[2]) for d in done]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            conv, code, size = (batch.column(c) for c in ("conv", "code", "size"))
            done, cuts = [], _runs(conv)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[0] == conv[a].as_py():
                    held[1].append(code[a:b].to_numpy())
                    held[2].append(size[a:b].to_numpy())
                else:
                    done += [held] if held else []
                    held = [conv[a].as_py(), [code[a:b].to_numpy()], [size[a:b].to_numpy()]]
            if done:
                yield rows_of(done)
        if held:
            yield rows_of([held])

    ordered = rows.repartition("conv").sortWithinPartitions("conv", "pos").select("conv", "code", "size")
    return ordered.mapInArrow(run, "conv long, codes array<bigint>, sizes array<int>")


def sequences(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv, codes (numbers of its turns in order) and sizes (bytes of their texts) of every conversation."""
    rows = scratch.keep(turns(conversations))
    counted = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    numbers = scratch.keep(counted.withColumn("code", F.monotonically_increasing_id()))
    total = numbers.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # At most COMMON rows, whatever the data.
    common = F.broadcast(numbers.filter(F.col("n") * COMMON > total).select("digest", "code"))
    rare = rows.join(common, "digest", "left_anti").join(numbers.select("digest", "code"), "digest")
    columns = ("conv", "pos", "code", "size")
    return scratch.keep(_gathered(rows.join(common, "digest").select(*columns).unionByName(rare.select(*columns))))


def _listed(keyed: DataFrame) -> DataFrame:
    """key, conv (the first), n and listed: the members of a sequence in order, some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, conv = batch.column("key"), batch.column("conv").to_pylist()
            cuts = _runs(key)
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            firsts = [a for a, _ in spans]
            yield pa.RecordBatch.from_arrays(
                [key.take(pa.array(firsts, pa.int64())), pa.array([conv[a] for a in firsts], pa.int64()), pa.array([b - a for a, b in spans], pa.int64()),
                 pa.array([",".join(map(str, conv[a:b])).encode() for a, b in spans], pa.binary())],
                names=["key", "conv", "n", "listed"],
            )

    ordered = keyed.select("key", "conv").repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")
    return ordered.mapInArrow(run, "key binary, conv long, n long, listed binary")


def _members(keyed: DataFrame) -> DataFrame:
    """key, conv (the smallest), n and ends of every distinct sequence, from a stream of its members in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["key", "conv", "n", "ends"], [pa.binary(), pa.int64(), pa.int64(), pa.string()]
        held: list = []  # the key, its smallest member, their number, and the hash so far

        def rows_of(done: list) -> pa.RecordBatch:
            columns = zip(*((key, conv, n, hash_.hexdigest()) for key, conv, n, hash_ in done), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            done = []
            for key, conv, n, listed in zip(*(batch.column(c).to_pylist() for c in ("key", "conv", "n", "listed")), strict=True):
                if held and held[0] == key:
                    held[2] += n
                    held[3].update(b"," + listed)
                else:
                    done += [held] if held else []
                    held = [key, conv, n, hashlib.sha256(listed)]
            if done:
                yield rows_of(done)
        if held:
            yield rows_of([held])

    ordered = _listed(keyed).repartition("key").sortWithinPartitions("key", "conv")
    return ordered.mapInArrow(run, "key binary, conv long, n long, ends string")


class Tree:
    """Ternary search tree over number sequences. Node 0 is the root, and every node comes after its parent."""

    def __init__(self) -> None:
        self.code, self.size, self.depth, self.parent = (array("q", [x]) for x in (0, 0, 0, -1))
        self.low, self.high, self.child = (array("q", [-1]) for _ in range(3))

    def _chain(self, parent: int, codes: list[int], sizes: list[int]) -> int:
        """Add ``codes`` one below the other; returns the first of them."""
        first, n = len(self.code), len(codes)
        self.code.extend(codes)
        self.size.extend(sizes)
        depth = self.depth[parent]
        self.depth.extend(range(depth + 1, depth + n + 1))
        self.parent.append(parent)
        self.parent.extend(range(first, first + n - 1))
        for links in (self.low, self.high):
            links.extend(array("q", [-1]) * n)
        self.child.extend(range(first + 1, first + n))
        self.child.append(-1)
        return first

    def insert(self, codes: list[int], sizes: list[int]) -> int:
        """The node of ``codes``."""
        code, low, high, child = self.code, self.low, self.high, self.child
        node = 0
        for d, c in enumerate(codes):
            at = child[node]
            if at < 0:
                child[node] = self._chain(node, codes[d:], sizes[d:])
                return len(code) - 1
            while code[at] != c:
                side = low if c < code[at] else high
                if side[at] < 0:
                    side[at] = self._chain(node, codes[d:], sizes[d:])
                    return len(code) - 1
                at = side[at]
            node = at
        return node

    def path(self, node: int, depth: int) -> list[int]:
        """Nodes from the root to ``node`` down to ``depth``."""
        while self.depth[node] > depth:
            node = self.parent[node]
        out = [node]
        while node:
            node = self.parent[node]
            out.append(node)
        return out[::-1]


def medians(n: int) -> Iterator[int]:
    """0 to n - 1: the middle, then the middles of both sides."""
    spans = [(0, n)]
    while spans:
        a, b = spans.pop()
        if a < b:
            middle = (a + b) // 2
            yield middle
            spans += [(middle + 1, b), (a, middle)]


def _prefix_keys(codes: list[int]) -> list[bytes]:
    """Digests of no turns, of the first, of the first two, ..."""
    state = hashlib.blake2b(digest_size=16)
    out = [state.digest()]
    for c in codes:
        state.update(c.to_bytes(8, "little", signed=True))
        out.append(state.copy().digest())
    return out


def _shard(rows: pa.Table) -> pa.Table:
    """Nodes of a shard. ``left`` and ``right`` tell how many turns its first and last sequence share with
    the sequence before and after it in other shards; -1 where there is none. Nodes that other shards hold
    too have a ``key``, and a place ``at`` in this shard by which their children here name them."""
    codes, sizes = rows.column("codes").to_pylist(), rows.column("sizes").to_pylist()
    convs, counts, ends = (rows.column(c).to_pylist() for c in ("conv", "n", "ends"))
    left, right = rows.column("left")[0].as_py(), rows.column("right")[0].as_py()
    order = sorted(range(len(codes)), key=codes.__getitem__)
    tree, node_of = Tree(), {}
    for m in medians(len(order)):
        node_of[order[m]] = tree.insert(codes[order[m]], sizes[order[m]])
    n = len(tree.code)
    members, least, leaves, branches, saved = (array("q", [0]) * n for _ in range(5))
    listed: list = [None] * n
    for i, node in node_of.items():
        members[node], least[node], listed[node] = counts[i], convs[i], ends[i]
    first, last = order[0], order[-1]
    left_path = tree.path(node_of[first], left) if left >= 0 else []
    right_path = tree.path(node_of[last], right) if right >= 0 else []
    at = {node: -1 - d for d, node in enumerate(right_path)} | {node: d for d, node in enumerate(left_path)}
    elsewhere, goes_on = set(left_path), set(right_path)  # counted in an earlier shard; with children in a later one
    size, parent = tree.size, tree.parent
    for node in range(n - 1, -1, -1):
        if tree.child[node] < 0 and node not in goes_on:
            leaves[node] = 1
        saved[node] += members[node] * size[node] - (0 if node in elsewhere else size[node])
        up = parent[node]
        if up >= 0:
            least[up] = min(least[up], least[node]) if members[up] else least[node]
            members[up] += members[node]
            leaves[up] += leaves[node]
            saved[up] += saved[node]
            branches[up] += node not in elsewhere
    keys: list = [None] * n
    for sequence, path in ((first, left_path), (last, right_path)):
        for node, key in zip(path, _prefix_keys(codes[sequence][: len(path)]), strict=False):
            keys[node] = key
    ups = np.frombuffer(parent, dtype=np.int64)
    above = np.frombuffer(least, dtype=np.int64)[np.maximum(ups, 0)]
    number = lambda a: pa.array(np.frombuffer(a, dtype=np.int64))
    return pa.table(
        {
            "shard": pa.array(np.full(n, rows.column("shard")[0].as_py(), dtype=np.int32)),
            "at": pa.array([at.get(i) for i in range(n)], pa.int32()),
            "parent_at": pa.array([at.get(i) for i in parent], pa.int32()),
            "key": pa.array(keys, pa.binary()),
            "parent_key": pa.array([keys[i] if i >= 0 else None for i in parent], pa.binary()),
            "conv_id": number(least), "depth": number(tree.depth), "parent_conv_id": pa.array(above, mask=ups < 0),
            "n_convs": number(members), "n_children": number(branches), "n_leaves": number(leaves), "saved_tokens": number(saved),
            "ends": pa.array(listed, pa.string()),
        }
    )


def prefix_trie(given: DataFrame, scratch: Scratch) -> DataFrame:
    """Nodes of the prefix tree of ``given`` (conv, codes, sizes), one row for each.

    conv_id is the smallest member and names the node together with depth; ends is the SHA-256 of the
    members that end there, by number and joined by commas."""
    text = F.array_join(F.col("codes").cast("array<string>"), ",")
    keyed = scratch.keep(given.withColumn("key", F.unhex(F.sha2(text, 256))))
    distinct = scratch.keep(_members(keyed).join(keyed, ["key", "conv"]).drop("key"))
    total = distinct.agg(F.coalesce(F.sum(F.size("codes") + 1), F.lit(0))).first()[0]
    shards = max(-(-total // SHARD_TURNS), min(given.sparkSession.sparkContext.defaultParallelism, total // LEAST_TURNS), 1)
    ranges = distinct.repartitionByRange(shards, "codes")
    placed = scratch.keep(ranges.withColumn("shard", F.spark_partition_id()))
    ordered = Window.orderBy("shard")  # one row for each shard
    common = "array_position(zip_with({}, {}, (x, y) -> coalesce(x = y, false)), false) - 1"
    bounds = placed.groupBy("shard").agg(F.min("codes").alias("first"), F.max("codes").alias("last"))
    bounds = bounds.withColumn("before", F.lag("last").over(ordered)).withColumn("after", F.lead("first").over(ordered))
    shared = bounds.select(
        "shard", *(F.coalesce(F.expr(common.format(a, b)), F.lit(-1)).cast("int").alias(name) for name, a, b in (("left", "before", "first"), ("right", "last", "after")))
    )
    nodes = scratch.keep(placed.join(shared, "shard").groupBy("shard").applyInArrow(_shard, _SHARD))
    inner, edges = nodes.filter("at IS NULL"), nodes.filter("at IS NOT NULL")
    merged = scratch.keep(
        edges.groupBy("key").agg(
            F.first("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
            *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("ends").alias("ends"),
        )
    )
    named = merged.select("key", F.col("conv_id").alias("up"))
    places = edges.select("shard", F.col("at").alias("parent_at"), "key").join(named, "key").drop("key")
    below = inner.filter("parent_at IS NOT NULL").join(places, ["shard", "parent_at"]).withColumn("parent_conv_id", F.col("up"))
    boundary = merged.join(named.withColumnRenamed("key", "parent_key"), "parent_key", "left").withColumn("parent_conv_id", F.col("up"))
    columns = [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(_NOTHING)).alias("ends"),
    ]
    return inner.filter("parent_at IS NULL").select(*columns).unionByName(below.select(*columns)).unionByName(boundary.select(*columns))
