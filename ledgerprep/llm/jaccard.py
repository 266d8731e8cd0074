"""Operator 2, n-gram Jaccard join by count vectors and R-trees.

A text is its set of ``k``-word shingles. Shingles are hashed into 64 groups, and the counts
of a text in them are its point. Two texts share at most the sum, over the groups, of the smaller
count, so a pair, or two boxes of points, whose sum is below what the threshold needs is out. What
is left is compared by points of 256 groups in the same way, and then verified on the sets themselves.

A tree over all points alone would compare every text with all of like length, because points of
unrelated texts of one length lie in one cloud. So the directory above the trees is exact and
finer: texts that link differ in at most r shingles, so of r + 1 + s groups at least s + 1 have the very
same content. So each text may leave out s of its groups, in one order for all texts: those whose
content the most texts share. The coldest group of a pair that links is never among them. What common
lines make equal goes first, so texts are not tied by them, however many there are. Texts that share the
content of a group left form a family (a connected component of that relation); texts that link are
always in one family.

Each family is packed into leaves by size. A leaf is one task's work: boxes over its points, pairs
of boxes and then of points that the bound leaves, verified from the best down, none between
texts that are connected by then. One text of each component of a leaf is compared with those of
the other leaves of the family. Pairs of leaves that still hold different components are compared
in full. So no link between components is lost, and no pair inside a component has to be made.

Texts with equal sets are one node from the start, named by 64 bits of the set's hash; should two
sets get one name, all starts again with another seed.

Cases: a null or empty text has an empty set and links with nothing; a text of fewer words than
``k`` is one shingle; a row with a null doc_id takes part, but names no component; rows with one
doc_id link by their texts only; each row gives one row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerprep.operators.components import components
from ledgerprep.llm.words import BLANK, Words, mix, run_hash, signed, slices, words_of
from ledgerprep.session import Scratch

#: Bits of the group number of a point, and of the finer point that pairs of points are compared by next.
BITS, FINER = 6, 8
BOX = 16
#: Pairs compared by finer points at once.
PAIRS = 1 << 14
#: A family of at most so many texts and shingles is one leaf; small families share one.
LEAF_ROWS = 4096
LEAF_SHINGLES = 2_000_000
SHARED_ROWS = 256
#: After so many signatures a task forgets which sets it has seen.
FLUSH = 1 << 20
#: Texts that share a signature are counted so far; more of them are not held at once.
HOTTEST = 1 << 16

LINKS = "a long, b long, head boolean"


def sets_of(words: Words, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all texts, and where those of each text begin (one more at the end)."""
    hashed = words.hash ^ mix(np.array([seed + 1], dtype=np.uint64))[0]
    count = np.diff(words.first)
    rows, values = [], []
    full = run_hash(hashed, k)
    if len(full):
        row = words.row[: len(full)]
        whole = np.arange(len(full)) + k <= words.first[row + 1]
        rows.append(row[whole])
        values.append(full[whole])
    for short in range(1, k):
        some = np.flatnonzero(count == short)
        if len(some):
            rows.append(some)
            values.append(mix(run_hash(hashed, short)[words.first[some]] + np.uint64(short)))
    if not rows:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(count) + 1, dtype=np.int64)
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return value, np.searchsorted(row, np.arange(len(count) + 1))


def _sums(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of numbers by text, modulo 2^64."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(value) + 1, dtype=np.uint64)
        np.cumsum(value, out=total[1:])
        return total[at[1:]] - total[at[:-1]]


@cache
def bands(num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes where bands begin, and by band: shingles that may differ, groups, and groups too many.

    Sizes of linked sets are in one band or in neighbouring ones. In a band, sets differ in at most
    r shingles where the smaller is of the band; r + 1 + spare groups leave 1 + spare of equal content.
    Those to spare are the ones expected to be empty, and a sixteenth more for the content that many share."""
    begin = [1]
    while begin[-1] < 1 << 40:
        begin.append(max(begin[-1] + 1, -(-begin[-1] * den // num)))
    size = np.array(begin, dtype=np.float64)
    differ = np.array([(den - num) * (b - 1) // num for b in begin[1:]], dtype=np.int64)
    more = -(-(differ + 1) // 16)
    empty = (differ + 1 + more) * np.exp(-size[:-1] / (differ + 1 + more))
    spare = more + np.ceil(empty + 4 * np.sqrt(empty)).astype(np.int64)
    return np.array(begin[:-1]), differ, differ + 1 + spare, spare


def signatures(value: np.ndarray, at: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and signature (hash of band, group and its content) of the groups of all texts, and how many of the
    text's signatures of that band may still be left out, times two, plus one for the lower of its bands.

    Groups without content are left out, unless a text has more of them than are to spare; one
    that it shares with another, which leaves fewer out, is then among the rest."""
    begin, differ, groups, spare = bands(num, den)
    size = np.diff(at)
    some = np.flatnonzero(size)
    band = np.searchsorted(begin, size[some], side="right") - 1
    out_row, out_sign, out_spare = [], [], []
    high = value >> np.uint64(32)
    weighed = mix(value)
    for lower in (0, 1):
        rows, k = some[band >= lower], band[band >= lower] - lower
        rows, k = rows[differ[k] > 0], k[differ[k] > 0]  # else linked sets are equal
        if not len(rows):
            continue
        n = size[rows]
        index = np.repeat(at[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        owner, g = np.repeat(np.arange(len(rows)), n), np.repeat(groups[k].astype(np.uint64), n)
        group = (high[index] * g) >> np.uint64(32)
        first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (group[1:] != group[:-1])))
        with np.errstate(over="ignore"):
            content = np.add.reduceat(weighed[index], first)
        place = (k[owner[first]].astype(np.uint64) << np.uint64(40)) + group[first]
        out_row.append(rows[owner[first]])
        out_sign.append(mix(content ^ mix(place)))
        lacks = groups[k] - np.bincount(owner[first], minlength=len(rows))
        out_spare.append((np.maximum(spare[k] - lacks, 0) * 2 + lower)[owner[first]])
        for i in np.flatnonzero(lacks > spare[k]).tolist():
            bare = np.setdiff1d(np.arange(groups[k[i]], dtype=np.uint64), group[first][owner[first] == i])
            out_row.append(np.full(len(bare), rows[i]))
            out_sign.append(mix(mix((np.uint64(k[i]) << np.uint64(40)) + bare)))
            out_spare.append(np.full(len(bare), lower))
    if not out_row:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(out_row), np.concatenate(out_sign), np.concatenate(out_spare)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def _named(part: pa.RecordBatch, k: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    value, at = sets_of(words_of(part.column("text"), BLANK, lower=True), k, seed)
    return value, at, _sums(mix(value), at), _sums(mix(value ^ np.uint64(0x5851F42D4C957F2D)), at)


def nodes(docs: DataFrame, k: int, seed: int) -> DataFrame:
    """doc_id, text_key, n, node and check (another name of the set) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                _, at, name, check = _named(part, k, seed)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(np.diff(at)), pa.array(signed(name)), pa.array(signed(check))],
                    names=["doc_id", "text_key", "n", "node", "check"],
                )

    return _texts(docs).mapInArrow(run, "doc_id long, text_key long, n long, node long, check long")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (sign, node, spare) in order of sign and node, those whose sign several nodes have, each once, with the
    number of these nodes (``HOTTEST`` at most) and the least of them."""
    held = [np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int32)]
    past = None  # sign, least and last node of a run whose first HOTTEST nodes have gone on
    for batch in chain(batches, (None,)):
        if batch is not None:
            held = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("sign", "node", "spare"), strict=True)]
        new = np.ones(len(held[0]), dtype=bool)
        new[1:] = (held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])
        if past:
            new &= (held[0] != past[0]) | (held[1] != past[2])
        held = [x[new] for x in held]
        sign, node, _ = held
        if not len(sign):
            continue
        begin = np.flatnonzero(np.append(True, sign[1:] != sign[:-1]))
        length, least = np.diff(np.append(begin, len(sign))), node[begin]
        heat = np.minimum(length, HOTTEST)
        if past and sign[0] == past[0]:
            heat[0], least[0] = HOTTEST, past[1]
        held_back = batch is not None and heat[-1] < HOTTEST  # the last run may go on
        to = int(begin[-1]) if held_back else len(sign)
        past = None if held_back else (sign[-1], least[-1], node[-1])
        heat, least = np.repeat(heat, length)[:to], np.repeat(least, length)[:to]
        several = heat > 1
        if several.any():
            columns = (*(x[:to][several] for x in held), heat[several].astype(np.int32), least[several])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["sign", "node", "spare", "heat", "least"])
        held = [x[to:] for x in held]


def shared_groups(docs: DataFrame, k: int, num: int, den: int, seed: int) -> DataFrame:
    """Pairs of nodes (a, b), some repeated, that connect all nodes with equal group content, but for the content that
    each may leave out: what the most nodes share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, seen = 0, set()
        for batch in batches:
            for part in slices(batch, "text"):
                value, at, name, _ = _named(part, k, seed)
                row, sign, spare = signatures(value, at, num, den)
                fresh = np.zeros(len(name), dtype=bool)
                for i, x in enumerate(name.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh[i] = True
                take = fresh[row]
                columns = signed(sign[take]), signed(name[row[take]]), spare[take].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["sign", "node", "spare"])
                given += int(take.sum())
                if given >= FLUSH:
                    given, seen = 0, set()

    signed_ = _texts(docs).select("text").filter("text IS NOT NULL").mapInArrow(run, "sign long, node long, spare int")
    several = signed_.repartition("sign").sortWithinPartitions("sign", "node").mapInArrow(
        _shared, "sign long, node long, spare int, heat int, least long"
    )
    hottest = Window.partitionBy("node", "spare").orderBy(F.desc("heat"), "sign")
    colder = several.withColumn("rank", F.row_number().over(hottest)).filter("rank > shiftright(spare, 1)")
    return colder.select(F.col("least").alias("a"), F.col("node").alias("b")).filter("a <> b")


def _leaves(members: DataFrame, *order: str) -> DataFrame:
    """Adds ``leaf``: runs of members (family, node, n, ...) in order of family, ``order`` and size, of bounded size.

    The order is dealt by ranges: a family that fits a leaf goes to one task, a larger one is many
    leaves of many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, rows, shingles, last = TaskContext.get().partitionId() << 32, 0, 0, None
        for batch in batches:
            out = []
            keys = zip(*(batch.column(c).to_pylist() for c in ("family", *order)), strict=True)
            for key, n in zip(keys, batch.column("n").to_pylist(), strict=True):
                full = rows >= LEAF_ROWS or shingles + n > LEAF_SHINGLES
                if rows and (full or key != last and rows >= SHARED_ROWS):
                    leaf, rows, shingles = leaf + 1, 0, 0
                rows, shingles, last = rows + 1, shingles + n, key
                out.append(leaf)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "leaf"])

    names = members.columns
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("_rows"), F.sum("n").alias("_shingles"))
    large = (F.col("_rows") > LEAF_ROWS) | (F.col("_shingles") > LEAF_SHINGLES)
    by = [*order, "n", "node"]
    dealt = members.join(sizes, "family").repartitionByRange("family", *(F.when(large, F.col(c)) for c in by))
    ranged = dealt.sortWithinPartitions("family", *by).select(*names)
    return ranged.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema) + ", leaf long")


def _sets(group: pa.Table, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sets of all texts of a leaf. Finding words takes many times a text's size, so it is done a slice at a time."""
    values, ends = [], [np.zeros(1, dtype=np.int64)]
    for batch in group.select(["text"]).combine_chunks().to_batches():
        for part in slices(batch, "text"):
            value, at = sets_of(words_of(part.column("text"), BLANK, lower=True), k, seed)
            values.append(value)
            ends.append(at[1:] + ends[-1][-1])
    return np.concatenate(values), np.concatenate(ends)


def _counts(value: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """Points of sets: how many shingles each of 2^``bits`` groups has."""
    row, dim = np.repeat(np.arange(len(at) - 1), np.diff(at)), (value >> np.uint64(64 - bits)).astype(np.int64)
    return np.bincount((row << bits) + dim, minlength=(len(at) - 1) << bits).reshape(-1, 1 << bits).astype(np.int32)


def _fine_points(value: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The finest point of each set, a byte a group: about as many groups as shingles, 256 at least, twice as
    many as often as a group has over 255. Neighbouring groups summed give any coarser point."""
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        bits = max(FINER, (b - a).bit_length() - 1)
        while True:
            count = np.bincount((value[a:b] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
            if count.max() <= 255:
                break
            bits += 1
        out.append(count.astype(np.uint8).tobytes())
    return out


def _fold(point: np.ndarray, groups: int) -> np.ndarray:
    return point.reshape(groups, -1).sum(axis=1, dtype=np.int32)


def _link(group: pa.Table, k: int, num: int, den: int, seed: int) -> pa.Table:
    """Links of the members (family, node, component, side, text) of a leaf, or of two leaves.

    With two sides only pairs of both count. A row with ``head`` names the member of a component that overlaps
    most with the others of it."""
    group = group.sort_by([("family", "ascending"), ("node", "ascending"), ("side", "ascending")])
    value, at = _sets(group, k, seed)
    family, node = group.column("family").to_numpy(), group.column("node").to_numpy()
    component, side = group.column("component").to_numpy(), group.column("side").to_numpy()
    points = _counts(value, at, BITS), _counts(value, at, FINER)

    def similar(a: int, b: int) -> bool:
        u, v = value[at[a] : at[a + 1]], value[at[b] : at[b + 1]]
        if len(u) > len(v):
            u, v = v, u
        common = int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum())
        return den * common >= num * (len(u) + len(v) - common)

    edges: tuple[list, list, list] = ([], [], [])
    cuts = np.append(np.flatnonzero(np.append(True, family[1:] != family[:-1])), len(family))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        _family(np.arange(a, b), np.diff(at), points, similar, node, component, side, num, den, edges)
    return pa.table(
        [pa.array(edges[0], pa.int64()), pa.array(edges[1], pa.int64()), pa.array(edges[2], pa.bool_())], names=["a", "b", "head"]
    )


def _family(rows, sizes, counts, similar, node, component, side, num, den, edges) -> None:  # noqa: ANN001
    """Adds the links of one family to ``edges``: pairs that the points of both kinds let through and ``similar`` confirms."""
    rows = rows[np.lexsort((counts[0][rows].argmax(axis=1), sizes[rows]))]  # packed by size first
    size, points, finer, names = sizes[rows], counts[0][rows], counts[1][rows].astype(np.uint16), node[rows]
    up = {x: x for x in {*component[rows].tolist()}}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    boxes = np.arange(0, len(rows), BOX)
    most = np.maximum.reduceat(points, boxes, axis=0)
    least_size = np.minimum.reduceat(size, boxes)
    largest = np.maximum.reduceat(size, boxes)
    two = len(np.unique(side[rows])) > 1
    weight = np.zeros(len(rows), dtype=np.int64)
    own = component[rows]
    for i in range(len(boxes)):
        bound = np.minimum(most[i], most[i:]).sum(axis=1)
        # intersection >= num / den * union, so (num + den) * intersection >= num * (sum of sizes)
        near = (num + den) * bound >= num * (least_size[i] + least_size[i:])
        near &= largest[i] * den >= num * least_size[i:]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        x = np.arange(boxes[i], min(boxes[i] + BOX, len(rows)))
        for j in (np.flatnonzero(near) + i).tolist():
            y = np.arange(boxes[j], min(boxes[j] + BOX, len(rows)))
            shared = np.minimum(points[x][:, None, :], points[y][None, :, :]).sum(axis=2)
            good = (num + den) * shared >= num * (size[x][:, None] + size[y][None, :])
            good &= names[x][:, None] != names[y][None, :]
            if i == j:
                good &= x[:, None] < y[None, :]
            if two:
                good &= side[rows[x]][:, None] != side[rows[y]][None, :]
            p, q = np.nonzero(good)
            if len(p):
                found.append((x[p], y[q], shared[p, q]))
                np.add.at(weight, x[p], shared[p, q])
                np.add.at(weight, y[q], shared[p, q])
        if not found:
            continue
        first, second, shared = (np.concatenate(c) for c in zip(*found, strict=True))
        for at in range(0, len(first), PAIRS):
            p, q = first[at : at + PAIRS], second[at : at + PAIRS]
            shared[at : at + PAIRS] = np.minimum(finer[p], finer[q]).sum(axis=1, dtype=np.int64)
        good = (num + den) * shared >= num * (size[first] + size[second])
        first, second, shared = first[good], second[good], shared[good]
        share = shared / (size[first] + size[second])
        for pair in np.lexsort((names[second], names[first], -share)).tolist():  # the likeliest links first
            a, b = int(first[pair]), int(second[pair])
            ra, rb = root(int(own[a])), root(int(own[b]))
            if ra == rb:
                continue
            if similar(int(rows[a]), int(rows[b])):
                up[max(ra, rb)] = min(ra, rb)
                edges[0].append(int(names[a]))
                edges[1].append(int(names[b]))
                edges[2].append(False)
    if not two:
        best: dict[int, tuple[int, int]] = {}
        for i in range(len(rows)):
            r = root(int(component[rows[i]]))
            best[r] = max(best.get(r, (-1, 0)), (int(weight[i]), -int(names[i])))
        for _, name in best.values():
            edges[0].append(-name)
            edges[1].append(-name)
            edges[2].append(True)


def near_duplicates(docs: DataFrame, scratch: Scratch, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, node and component_id (smallest doc_id of the component) of every row."""
    seed = 0
    while True:
        rows = scratch.keep(nodes(docs, k, seed))
        sets = scratch.keep(
            rows.filter("n > 0").groupBy("node").agg(
                F.min("n").alias("n"), F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "text_key")).alias("source"),
                F.min("check").alias("x"), F.max("check").alias("y"),
            )
        )
        if not sets.filter("x <> y").take(1):
            break
        seed += 1
    families = components(shared_groups(docs, k, num, den, seed), scratch)
    scratch.sweep()
    roots = families.select(F.col("root").alias("node"), "root").distinct()
    members = families.unionByName(roots).select("node", F.col("root").alias("family")).join(sets.select("node", "n"), "node")
    members = scratch.keep(_leaves(members.select("family", "node", "n")))
    texts = scratch.keep(_texts_of(docs, sets.join(members.select("node"), "node")), "zstd")
    scratch.sweep()

    def links(placed: DataFrame) -> DataFrame:
        some = placed.select("leaf", "family", "node", "component", "side").join(texts, "node")
        return some.groupBy("leaf").applyInArrow(lambda g: _link(g, k, num, den, seed), LINKS)

    def single(placed: DataFrame) -> DataFrame:
        return placed.withColumn("component", F.col("node")).withColumn("side", F.lit(0))

    edges = scratch.keep(links(single(members)))
    scratch.sweep()
    linked = edges.filter("NOT head").select("a", "b")
    # Families of several leaves: their components' heads are compared, again in leaves.
    spread = members.groupBy("family").agg(F.countDistinct("leaf").alias("leaves")).filter("leaves > 1").select("family")
    heads, before = edges.filter("head").select(F.col("a").alias("node")).join(members, "node").join(spread, "family"), None
    while True:
        heads = scratch.keep(_leaves(heads.select("family", "node", "n")))
        count = heads.count()
        if not count or before is not None and count >= before:
            break
        before = count
        edges = scratch.keep(links(single(heads)))
        scratch.sweep()
        linked = linked.unionByName(edges.filter("NOT head").select("a", "b"))
        heads = edges.filter("head").select(F.col("a").alias("node")).join(heads.drop("leaf"), "node")
    joined = components(linked, scratch)
    if before is not None:
        placed = members.join(spread, "family").drop("leaf").join(joined, "node", "left")
        placed = placed.select("family", "node", "n", F.coalesce("root", "node").alias("component"))
        placed = _still_near(scratch.keep(placed), texts, scratch, k, num, den, seed)
        tiles = _tiles(placed, scratch, num, den, "component")
        more = links(tiles).filter("NOT head").select("a", "b")
        joined = components(linked.unionByName(scratch.keep(more)), scratch)
    scratch.sweep()
    root = F.coalesce("root", "node")
    least = sets.join(joined, "node", "left").groupBy(root.alias("root")).agg(F.min("doc_id").alias("component_id"))
    named = sets.select("node").join(joined, "node", "left").select("node", root.alias("root")).join(least, "root")
    return rows.join(named.select("node", "root", "component_id"), "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "text_key", F.col("root").alias("component"),
    )


def one_of_each(docs: DataFrame, scratch: Scratch, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, of each component only that of the smallest doc_id (then of the smallest
    text hash, and one of repeated rows); rows without shingles all stay."""
    found = scratch.keep(near_duplicates(docs, scratch, k, num, den).select("doc_id", "text_key", "component"))
    known = found.filter("component IS NOT NULL").groupBy("component", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("times"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "times")
    first = known.groupBy("component").agg(F.min(order).alias("r")).select("r.doc_id", "r.text_key", (F.col("r.times") > 1).alias("again"))
    bare = found.filter("component IS NULL").select("doc_id", "text_key", F.lit(False).alias("again")).distinct()
    stay = scratch.keep(first.unionByName(bare))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64(F.col("text").cast("string")).alias("t"))
    kept = rows.join(stay, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("text_key")))
    if not stay.filter("again").take(1):
        return kept.select("row.*")
    one = kept.filter("again").groupBy("d", "t").agg(F.first("row").alias("row"))
    return kept.filter("NOT again").select("row").unionByName(one.select("row")).select("row.*")


def _texts_of(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """node and one text of it; the texts are read again, because the sets of all rows are larger."""
    wanted = sets.select("node", F.col("source.doc_id").alias("id"), F.col("source.text_key").alias("key"))
    found = _texts(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")))
    return found.groupBy("node").agg(F.first("text").alias("text"))  # repeated rows come once


def _still_near(placed: DataFrame, texts: DataFrame, scratch: Scratch, k: int, num: int, den: int, seed: int) -> DataFrame:
    """The members (family, node, n, component) whose component may link with another by the bound of their finest
    points, with such components as their families. Points are compared in tiles first, because a text is many times as long."""

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                value, at = sets_of(words_of(part.column("text"), BLANK, lower=True), k, seed)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(_fine_points(value, at), pa.binary())], names=["node", "point"])

    def near(group: pa.Table) -> pa.Table:
        group = group.sort_by([("family", "ascending"), ("node", "ascending"), ("side", "ascending")])
        family, node, component, side, size = (group.column(c).to_numpy() for c in ("family", "node", "component", "side", "n"))
        finest = [np.frombuffer(p, dtype=np.uint8) for p in group.column("point").to_pylist()]
        counts = tuple(np.stack([_fold(p, 1 << bits) for p in finest]) for bits in (BITS, FINER))

        def similar(a: int, b: int) -> bool:
            groups = min(len(finest[a]), len(finest[b]))
            bound = int(np.minimum(_fold(finest[a], groups), _fold(finest[b], groups)).sum())
            return (num + den) * bound >= num * (int(size[a]) + int(size[b]))

        edges: tuple[list, list, list] = ([], [], [])
        cuts = np.append(np.flatnonzero(np.append(True, family[1:] != family[:-1])), len(family))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            _family(np.arange(a, b), size, counts, similar, node, component, side, num, den, edges)
        of = dict(zip(node.tolist(), component.tolist(), strict=True))
        pairs = [(of[x], of[y]) for x, y, head in zip(*edges, strict=True) if not head]
        return pa.table([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    pointed = scratch.keep(texts.join(placed.select("node"), "node").select("node", "text").mapInArrow(points, "node long, point binary"), "zstd")
    tiles = _tiles(placed, scratch, num, den).join(placed.select("node", "n"), "node").join(pointed, "node")
    linked = components(tiles.groupBy("leaf").applyInArrow(near, "a long, b long"), scratch)
    scratch.sweep()
    families = linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct())
    families = families.select(F.col("node").alias("component"), F.col("root").alias("family"))
    return scratch.keep(placed.drop("family").join(families, "component").select("family", "node", "n", "component"))


def _tiles(members: DataFrame, scratch: Scratch, num: int, den: int, *order: str) -> DataFrame:
    """Pairs of leaves of a family, and leaves, that hold different components of sizes that can link.

    The leaves are packed anew: by ``component``, so that those of one large component are of it alone, or by
    size only, so that few pairs of leaves hold sizes that can link."""
    ends = (F.min("component").alias("first"), F.max("component").alias("last"))
    open_ = members.groupBy("family").agg(*ends).filter("first <> last").select("family")
    placed = scratch.keep(_leaves(members.join(open_, "family"), *order))
    leaves = placed.groupBy("family", "leaf").agg(F.min("n").alias("low"), F.max("n").alias("high"), *ends)
    one, two = leaves.alias("x"), leaves.alias("y")
    pairs = one.join(two, F.col("x.family") == F.col("y.family")).filter(
        "x.leaf <= y.leaf AND NOT (x.first = x.last AND y.first = y.last AND x.first = y.first)"
    )
    pairs = pairs.filter((F.col("x.high") * den >= F.col("y.low") * num) & (F.col("y.high") * den >= F.col("x.low") * num))
    sides = F.when(F.col("x.leaf") == F.col("y.leaf"), F.array(F.struct(F.col("x.leaf").alias("leaf"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("x.leaf").alias("leaf"), F.lit(0).alias("side")), F.struct(F.col("y.leaf").alias("leaf"), F.lit(1).alias("side")))
    )
    pairs = pairs.select(F.col("x.family").alias("family"), F.xxhash64("x.family", "x.leaf", "y.leaf").alias("tile"), F.explode(sides).alias("s"))
    return placed.join(pairs.select("family", "tile", "s.leaf", "s.side"), ["family", "leaf"]).select(
        F.col("tile").alias("leaf"), "family", "node", "component", "side"
    )
