"""Operator 11, source divergence audit: how the terms of a source differ from its language and from other sources.

Terms are runs of ASCII letters and other characters beyond ASCII, with A-Z lower-cased. A language keeps
the terms of at least ``MIN_DOCS`` of its documents; V is their number. Every (lang, source) group and every
language gives each kept term a smoothed share in parts of ``SCALE``, in whole numbers.

The terms that set a source apart most are searched without ranking all. A term with a higher count
in the group, a lower one in the language, and an earlier name stands before another in every ranking by
share difference. So each partition keeps of a group only its skyband: terms that fewer than k others
dominate so. It reads them by name, where only earlier terms can dominate, and holds just the band. Skybands
are merged by the same step, first 16 ways by a hash of the term, then in whole, so that no task sees more of
a group than bands. What is left is ranked exactly.

The difference of two sources is the sum over all V terms. Terms that neither holds add the same every
time, so only kept terms of a source travel, to the pairs of tiles of ``TILE`` sources that its tile
is part of, split by term into buckets. A task compares the sources of two tiles on a block of terms as
one matrix and sends one partial sum for each pair.

Cases: null lang, source or text is empty; each row is a document, repeated ones too; a group without
kept terms has shares by smoothing alone, and all values are 0 where its language keeps no term; equal
values are ranked by name in UTF-8; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerprep.llm.words import _bytes, slices
from ledgerprep.session import Scratch

MIN_DOCS = 30
SCALE = 1_000_000_000
SMOOTHING = 5
TOP = 50
#: Sources compared at once, and kept rows of a bucket of terms.
TILE = 128
BUCKET_ROWS = 2_000_000
#: Rows of counts a task gathers before it sends them on, and bytes of their terms and of text counted at once.
HELD_ROWS = 2_000_000
_HELD_BYTES = 64 << 20
_SLICE_BYTES = 8 << 20
_CELLS = 1 << 20
_BLOCK = 512

_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_COUNTS = "lang string, source string, term string, n long, docs long"
_BAND = "lang string, source string, term string, n long, lang_n long"


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Every term of every text in order, and the row of its text."""
    data, offsets = _bytes(texts)
    inside = _TERM[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True
    first, last = inside & edge[:-1], inside & edge[1:]
    begin = np.flatnonzero(first)
    stops = np.zeros(len(begin) + 1, dtype=np.int64)
    np.cumsum(np.flatnonzero(last) + 1 - begin, out=stops[1:])
    terms = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(stops), pa.py_buffer(_LOWER[data[inside]]))
    return terms, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(begin, offsets)))


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(len(ordered) > 0, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, dtype=np.int64)


class _Held:
    """Counts a task has gathered: terms by number, and n and docs by group and term number (high and low half of ``key``)."""

    def __init__(self) -> None:
        self.groups: dict[tuple, int] = {}
        self.terms = pa.array([], pa.large_string())
        self.key, self.n, self.docs = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, part: pa.RecordBatch) -> None:
        terms, row = terms_of(part.column("text"))
        pairs = zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True)
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in pairs], dtype=np.int64) << 32
        coded = terms.dictionary_encode()
        known = pc.index_in(coded.dictionary, value_set=self.terms)
        fresh = coded.dictionary.filter(known.is_null())
        number = known.fill_null(-1).to_numpy().astype(np.int64)
        number[number < 0] = len(self.terms) + np.arange(len(fresh))
        self.terms = pa.concat_arrays([self.terms, fresh])
        index = coded.indices.to_numpy()
        size = max(1, len(number))
        each = np.sort(row * size + index)  # once for each document
        each = each[_runs(each)]
        of_docs = np.sort(group[each // size] + number[each % size])
        of_all = np.sort(group[row] + number[index])
        at = _runs(of_all)
        n, docs = np.diff(np.append(at, len(of_all))), np.diff(np.append(_runs(of_docs), len(of_docs)))
        key = np.append(self.key, of_all[at])
        order = np.argsort(key, kind="stable")  # two sorted runs
        key = key[order]
        at = _runs(key)
        self.key = key[at]
        if len(at):
            self.n, self.docs = (np.add.reduceat(np.append(x, y)[order], at) for x, y in ((self.n, n), (self.docs, docs)))

    def batches(self) -> Iterator[pa.RecordBatch]:
        langs, sources = (pa.array([g[i] for g in self.groups], pa.string()) for i in (0, 1))
        for at in range(0, len(self.key), 50_000):
            some = slice(at, at + 50_000)
            group, term = pa.array(self.key[some] >> 32), pa.array(self.key[some] & 0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays(
                [langs.take(group), sources.take(group), self.terms.take(term).cast(pa.string()), pa.array(self.n[some]), pa.array(self.docs[some])],
                names=["lang", "source", "term", "n", "docs"],
            )


def counts(docs: DataFrame, held_rows: int = HELD_ROWS) -> DataFrame:
    """Occurrences and documents of the terms of every (lang, source), added up as far as a task can hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            for part in slices(batch, "text", _SLICE_BYTES):
                held.add(part)
                if max(len(held.key), len(held.groups)) > held_rows or held.terms.nbytes > _HELD_BYTES:
                    yield from held.batches()
                    held = _Held()
        yield from held.batches()

    return docs.select("lang", "source", "text").mapInArrow(run, _COUNTS)


def skyband(rows: DataFrame, k: int) -> DataFrame:
    """Of each partition and (lang, source): terms that fewer than ``k`` others of it dominate.

    ``rows`` has lang, source, term, n and lang_n. A term dominates one with a later name, no higher n
    and no lower lang_n; what dominates a dominator dominates too, so the band alone decides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, lang_n = None, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            here, there = batch.column("n").to_numpy(), batch.column("lang_n").to_numpy()
            group = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
            cuts = [i for i in range(len(group)) if not i or group[i] != group[i - 1]] + [len(group)]
            keep = np.zeros(len(group), dtype=bool)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if group[a] != last:
                    last, n, lang_n = group[a], n[:0], lang_n[:0]
                for at in range(a, b, _BLOCK):
                    x, y = here[at : min(b, at + _BLOCK)], there[at : min(b, at + _BLOCK)]
                    before = ((n[:, None] >= x) & (lang_n[:, None] <= y)).sum(axis=0)
                    among = np.triu((x[:, None] >= x) & (y[:, None] <= y), 1).sum(axis=0)
                    stay = before + among < k
                    keep[at : at + len(x)] = stay
                    n, lang_n = np.append(n, x[stay]), np.append(lang_n, y[stay])
            if keep.any():
                yield batch.filter(pa.array(keep))

    return rows.sortWithinPartitions("lang", "source", "term").mapInArrow(run, _BAND)


def _share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTHING) / (total + SMOOTHING * v)), exact; null where v is 0."""
    whole = lambda c: c.cast("decimal(19,0)")
    parts = F.lit(SCALE).cast("decimal(10,0)") * whole(n + SMOOTHING)
    return F.call_function("div", parts, whole(F.nullif(total + SMOOTHING * v, F.lit(0)))) + 1


class Audit:
    """Counts of a table of documents, from which both parts of the audit are made.

    ``kept``: lang, source, term, n and lang_n of every kept term a group holds. ``groups``: lang,
    source, its number ``at`` in the language, how many ``sources`` that has, v, total and lang_total, and
    the share ``base`` of a term it does not hold."""

    def __init__(self, docs: DataFrame, scratch: Scratch, min_docs: int = MIN_DOCS, tile: int = TILE, bucket_rows: int = BUCKET_ROWS, held_rows: int = HELD_ROWS):
        self.tile, self.bucket_rows = tile, bucket_rows
        texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
        each = counts(texts, held_rows).repartition("lang", "term").groupBy("lang", "source", "term")
        term = Window.partitionBy("lang", "term")
        each = each.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        each = each.withColumn("lang_n", F.sum("n").over(term)).withColumn("lang_docs", F.sum("docs").over(term))
        each = each.withColumn("leads", F.row_number().over(term.orderBy("source")) == 1)
        self.kept = scratch.keep(each.filter(F.col("lang_docs") >= min_docs).drop("docs", "lang_docs"))
        totals = self.kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("leads").alias("leads"))
        langs = totals.groupBy("lang").agg(F.sum("leads").alias("v"), F.sum("total").alias("lang_total"))
        groups = texts.select("lang", "source").distinct().join(langs, "lang", "left").join(totals.drop("leads"), ["lang", "source"], "left")
        of = Window.partitionBy("lang")
        self.groups = scratch.keep(
            groups.fillna(0, ["v", "lang_total", "total"])
            .withColumn("at", F.row_number().over(of.orderBy("source")) - 1)
            .withColumn("sources", F.count(F.lit(1)).over(of))
            .withColumn("base", F.coalesce(_share(F.lit(0), F.col("total"), F.col("v")), F.lit(0)))
        )

    def top_terms(self, k: int = TOP) -> DataFrame:
        """lang, source, item, value and rank of the ``k`` terms a source favours most against its language."""
        band = skyband(self.kept.select("lang", "source", "term", "n", "lang_n"), k)
        band = skyband(band.repartition("lang", "source", F.pmod(F.xxhash64("term"), F.lit(16))), k)
        band = skyband(band.repartition("lang", "source"), k)
        shares = band.join(self.groups, ["lang", "source"])
        value = _share(F.col("n"), F.col("total"), F.col("v")) - _share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
        found = shares.select("lang", "source", F.col("term").alias("item"), value.alias("value")).filter("value > 0")
        return _ranked(found).filter(F.col("rank") <= k)

    def pairs(self) -> DataFrame:
        """lang, source, item, value and rank: every other source of the language, the most different first."""
        buckets = max(self.kept.sparkSession.sparkContext.defaultParallelism, -(-self.kept.count() // self.bucket_rows))
        tiles = F.explode(F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / self.tile).cast("int")))
        own = F.floor(F.col("at") / self.tile).cast("int")

        def dealt(rows: DataFrame) -> DataFrame:
            both = rows.withColumn("other", tiles).withColumn("own", own)
            return both.select("lang", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "bucket", "term", "at", "p")

        held = self.kept.join(self.groups, ["lang", "source"]).select(
            "lang", "sources", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"), "term", "at",
            _share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
        )
        bases = self.groups.select(
            "lang", "sources", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"),
            F.lit(None).cast("string").alias("term"), "at", F.col("base").alias("p"),
        )
        cells = dealt(held).unionByName(dealt(bases)).groupBy("lang", "a", "b", "bucket")
        apart = cells.applyInArrow(_differences(self.tile), "lang string, i int, j int, apart long").groupBy("lang", "i", "j").agg(F.sum("apart").alias("apart"))
        side = lambda name, to: self.groups.select("lang", "v", F.col("at").alias(name), F.col("source").alias(to), F.col("base").alias(f"base_{name}"))
        both = apart.join(side("i", "source"), ["lang", "i"]).join(side("j", "item").drop("v"), ["lang", "j"])
        value = F.col("apart") + F.col("v") * F.abs(F.col("base_i") - F.col("base_j"))
        found = both.select("lang", value.alias("value"), F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("pair"))
        return _ranked(found.select("lang", "pair.source", "pair.item", "value"))


def _ranked(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return found.withColumn("rank", F.row_number().over(order))


def _differences(tile: int) -> Callable[[pa.Table], pa.Table]:
    """Sums of share differences of the sources of two tiles on the terms of a bucket, less what these terms
    would add if no source held them."""

    def run(rows: pa.Table) -> pa.Table:
        lang, a, b = (rows.column(c)[0].as_py() for c in ("lang", "a", "b"))
        term = rows.column("term").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        at, p = (rows.column(c).to_numpy() for c in ("at", "p"))
        head = np.flatnonzero(term < 0)
        head = head[np.unique(at[head], return_index=True)[1]]
        sources, base = at[head], p[head]
        body = np.flatnonzero(term >= 0)
        order = body[np.argsort(term[body], kind="stable")]
        _, line = np.unique(term[order], return_inverse=True)
        column, value = np.searchsorted(sources, at[order]), p[order]
        count = int(line[-1]) + 1 if len(line) else 0
        mine, theirs = (np.flatnonzero(sources // tile == t) for t in (a, b))
        apart = np.zeros((len(mine), len(theirs)), dtype=np.int64)
        step = max(1, _CELLS // max(1, len(sources)))
        for low in range(0, count, step):
            high = min(count, low + step)
            some = slice(*np.searchsorted(line, [low, high]))
            shares = np.tile(base, (high - low, 1))
            shares[line[some] - low, column[some]] = value[some]
            right = np.ascontiguousarray(shares[:, theirs])
            for i, m in enumerate(mine):
                apart[i] += np.abs(right - shares[:, m : m + 1]).sum(axis=0)
        apart -= count * np.abs(base[mine][:, None] - base[theirs])
        i, j = (x.ravel() for x in np.meshgrid(sources[mine], sources[theirs], indexing="ij"))
        once = i < j
        return pa.table(
            {"lang": pa.array([lang] * int(once.sum()), pa.string()), "i": pa.array(i[once], pa.int32()), "j": pa.array(j[once], pa.int32()), "apart": apart.ravel()[once]}
        )

    return run
