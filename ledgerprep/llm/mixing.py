"""Operator 7, mixing sources to target weights by pivotal dependent rounding.

A source with a target of p times its words gives every document p copies: floor(p) for sure, and
the fraction by rounding. Two documents with open fractions form a pair: words move from one to
the other until one fraction is 0 or 1, in the direction that chance picks so that no expectation
changes. The words of the pair stay the same, so a source misses its target by less than one
document. Pairs are formed inside blocks of about ``BLOCK`` documents, each block hands on the one
document that stays open, and the blocks are merged by a tree of the same steps.

All of it is DataFrame and SQL expressions. A hot source is many blocks, spread by a hash.

Cases: a null or empty text has size 0 and is never taken; sources that are null form one source,
the last; rows with equal doc_id and source count as one document, and each of them gets its
copies; a null doc_id is an id like others; other columns are kept; with no words all targets are 0.
The random numbers are hashes of the ids and ``seed``, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerprep.operators.ordered import place, running_sum
from ledgerprep.session import Scratch

BLOCK = 256
#: A document is taken at most so often, and a target is at most so many times its source.
MOST = 3
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(units: DataFrame, scratch: Scratch) -> DataFrame:
    """source, source_size, documents, target: one row for each source of ``units`` (source, size)."""
    sources = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    order = [F.col("source").asc_nulls_last()]
    ranked = running_sum(place(sources, order), F.lit(1), order, "position")
    ranked = scratch.keep(
        ranked.select("source", "source_size", "documents", ((F.col("position") - 1) % 3 + 1).cast("double").alias("weight"))
    )
    cap = F.col("source_size").cast("double") * MOST
    total, weights = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    share, capped = (total / weights if weights else 0.0), -1
    while True:  # what capped sources leave goes to the others; one row comes back each time
        above = F.col("weight") * share > cap
        full, most, open_ = ranked.agg(
            F.count(F.when(above, 1)), F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if full == capped:
            break
        capped = full
        if open_:
            share = (total - (most or 0.0)) / open_
    return ranked.select("source", "source_size", "documents", F.least(cap, F.col("weight") * share).alias("target"))


# One pair: r stays open from before, x comes next. "up" moves words from x to r.
_STEP = """
aggregate(slice(units, 2, size(units)), named_struct('r', units[0], 'done', cast(array() as array<struct<doc_id:{id}, take:int>>)),
  (acc, x) -> transform(array(named_struct(
      'up', least((1 - acc.r.f) * acc.r.s, x.f * x.s), 'down', least(acc.r.f * acc.r.s, (1 - x.f) * x.s),
      'u', shiftrightunsigned(xxhash64(acc.r.doc_id, x.doc_id, source, {seed}), 11) / 9007199254740992D)),
    m -> transform(array(m.u * (m.up + m.down) < m.down), rises ->
      if(if(rises, (1 - acc.r.f) * acc.r.s <= x.f * x.s, acc.r.f * acc.r.s <= (1 - x.f) * x.s),
        named_struct(
          'r', named_struct('h', x.h, 'doc_id', x.doc_id, 's', x.s,
            'f', greatest(0D, least(1D, if(rises, x.f - m.up / x.s, x.f + m.down / x.s)))),
          'done', concat(acc.done, array(named_struct('doc_id', acc.r.doc_id, 'take', if(rises, 1, 0))))),
        named_struct(
          'r', named_struct('h', acc.r.h, 'doc_id', acc.r.doc_id, 's', acc.r.s,
            'f', greatest(0D, least(1D, if(rises, acc.r.f + m.up / acc.r.s, acc.r.f - m.down / acc.r.s)))),
          'done', concat(acc.done, array(named_struct('doc_id', x.doc_id, 'take', if(rises, 0, 1)))))))[0])[0])
"""


def copies(docs: DataFrame, scratch: Scratch, seed: int = 7) -> DataFrame:
    """doc_id, source, source_size, target, copies: one row for each pair of doc_id and source."""
    return copies_of_sized(
        docs.select("doc_id", F.col("source").cast("string"), n_words(F.col("text").cast("string")).alias("size")), scratch, seed
    )


def copies_of_sized(sized: DataFrame, scratch: Scratch, seed: int = 7) -> DataFrame:
    """``copies`` of documents given by doc_id, source and size."""
    units = scratch.keep(sized.groupBy("doc_id", "source").agg(F.sum("size").alias("size")))
    wanted = scratch.keep(targets(units, scratch))
    each = F.when(F.col("size") > 0, F.least(F.lit(float(MOST)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    units = scratch.keep(
        units.alias("u")
        .join(wanted.alias("t"), F.col("u.source").eqNullSafe(F.col("t.source")))
        .select("doc_id", "u.source", "size", "source_size", "target", "documents", each.alias("each"))
        .withColumn("whole", F.floor("each").cast("int"))
        .withColumn("f", F.col("each") - F.col("whole"))
    )
    key = str(sized.schema["doc_id"].dataType.simpleString())
    blocks = F.ceil(F.col("documents") / BLOCK)
    rows = units.filter("size > 0 AND f > 0").select(
        "source", F.pmod(F.xxhash64("doc_id", F.lit(seed)), blocks).alias("block"),
        F.struct(F.xxhash64("doc_id").alias("h"), F.col("doc_id"), F.col("size").cast("double").alias("s"), F.col("f")).alias("unit"),
    )
    done = []
    left = wanted.agg(F.max(blocks)).first()[0] or 1
    while True:
        folded = rows.groupBy("source", "block").agg(F.sort_array(F.collect_list("unit")).alias("units"))
        folded = scratch.keep(folded.select("source", "block", F.expr(_STEP.format(id=key, seed=seed)).alias("out")))
        done.append(folded.select("source", F.explode("out.done").alias("d")).select("source", "d.doc_id", "d.take"))
        if left <= 1:
            break
        left = -(-left // BLOCK)
        rows = folded.select("source", F.floor(F.col("block") / BLOCK).alias("block"), F.col("out.r").alias("unit"))
    chance = F.shiftrightunsigned(F.xxhash64("out.r.doc_id", "source", F.lit(seed + 1)), 11) / F.lit(9007199254740992.0)
    taken = folded.select("source", F.col("out.r.doc_id").alias("doc_id"), (chance < F.col("out.r.f")).cast("int").alias("take"))
    for part in done:
        taken = taken.unionByName(part)
    return (
        units.alias("u")
        .join(taken.alias("d"), same_document("u", "d"), "left")
        .select(
            "u.doc_id", "u.source", "source_size", "target",
            (F.col("whole") + F.coalesce(F.col("take"), F.lit(0))).cast("int").alias("copies"),
        )
    )


def same_document(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def mixed(docs: DataFrame, scratch: Scratch, seed: int = 7) -> DataFrame:
    """Rows of ``docs``, each as often as the mix takes it."""
    times = copies(docs, scratch, seed).filter("copies > 0")
    each = times.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return docs.alias("d").join(scratch.keep(each).alias("t"), same_document("d", "t")).select("d.*")
