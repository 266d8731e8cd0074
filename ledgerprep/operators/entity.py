"""Finding rows that describe the same business partner.

1. Rows with one tax key are duplicates of the first of them.
2. The others are blocked; within a block equal names collapse into one.
3. Names are clustered by a greedy rule: in row order, a name not yet absorbed leads a group
   and absorbs all later similar names of its block.

A block of bounded size is settled by one task in one pass over its names. A larger one is first split
into its connected components: tasks compare two parts of it each and send on only links that connect
something new. A component is settled like a small block; one that is too large as well is settled
from its first names on, whose leaders absorb all later ones before the next names are looked at.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerprep.functions.closeness import ROWS, Names
from ledgerprep.functions.text import is_blank, matching_tax_key, strip, strip_legal_form
from ledgerprep.operators.candidates import PART_NAMES, links, near_pairs, with_parts
from ledgerprep.operators.components import components
from ledgerprep.operators.ordered import place, running_sum
from ledgerprep.session import Scratch, cut

BLOCKING = ("none", "first_char", "first_3_chars", "postal_code_2", "province")
THRESHOLD = 85.0
_EMPTY_BLOCK = "_empty_"


def _name_prefix(clean: Column, letters: int) -> Column:
    return F.when(clean == "", F.lit(_EMPTY_BLOCK)).otherwise(F.substring(clean, 1, letters))


def block_key(
    clean: Column, blocking: str, postal: Column | None = None, province: Column | None = None
) -> Column:
    """Key of the group of names a name is compared with."""
    by_name = _name_prefix(clean, 3)
    if blocking == "none":
        return F.lit("_all_")
    if blocking == "first_char":
        return _name_prefix(clean, 1)
    if blocking == "postal_code_2" and postal is not None:
        digits = F.regexp_replace(postal.cast("string"), "[^0-9]", "")
        padded = F.when(F.length(digits) < 5, F.lpad(digits, 5, "0")).otherwise(digits)
        return F.when(~is_blank(postal) & (digits != ""), F.substring(padded, 1, 2)).otherwise(by_name)
    if blocking == "province" and province is not None:
        name = F.upper(strip(F.coalesce(province.cast("string"), F.lit("nan"))))
        return F.when(~name.isin("", "-"), name).otherwise(by_name)
    return by_name


def matching_rows(
    df: DataFrame,
    row_id: str,
    name: str,
    tax_id: str | None = None,
    postal: str | None = None,
    province: str | None = None,
    blocking: str = "first_3_chars",
) -> DataFrame:
    """The few columns matching needs: row, value, tax key, stripped name (null if blank),
    name without legal form and block."""

    def col(c: str | None) -> Column | None:
        return F.col(f"`{c}`") if c is not None and c in df.columns else None

    text = F.col(f"`{name}`").cast("string")
    tax = col(tax_id)
    rows = df.select(
        F.col(row_id).cast("long").alias("row_id"),
        F.coalesce(text, F.lit("-")).alias("value"),
        (matching_tax_key(tax) if tax is not None else F.lit(None).cast("string")).alias("tax_key"),
        F.when(~is_blank(text), strip(text)).alias("name_key"),
        F.when(~is_blank(text), strip_legal_form(text)).alias("name"),
        *[c.alias(alias) for c, alias in ((col(postal), "_postal"), (col(province), "_province")) if c is not None],
    )
    here = [F.col(c) if c in rows.columns else None for c in ("_postal", "_province")]
    block = F.when(F.col("name").isNotNull(), block_key(F.col("name"), blocking.lower(), *here))
    return rows.withColumn("block", block).drop("_postal", "_province")


def exact_key_groups(rows: DataFrame) -> DataFrame:
    """Rows with ``key_rep``: the first row with their tax key (themselves without duplicates).

    The first row per key is a pre-aggregated minimum, and the join back has one row per key
    on its right, so a key held by a third of all rows is split, not gathered."""
    first = (
        rows.where(F.col("tax_key").isNotNull())
        .groupBy("tax_key")
        .agg(F.min("row_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    return (
        rows.join(first, "tax_key", "left")
        .withColumn("key_rep", F.coalesce("_first", "row_id"))
        .drop("_first")
    )


def collapse_names(keyed: DataFrame) -> DataFrame:
    """One row per block and name of the rows that are first of their key: first row, count."""
    return (
        keyed.where((F.col("row_id") == F.col("key_rep")) & F.col("name_key").isNotNull())
        .groupBy("block", "name_key", "name")
        .agg(F.min("row_id").alias("rep"), F.count(F.lit(1)).alias("rows"))
    )


def block_sizes(keyed: DataFrame) -> DataFrame:
    """Rows and distinct names per block."""
    return collapse_names(keyed).groupBy("block").agg(
        F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("names")
    )


def _vertices(names: DataFrame) -> DataFrame:
    """Names that differ without their legal form. Equal ones have the same neighbours, so the
    first stands for all; an empty one is similar to nothing and is left out."""
    return (
        names.where(F.col("name") != "")
        .groupBy("block", "name")
        .agg(F.min("rep").alias("vid"))
    )


def fuzzy_pairs(
    names: DataFrame, threshold: float = THRESHOLD, scorer: str = "indel", part_names: int = PART_NAMES
) -> DataFrame:
    """All pairs of collapsed names of one block that reach the threshold: a, b and their score."""
    return near_pairs(with_parts(cut(_vertices(names)), part_names), threshold, scorer)


def _within_reach(vertices: DataFrame, threshold: float) -> DataFrame:
    """The names some other name of their block can be near to, by length alone.

    Two different names of n letters in all have n - 1 in common at most, so they score no more than
    100 - 100 / n; the longest name of the block bounds n. At a threshold of 100 none are left."""
    size = F.length("name")
    longest = vertices.groupBy("block").agg(F.max(size).alias("_longest"))
    least = F.lit(100.0 - 0.01)  # a little less than 100, so that rounding leaves out none
    reach = (size + F.col("_longest")) * F.lit(100.0 - float(threshold)) >= least
    return vertices.join(longest, "block").where(reach).drop("_longest")


_TAKEN = "vid long, leader long, score double"


def _settle(units: DataFrame, threshold: float, scorer: str) -> DataFrame:
    """The greedy rule in each unit (block, root) of a bounded number of names: names that are led, by whom,
    and the score."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vid")
        vid = rows.column("vid").to_numpy()
        leader, score = Names(rows.column("name").to_pylist(), threshold, scorer).led()
        led = leader != np.arange(len(vid))
        return pa.table({"vid": vid[led], "leader": vid[leader[led]], "score": score[led]})

    return units.select("block", "root", "vid", "name").groupBy("block", "root").applyInArrow(run, _TAKEN)


def _absorb(leaders: DataFrame, later: DataFrame, threshold: float, scorer: str) -> DataFrame:
    """Of the ``later`` names of each unit, dealt into parts, those near to a leader, with the first such."""
    columns = ["block", "root", "part", "vid", "name"]
    parts = later.select("block", "root", "part").distinct()
    both = later.select(*columns, F.lit(False).alias("leads")).unionByName(
        leaders.drop("part").join(parts, ["block", "root"]).select(*columns, F.lit(True).alias("leads"))
    )

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vid")
        vid, leads = rows.column("vid").to_numpy(), rows.column("leads").to_numpy()
        texts = Names(rows.column("name").to_pylist(), threshold, scorer)
        first, others = np.flatnonzero(leads), np.flatnonzero(~leads)
        found = [texts.first_near(first, others[at : at + ROWS]) for at in range(0, len(others), ROWS)]
        row, leader, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (others, others, others * 0.0)
        return pa.table({"vid": vid[row], "leader": vid[leader], "score": score})

    return both.groupBy("block", "root", "part").applyInArrow(run, _TAKEN)


def _settle_large(left: DataFrame, threshold: float, scorer: str, part_names: int) -> list[DataFrame]:
    """The greedy rule in units too large for a task. Each round settles the first names of every unit, whose
    leaders then absorb all later names near to them, part by part; a crowd of near copies is done in one."""
    order, unit = [F.asc("vid")], ["block", "root"]
    done: list[DataFrame] = []
    while not left.isEmpty():
        placed = running_sum(place(left, order, by=unit), F.lit(1), order, "pos", by=unit)
        parted = cut(placed.withColumn("part", F.floor((F.col("pos") - 1) / part_names)).drop("pos"))
        head, later = parted.where("part = 0"), parted.where("part > 0")
        taken = cut(_settle(head, threshold, scorer))
        hits = cut(_absorb(head.join(taken, "vid", "left_anti"), later, threshold, scorer))
        done += [taken, hits]
        left = cut(later.join(hits, "vid", "left_anti").drop("part"))
    return done


def leader_clusters(
    names: DataFrame, threshold: float = THRESHOLD, scorer: str = "indel", part_names: int = PART_NAMES
) -> DataFrame:
    """Collapsed names with the name row that leads them (``leader``) and the score to it.

    A unit is a set of names that no near pair leaves: a block, or where a task cannot hold that, a
    connected part of it. A task settles a unit in one pass over its names. The driver reads the number of
    names of the largest block, and whether a connected part is larger than a task holds. Names too short
    for any different one to be near to them lead themselves and are not compared."""
    vertices = cut(_vertices(names))
    blocks = cut(_within_reach(vertices, threshold).withColumn("root", F.lit(-1).cast("long")))
    largest = blocks.groupBy("block").count().agg(F.max("count")).first()[0] or 0
    if largest <= part_names:
        parts = [_settle(blocks, threshold, scorer)]
    else:
        blocks = cut(with_parts(blocks, part_names))
        parts = [_settle(blocks.where("parts = 1"), threshold, scorer)]
        crowded = blocks.where("parts > 1")
        scratch = Scratch(names.sparkSession)
        linked = components(links(crowded, threshold, scorer), scratch)
        # Names without a near one lead themselves and are in no unit.
        roots = linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct())
        units = cut(crowded.select("block", "vid", "name").join(roots.withColumnRenamed("node", "vid"), "vid"))
        scratch.drop()
        sizes = units.groupBy("block", "root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part_names).drop("n")
        parts.append(_settle(units.join(sizes, ["block", "root"], "left_anti"), threshold, scorer))
        parts += _settle_large(units.join(sizes, ["block", "root"], "left_semi"), threshold, scorer, part_names)
    taken = reduce(DataFrame.unionByName, parts).withColumnRenamed("score", "_score")
    led = vertices.select("block", "name", "vid").join(taken, "vid", "left")
    return (
        names.join(led, ["block", "name"], "left")
        .select(
            "block",
            "name_key",
            "rep",
            "rows",
            F.coalesce("leader", "vid", "rep").alias("leader"),
            F.coalesce("_score", F.lit(100.0)).alias("score"),
        )
    )


def find_duplicates(
    df: DataFrame,
    row_id: str,
    name: str,
    tax_id: str | None = None,
    postal: str | None = None,
    province: str | None = None,
    threshold: float = THRESHOLD,
    blocking: str = "first_3_chars",
    scorer: str = "indel",
    part_names: int = PART_NAMES,
) -> DataFrame:
    """Members of all groups of two or more rows, one row per member.

    ``group_id`` is the row that represents the group; ``match_type`` is primary, fuzzy or
    tax_id; ``rank_key`` orders the members as they joined the group (a sortable struct, since
    numbering them would gather a group in one task). ``row_id`` must be a stable number.
    """
    keyed = cut(
        exact_key_groups(matching_rows(df, row_id, name, tax_id, postal, province, blocking))
    )
    clusters = leader_clusters(collapse_names(keyed), threshold, scorer, part_names)
    first = F.col("row_id") == F.col("key_rep")
    columns = ["row_id", "value", "rep", "leader", "score"]
    named = keyed.where(first & F.col("name_key").isNotNull()).join(
        clusters, ["block", "name_key"]
    ).select(*columns)
    unnamed = keyed.where(first & F.col("name_key").isNull()).select(
        "row_id", "value", F.col("row_id").alias("rep"), F.col("row_id").alias("leader"),
        F.lit(100.0).alias("score"),
    )
    base = cut(named.unionByName(unnamed))
    own = F.col("rep") == F.col("leader")
    zero = F.lit(0).cast("long")

    def rank(section: Column, via: Column, kind: int, anchor: Column, row: Column) -> Column:
        return F.struct(
            section.alias("section"), via.alias("via"), F.lit(kind).alias("kind"),
            anchor.alias("anchor"), row.alias("row"),
        ).alias("rank_key")

    direct = base.select(
        F.col("leader").alias("group_id"),
        "row_id",
        F.when(own, "primary").otherwise("fuzzy").alias("match_type"),
        "score",
        "value",
        rank(F.when(own, 0).otherwise(2), F.when(own, zero).otherwise(F.col("rep")), 0, zero, F.col("row_id")),
    )
    by_key = (
        keyed.where(~first)
        .alias("d")
        .join(base.alias("b"), F.col("d.key_rep") == F.col("b.row_id"))
        .select(
            F.col("b.leader").alias("group_id"),
            F.col("d.row_id").alias("row_id"),
            F.lit("tax_id").alias("match_type"),
            F.lit(100.0).alias("score"),
            F.col("d.value").alias("value"),
            rank(
                F.when(F.col("b.rep") == F.col("b.leader"), 1).otherwise(2),
                F.when(F.col("b.rep") == F.col("b.leader"), zero).otherwise(F.col("b.rep")),
                1,
                F.col("d.key_rep"),
                F.col("d.row_id"),
            ),
        )
    )
    members = direct.unionByName(by_key)
    real = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return members.join(real.select("group_id"), "group_id", "left_semi")


def duplicate_summary(members: DataFrame) -> DataFrame:
    """One row: groups, and records affected (one per group plus one per match, where a fuzzy
    match is one name and a tax match one row)."""
    kind = F.col("match_type")
    matches = members.where(kind == "tax_id").select("group_id", "row_id")
    fuzzy = (
        members.where(kind == "fuzzy")
        .select("group_id", F.col("rank_key.via").alias("row_id"))
        .distinct()
    )
    groups = members.where(F.col("row_id") == F.col("group_id"))
    counted = (
        matches.unionByName(fuzzy)
        .select(F.lit(0).alias("groups"), F.lit(1).alias("records"))
        .unionByName(groups.select(F.lit(1).alias("groups"), F.lit(1).alias("records")))
    )
    return counted.agg(
        F.coalesce(F.sum("groups"), F.lit(0)).alias("duplicate_groups"),
        F.coalesce(F.sum("records"), F.lit(0)).alias("records_affected"),
    )
