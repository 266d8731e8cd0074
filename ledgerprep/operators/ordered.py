"""Running totals and positions over a global order, without a single-task window.

Rows are range-partitioned by the order, each partition is totalled, the totals of the
partitions before it are added to a window that never leaves its partition. The ranges are
cut by composite keys, so a value that a third of the rows share is spread as long as the
tie-break differs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerprep.session import cut

SLICE = "_SLICE"


def place(df: DataFrame, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """Range-partition ``df`` by ``by`` and ``order`` and fix the result in the checkpoint folder.

    Range bounds are sampled, so the numbers of the slices hold only for one evaluation; the
    cut makes all later readers see the same one, also after an executor is lost."""
    ranges = df.repartitionByRange(*[F.col(c) for c in by], *order)
    return cut(ranges.withColumn(SLICE, F.spark_partition_id()))


def running_sum(
    placed: DataFrame,
    value: Column,
    order: Sequence[Column],
    total: str,
    by: Sequence[str] = (),
) -> DataFrame:
    """Add ``total``: the sum of ``value`` over the rows up to this one in ``order``.

    ``placed`` comes from ``place`` with the same total order. With ``by`` every group has a
    running sum of its own; a large group simply spans many slices.
    """
    slices = placed.groupBy(*by, SLICE).agg(F.sum(value).alias("_HERE"))
    # One row per slice a group touches: at most slices + groups rows, not the rows themselves.
    earlier = (
        Window.partitionBy(*(by or [F.lit(0)]))
        .orderBy(SLICE)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = slices.select(
        *by, SLICE, (F.sum("_HERE").over(earlier) - F.col("_HERE")).alias("_BEFORE")
    )
    inside = (
        Window.partitionBy(*by, SLICE)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        placed.withColumn("_RUN", F.sum(value).over(inside))
        .join(before, [*by, SLICE])
        .withColumn(total, F.col("_RUN") + F.col("_BEFORE"))
        .drop("_RUN", "_BEFORE", SLICE)
    )
