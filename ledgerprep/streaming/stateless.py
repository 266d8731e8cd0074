"""The stateless part of a run on a stream of rows.

Cleaning, cross-checks, row rules and quarantine look at one row at a time, so the batch plan
serves as it is. Matching, costing, ABC classes and profiles need the whole table and stay
batch; so does the bill-of-materials rule, which counts the rows of a parent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ledgerprep import fixed_values as fv
from ledgerprep.operators import quarantine
from ledgerprep.plans.cleanse import ROW_ID, Options, judge, presented


def judge_stream(rows: DataFrame, options: Options) -> DataFrame:
    """Rows of a streaming table with verdicts and reject columns."""
    if options.template == fv.BILL_OF_MATERIALS:
        raise ValueError("the bill-of-materials rule needs the whole table")
    if options.row_id is not None:
        rows = rows.withColumn(ROW_ID, rows[options.row_id].cast("long"))
    return presented(judge(rows, options))


def start_cleansing(
    rows: DataFrame, options: Options, folder: str, checkpoint: str
) -> StreamingQuery:
    """Write accepted and rejected rows of a stream to one table partitioned by the verdict.

    One file sink for both keeps each row exactly once, which two sinks could not."""
    return (
        judge_stream(rows, options)
        .writeStream.format("parquet")
        .partitionBy(quarantine.REJECTED)
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
