"""Operator 9, substring dedup by super-k-mer partitioning.

Windows of ``window`` words that share a minimiser travel together as one packed string to a
bucket of that minimiser. There all windows are sorted, and each gets the smallest doc_id that
holds it. Words covered by a window that also starts in a document of a smaller doc_id go.

Cases: a null or empty text has no words; a text of fewer words than a window keeps all; rows
with equal doc_id do not remove from each other; a row with a null doc_id neither loses words
nor takes any from others; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerprep.llm import anchors as A
from ledgerprep.llm.words import BLANK, slices, words_of
from ledgerprep.session import Scratch


def remove_repeats(
    docs: DataFrame, scratch: Scratch, window: int = A.WINDOW, seed: int = A.SEED, bucket: int = A.BUCKET
) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of every row."""
    texts = A.keyed(docs)
    known = A.owned(texts)
    places = A.shared_places(texts, scratch, window, seed, bucket)
    found = A.repeats(known, places, window, lambda table: sorted_windows(table, window))
    spans = found.filter("copy").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("begin", "stop")).alias("spans"))
    judged = known.join(spans.withColumnRenamed("doc_id", "owner"), ["owner", "text_key"], "left")
    judged = judged.select(F.col("owner").alias("doc_id"), F.col("body").alias("text"), "spans")
    rest = texts.filter("doc_id IS NULL").select("doc_id", "text", F.lit(None).cast(judged.schema["spans"].dataType).alias("spans"))
    return judged.unionByName(rest).mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string")


def sorted_windows(table: pa.Table, window: int) -> A.Windows:
    stretch, number, hashed = A.windows_of(table, A.words_packed(table), window)
    return A.Windows(stretch, number, hashed, np.unique(hashed, return_inverse=True)[1])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = words_of(part.column("text"), BLANK)
            counts = np.diff(words.first)
            spans = part.column("spans")
            lengths = spans.fill_null([]).value_lengths().to_numpy(zero_copy_only=False)
            flat = spans.flatten()
            row = np.repeat(np.arange(part.num_rows), lengths)
            change = np.zeros(len(words.hash) + 1, dtype=np.int64)
            np.add.at(change, words.first[row] + flat.field("begin").to_numpy(zero_copy_only=False), 1)
            np.add.at(change, words.first[row] + flat.field("stop").to_numpy(zero_copy_only=False), -1)
            gone = np.cumsum(change[:-1]) > 0
            before = np.append(0, np.cumsum(gone))
            removed = before[words.first[1:]] - before[words.first[:-1]]
            data, kept = words.data.tobytes(), []
            edge = words.offsets.tolist()
            for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                if removed[i] == 0:
                    kept.append(b" ".join(data[edge[i] : edge[i + 1]].split()).decode())  # the same six blanks
                else:
                    stay = np.flatnonzero(~gone[a:b]) + a
                    pairs = zip(words.start[stay].tolist(), words.end[stay].tolist(), strict=True)
                    kept.append(b" ".join([data[x:y] for x, y in pairs]).decode())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts), pa.array(removed), pa.array(kept, type=pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )
