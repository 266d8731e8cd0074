"""Operator 1, dedup by sparse suffix arrays.

Suffixes are retained at minimiser positions only. A passage of ``window`` words that two
documents share contains the same minimiser, so both retain a suffix there. In a bucket of
suffixes with one minimiser the suffixes are sorted, neighbours are compared word by word for
their common length, and so are the words before them, sorted from the minimiser to the left.
Two suffixes match in ``window`` words around the minimiser when the smallest common lengths
between them, to the right and to the left, add up to that; this holds for all suffixes between
which no neighbours differ earlier, so no pair is compared twice and none is missed.

Cases: a null or empty text, and one of fewer words than a window, has no passages; repeats inside
one document alone are none; rows with the same doc_id are one document; a row with a null doc_id
takes no part; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerprep.llm import anchors as A
from ledgerprep.llm.words import Words
from ledgerprep.session import Scratch


def repeated_passages(
    docs: DataFrame, scratch: Scratch, window: int = A.WINDOW, seed: int = A.SEED, bucket: int = A.BUCKET
) -> DataFrame:
    """doc_id, begin, stop, copy: maximal runs of words in windows that several documents hold.

    ``copy`` is false in the document of the smallest doc_id that holds the windows. A document
    with several texts gives the passages of each."""
    texts = A.keyed(docs)
    known = A.owned(texts)
    places = A.shared_places(texts, scratch, window, seed, bucket)
    found = A.repeats(known, places, window, lambda table: suffix_windows(table, window))
    spans = found.groupBy("doc_id", "text_key", "copy").agg(
        F.array_sort(F.collect_list(F.struct(F.col("begin"), F.col("stop")))).alias("spans")
    )
    merged = F.aggregate(
        "spans", F.slice("spans", 1, 1),
        lambda out, s: F.when(
            s["begin"] <= F.element_at(out, -1)["stop"],
            F.concat(
                F.slice(out, 1, F.size(out) - 1),
                F.array(
                    F.struct(
                        F.element_at(out, -1)["begin"].alias("begin"),
                        F.greatest(F.element_at(out, -1)["stop"], s["stop"]).alias("stop"),
                    )
                ),
            ),
        ).otherwise(F.concat(out, F.array(s))),
    )
    return spans.select("doc_id", "copy", F.explode(merged).alias("s")).select("doc_id", "s.begin", "s.stop", "copy")


def suffix_windows(table: pa.Table, window: int) -> A.Windows:
    """Equal windows of the stretches of a batch of buckets, by suffixes to the right and to the left."""
    words = A.words_packed(table)
    stretch, number, hashed = A.windows_of(table, words, window)
    _, distance, _ = A.opened(table.column("place").to_numpy())
    bucket = np.unique(table.column("bucket").to_numpy(), return_inverse=True)[1]
    at = words.first[:-1] + distance
    span = int(distance.max(initial=0))
    right = _common(words, bucket, at, words.first[1:], 1, window)
    left = _common(words, bucket, at - 1, words.first[:-1] - 1, -1, span)
    before = distance[stretch] - number  # words of the window that stand before the suffix
    group = np.empty(len(stretch), dtype=np.int64)
    groups = 0
    for width in np.unique(before).tolist():
        some = np.flatnonzero(before == width)
        pair = right[window - width][stretch[some]] * (len(at) + 1) + left[width][stretch[some]]
        names, which = np.unique(pair, return_inverse=True)
        group[some] = which + groups
        groups += len(names)
    return A.Windows(stretch, number, hashed, group)


def _common(words: Words, bucket: np.ndarray, at: np.ndarray, stop: np.ndarray, step: int, depth: int) -> dict[int, np.ndarray]:
    """By length up to ``depth``: classes of the suffixes that agree in so many words from ``at`` on.

    The suffixes are sorted once; a class ends where neighbours have fewer words in common."""
    lengths = np.minimum((stop - at) * step, depth)
    offset = np.arange(depth)
    inside = offset[None, :] < lengths[:, None]
    index = np.where(inside, at[:, None] + step * offset[None, :], 0)
    read = np.where(inside, words.hash[index] if len(words.hash) else np.uint64(0), np.uint64(0))
    keys = np.concatenate([bucket.astype(">u8")[:, None], read.astype(">u8")], axis=1)
    order = np.argsort(np.ascontiguousarray(keys).view(f"V{keys.shape[1] * 8}").ravel(), kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    common = np.where(same.all(axis=1), depth + 1, np.argmin(same, axis=1)) - 1  # -1: another bucket
    out = {}
    for length in range(depth + 1):
        classes = np.zeros(len(order), dtype=np.int64)
        classes[order[1:]] = np.cumsum(common < length)
        if len(order):
            classes[order[0]] = 0
        out[length] = classes
    return out
