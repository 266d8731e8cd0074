"""Operator 10, language by averaged embeddings of hashed subwords and a linear softmax.

A text is the mean of the embeddings of its byte 3- and 4-grams (ASCII letters in lower case, any
other ASCII byte a word end), hashed to ``BUCKETS`` rows. Embeddings and softmax are trained
together by stochastic gradient descent in numpy, on pieces of a bounded sample of labelled rows:
at most ``sample`` rows of a language, at most ``PIECES`` pieces of a row. A part of the sample
that is not trained on sets the temperature of the probabilities and the score below which a text
is rejected.

For whole texts the embeddings are first multiplied with the softmax weights, which gives the same
numbers, so a prediction adds one row of a small table for each gram.

Cases: a null text, or one without a letter, is ``und`` with score 0 and is rejected; a null lang
is not learned; without any label everything is ``und``; a row with a null doc_id is predicted but
not learned; each row gives one row and keeps its columns; equal scores go to the first language
in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerprep.llm.words import _bytes, slices

BUCKETS = 1 << 16
WIDTH = 16
SAMPLE = 1500
PIECES = 6
PIECE_BYTES = (24, 600)
EPOCHS = 6
UND = "und"

_FOLD = np.full(256, 0x20, dtype=np.uint32)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_ASCII_LETTER = re.compile("[A-Za-z]")


class Model(NamedTuple):
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the grams of all texts, and where those of each text begin (one more at the end)."""
    space = pa.scalar(" ", pa.large_string())
    padded = pc.binary_join_element_wise(space, texts.cast(pa.large_string()).fill_null(""), space, pa.scalar("", pa.large_string()))
    data, offsets = _bytes(padded)
    folded = _FOLD[data]
    keep = np.ones(len(folded), dtype=bool)
    keep[1:] = (folded[1:] != 0x20) | (folded[:-1] != 0x20)
    keep[offsets[:-1]] = True
    at = np.append(0, np.cumsum(keep))[offsets]
    folded = folded[keep]
    three = folded[:-2] | folded[1:-1] << np.uint32(8) | folded[2:] << np.uint32(16)
    four = three[:-1] | folded[3:] << np.uint32(24)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    in_three, in_four = doc[:-2] == doc[2:], doc[:-3] == doc[3:]
    shift = np.uint32(32 - (BUCKETS.bit_length() - 1))
    bucket = np.concatenate([(x * np.uint32(2654435761)) >> shift for x in (three[in_three], four[in_four])])
    owner = np.concatenate([doc[:-2][in_three], doc[:-3][in_four]])
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.searchsorted(owner[order], np.arange(len(at)))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, langs, parts, texts = [], [], [], []
        for key, lang, text in zip(*(batch.column(c).to_pylist() for c in ("key", "lang", "text")), strict=True):
            random = np.random.default_rng(key & 0xFFFFFFFF)
            raw = text.encode()
            for i in range(PIECES):
                size = int(np.exp(random.uniform(*np.log(PIECE_BYTES))))
                begin = int(random.integers(0, max(1, len(raw) - size + 1)))
                ids.append(key)
                langs.append(lang)
                parts.append(i)
                texts.append(raw[begin : begin + size].decode("utf-8", "ignore"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(parts, pa.int32()), pa.array(texts, pa.string())],
            names=["key", "lang", "part", "text"],
        )


def train(docs: DataFrame, sample: int = SAMPLE, seed: int = 10) -> Model:
    """A model of the labelled rows of ``docs`` (doc_id, text, lang) that are not held out.

    About ``sample`` rows of each language are read, by the hash of the id."""
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((BUCKETS, 1), dtype=np.float32), np.zeros(1, dtype=np.float32), 1.0, 0.5)
    limit = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample / counts[lang]))])[F.col("lang")]
    key = F.xxhash64("doc_id", F.lit(seed))
    chosen = rows.filter(F.pmod(key, F.lit(1 << 20)) < limit * (1 << 20)).select(key.alias("key"), "lang", "text")
    pieces = chosen.mapInArrow(_pieces, "key long, lang string, part int, text string").toArrow().sort_by(
        [("key", "ascending"), ("part", "ascending"), ("text", "ascending")]
    )
    return _fit(pieces, languages, seed)


def _fit(pieces: pa.Table, languages: list[str], seed: int) -> Model:
    number = {lang: i for i, lang in enumerate(languages)}
    y = np.array([number[x] for x in pieces.column("lang").to_pylist()])
    texts = pieces.column("text").combine_chunks()
    tuning = pieces.column("key").to_numpy() % 5 == 0  # whole rows, with all their pieces
    random = np.random.default_rng(seed)
    emb = random.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    out, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    parts = []  # by piece: its buckets and their shares
    for begin in range(0, len(y), 1000):  # the grams of all pieces at once would be large
        bucket, at = grams(texts.slice(begin, 1000))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            unique, times = np.unique(bucket[a:b], return_counts=True)
            parts.append((unique.astype(np.uint16), (times / max(1, times.sum())).astype(np.float32)))
    learn = np.flatnonzero(~tuning)
    weight = 1 / np.maximum(1, np.bincount(y[learn], minlength=len(languages)))
    weight = weight / weight[weight > 0].mean()
    steps = EPOCHS * max(1, len(learn))
    for step in range(steps if len(learn) else 0):
        if step % len(learn) == 0:
            random.shuffle(learn)
        i = learn[step % len(learn)]
        unique, share = parts[i]
        if not len(unique):
            continue
        rate = 0.5 * (1 - step / steps)
        x = share @ emb[unique]
        p = _softmax(x @ out + bias)
        p[y[i]] -= 1
        p *= min(3.0, weight[y[i]])
        back = out @ p
        out -= rate * np.outer(x, p)
        bias -= 0.1 * rate * p
        emb[unique] -= (rate * len(unique) ** 0.5) * share[:, None] * back[None, :]
    table = (emb @ out).astype(np.float32)
    tuned = np.flatnonzero(tuning) if tuning.any() else np.arange(len(y))
    if not len(tuned):
        return Model(languages, table, bias.astype(np.float32), 1.0, 0.0)
    logits = np.stack([parts[i][1] @ table[parts[i][0]] + bias if len(parts[i][0]) else bias for i in tuned])
    scores = {t: -np.log(_softmax(logits / t)[np.arange(len(tuned)), y[tuned]] + 1e-12).mean() for t in np.geomspace(0.05, 5, 41)}
    temperature = float(min(scores, key=lambda t: scores[t]))
    p = _softmax(logits / temperature)
    return Model(languages, table, bias.astype(np.float32), temperature, _reject_below(p.max(axis=1), p.argmax(axis=1) == y[tuned]))


def _reject_below(score: np.ndarray, right: np.ndarray) -> float:
    """The largest score, a half at most, below which tuning pieces are no more often right than wrong."""
    order = np.argsort(score)
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    below = np.flatnonzero((share <= 0.5) & (score[order] < 0.5))
    return float(np.nextafter(score[order[below[-1]]], 1.0)) if len(below) else 0.0


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` (all columns of ``docs``) with ``lang_pred``, ``score`` and ``rejected`` for its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text")
                found = np.array([_has_letter(t) for t in texts.to_pylist()], dtype=bool)
                bucket, at = grams(texts)
                sums = np.zeros((len(texts), len(model.bias)))
                some = np.flatnonzero(np.diff(at))
                if len(some):
                    for c in range(len(model.bias)):
                        sums[some, c] = np.add.reduceat(model.table[bucket, c], at[some], dtype=np.float64)
                p = _softmax((sums / np.maximum(1, np.diff(at))[:, None] + model.bias) / model.temperature)
                best = p.argmax(axis=1)
                known = found & bool(model.languages)
                names = [model.languages[b] if k else UND for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                score = np.where(known, p.max(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(names), pa.array(score), pa.array(~known | (score < model.reject_below))],
                    names=["row", "lang_pred", "score", "rejected"],
                )

    picked = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([picked.schema["row"]]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return picked.mapInArrow(run, schema)
