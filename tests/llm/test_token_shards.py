"""Operator 4: exact round trips."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerprep.llm import token_shards as T

with open(T.VOCABULARY, "rb") as file:
    ENCODER = T._encoder(file.read())


@given(st.text(alphabet=" \n\t\r ab.1é'", max_size=30))
@settings(max_examples=400, deadline=None)
def test_encoding_word_by_word_is_the_whole_encoding(text):
    assert ENCODER.encode(text) == ENCODER.whole(text)


@pytest.mark.parametrize("count", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_slots_are_a_permutation(count):
    found = T.slots(np.arange(count), count)
    assert sorted(found.tolist()) == list(range(count))
    assert (found == T.slots(np.arange(count), count)).all()
    if count > 900:
        assert (found != T.slots(np.arange(count), count, key=1)).any()
        assert abs(np.corrcoef(found, np.arange(count))[0, 1]) < 0.2


@pytest.mark.parametrize("parts", [1, 5])
def test_round_trip(spark, documents, corpus, scratch, parts):
    path = scratch.path()
    docs = documents(corpus, extra=True).repartition(parts)
    plan = T.write_shards(docs, path, scratch, length=32, per_shard=50).collect()
    read = {r.slot: np.frombuffer(r.ids, dtype="<u2").tolist() for r in T.read_shards(spark, path, 32, 50).collect()}
    assert sorted(read) == list(range(len(read))) == sorted(r.slot for r in plan)
    number = {s: i for i, s in enumerate(T.slots(np.arange(len(read)), len(read)).tolist())}
    stream = sum((read[s] for s in sorted(read, key=lambda s: number[s])), [])
    texts, at = [], 0
    total = sum(1 for _, t in corpus if t is not None)
    while len(texts) < total:
        stop = stream.index(T.END_ID, at)
        texts.append(ENCODER.plain.decode_bytes(stream[at:stop]).decode())
        at = stop + 1
    assert set(stream[at:]) <= {T.END_ID} and len(stream) - at < 32
    assert sorted(texts) == sorted(t for _, t in corpus if t is not None)
    assert {r.shard for r in plan} == {s // 50 for s in read}
    assert all(r.byte == r.slot % 50 * 65 for r in plan)
    rest = T.read_shards(spark, path, 32, 50, start=73)
    assert re.search(r"PartitionFilters: \[[^]]*shard\S* >= 1\)", rest._jdf.queryExecution().executedPlan().toString())
    later = rest.collect()
    assert sorted(r.slot for r in later) == list(range(73, len(read)))
    assert all(np.frombuffer(r.ids, dtype="<u2").tolist() == read[r.slot] for r in later)


def test_no_documents(spark, documents, scratch):
    path = scratch.path()
    assert T.write_shards(documents([(1, None)]), path, scratch).collect() == []
    assert T.read_shards(spark, path).collect() == []


def test_workers_forget_the_words_of_a_task(spark, documents):
    with open(T.VOCABULARY, "rb") as file:
        vocabulary = file.read()
    docs = documents([(i, f"some words of document {i}") for i in range(20)]).coalesce(1)
    assert T.tokens(docs, vocabulary).count() == 20

    def known(batches):
        for batch in batches:
            encoder = T._encoder(vocabulary)
            yield T.pa.RecordBatch.from_arrays([T.pa.array([len(encoder._first) + len(encoder._after)])], names=["n"])

    assert [r.n for r in spark.range(1).mapInArrow(known, "n long").collect()] == [0]


def test_words_are_forgotten_at_the_bound(monkeypatch):
    monkeypatch.setattr(T, "_KNOWN_WORDS", 3)
    encoder = T._Encoder(vocabulary_of())
    text = "one two three four five six two one"
    assert encoder.encode(text) == encoder.whole(text)
    assert len(encoder._after) <= 3


def vocabulary_of():
    with open(T.VOCABULARY, "rb") as file:
        return file.read()


def test_shards_are_cut_without_python(spark, documents, scratch, tmp_path):
    """A whole file as one cell of an Arrow batch was held several times in a task."""
    path = str(tmp_path / "shards")
    T.write_shards(documents([(i, f"text {i} " * 30) for i in range(20)]), path, scratch, length=32, per_shard=7)
    read = T.read_shards(spark, path, 32, 7)
    rows = read.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and {len(r.ids) for r in rows} == {64}
    assert "Arrow" not in read._jdf.queryExecution().executedPlan().toString()


def test_torn_shard_is_refused(spark, tmp_path):
    (tmp_path / "shard=0").mkdir()
    (tmp_path / "shard=0" / "part-0").write_bytes(b"x" * 100)
    with pytest.raises(Exception, match="not whole records in shard 0"):
        T.read_shards(spark, str(tmp_path), 32, 7).collect()
