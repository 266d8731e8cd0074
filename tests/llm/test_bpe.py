"""Operator 13: pre-tokens, perfect hash and joins against the library, and the round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerprep.llm import bpe
from ledgerprep.llm.q_bpe import op13_byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
V = bpe.vocabulary(PATH)
LIBRARY = tiktoken.Encoding("library", pat_str=public_tokenizers.PATTERN, mergeable_ranks=V.ranks, special_tokens={})
PARTS = st.sampled_from(
    [*" \t\n\r'strevmld.,-a1Z9", "\x1c", "\x85", "　", "'s", "'ll", "'re", " '", "é", "ß", "½", "٣", "漢字", "\U0001f600", "́", "<|endoftext|>", "the", " world", "\x00"]
)


def encoded(texts):
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    ids, begin = bpe.encode_texts(np.frombuffer(data, dtype=np.uint8), offsets, V, {})
    return [ids[a:b].tolist() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


@given(st.lists(st.lists(PARTS, max_size=14).map("".join), max_size=5))
@settings(max_examples=1500, deadline=None)
def test_ids_are_those_of_the_library(texts):
    assert encoded(texts) == [LIBRARY.encode_ordinary(t) for t in texts]


@given(st.lists(st.text(max_size=30), max_size=4))
@settings(max_examples=500, deadline=None)
def test_any_character(texts):
    assert encoded(texts) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_pattern_is_the_one_of_the_vocabulary():
    assert bpe.PATTERN == public_tokenizers.PATTERN


def test_hash_is_minimal_and_perfect():
    tokens = list(V.ranks)
    stop = np.cumsum([len(t) for t in tokens])
    start = stop - [len(t) for t in tokens]
    data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
    slot = bpe._looked_up(data, start, stop, V)
    assert sorted(slot.tolist()) == list(range(len(tokens))) and len(V.ids) == len(tokens)
    assert V.ids[slot].tolist() == list(V.ranks.values())
    strange = [b"\xff" + t for t in tokens if b"\xff" + t not in V.ranks]
    stop = np.cumsum([len(t) for t in strange])
    found = bpe._looked_up(np.frombuffer(b"".join(strange), dtype=np.uint8), stop - [len(t) for t in strange], stop, V)
    assert (found < 0).all()


def test_long_words_are_joined_as_in_the_library():
    rng = random.Random(3)
    for word in ("x" * 5000, "ab" * 3000, "".join(rng.choices("abcdefgh", k=4000)), "é" * 2000):
        assert bpe.join(word.encode(), V.ranks) == LIBRARY.encode_ordinary(word)


@pytest.mark.parametrize("blank", [" ", "\n", "  ", " \n ", ""])
def test_long_texts_are_cut_where_the_pattern_cuts(monkeypatch, blank):
    monkeypatch.setattr(bpe, "PIECE_BYTES", 64)
    rng = random.Random(len(blank))
    text = "".join(rng.choice(["don't", "12", "...", "é", blank, "漢字", "　", "it's", "'s"]) + rng.choice(["", blank]) for _ in range(400))
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    pieces = [p.tobytes() for p in bpe._pieces(raw)]
    assert b"".join(pieces) == text.encode() and (not blank or len(pieces) > 5)
    assert sum(encoded([p.decode() for p in pieces]), []) == LIBRARY.encode_ordinary(text)


def test_rows_and_round_trip(spark, corpus, documents, tmp_path):
    rows = [*corpus, (200, "x" * 3_000_000), (201, "wörd don't 12 \n\n" * 200_000), (202, " <|endoftext|>"), (203, "\x00")]
    folder = tmp_path / "sf"
    documents(rows, extra=True).write.parquet(f"{folder}/documents.parquet")
    got = sorted(map(tuple, op13_byte_bpe(spark, str(folder)).collect()), key=repr)
    want = []
    for doc, text in rows:
        ids = LIBRARY.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_empty_table(spark, documents):
    assert bpe.decode(bpe.encode(documents([]), PATH), PATH).collect() == []


def test_strange_id_ends_the_job(spark):
    df = spark.createDataFrame([(1, bytearray(np.array([70_000], dtype="<u4").tobytes()))], "doc_id long, ids binary")
    with pytest.raises(Exception, match="no token|out of bounds"):
        bpe.decode(df, PATH).collect()
