"""Operators 1 and 9 against brute force."""

import re

import numpy as np
import pyarrow as pa
import pytest

from ledgerprep.llm import anchors as A
from ledgerprep.llm.suffixes import repeated_passages
from ledgerprep.llm.superkmers import remove_repeats
from ledgerprep.llm.words import BLANK, run_hash, words_of

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def split(text):
    return [w.decode() for w in WORD.findall((text or "").encode())]


def holders(rows, window):
    out = {}
    for i, text in rows:
        if i is not None:
            words = split(text)
            for at in range(len(words) - window + 1):
                out.setdefault(tuple(words[at : at + window]), set()).add(i)
    return out


def removed(rows, window):
    held, out = holders(rows, window), []
    for i, text in rows:
        words = split(text)
        gone = set()
        for at in range(len(words) - window + 1):
            if i is not None and min(held[tuple(words[at : at + window])]) < i:
                gone.update(range(at, at + window))
        out.append((i, len(words), len(gone), " ".join(w for n, w in enumerate(words) if n not in gone)))
    return out


def passages(rows, window):
    held, out = holders(rows, window), set()
    for i, text in rows:
        if i is None:
            continue
        words, runs = split(text), {True: [], False: []}
        for at in range(len(words) - window + 1):
            who = held[tuple(words[at : at + window])]
            if len(who) > 1:
                run = runs[min(who) < i]
                if run and at <= run[-1][1]:
                    run[-1][1] = at + window
                else:
                    run.append([at, at + window])
        out |= {(i, a, b, copy) for copy, run in runs.items() for a, b in run}
    return out


def text_order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("window,seed,bucket", [(50, 12, 4096), (50, 25, 2), (8, 3, 1), (5, 5, 7)])
def test_removed_words(documents, corpus, scratch, window, seed, bucket):
    got = remove_repeats(documents(corpus, extra=True), scratch, window, seed, bucket).collect()
    assert text_order(map(tuple, got)) == text_order(removed(corpus, window))


@pytest.mark.parametrize("window,seed,bucket", [(50, 12, 4096), (50, 25, 2), (8, 3, 1)])
def test_passages(documents, corpus, scratch, window, seed, bucket):
    got = {tuple(r) for r in repeated_passages(documents(corpus, extra=True), scratch, window, seed, bucket).collect()}
    assert got == passages(corpus, window)


@pytest.mark.parametrize("operator", [remove_repeats, repeated_passages])
def test_empty_table(documents, scratch, operator):
    assert operator(documents([]), scratch).collect() == []


def test_words_and_hashes():
    texts = [None, "", "a\x1cb  c\x0bd", " x", "x ", "é ü x", "y" * 300 + " x"]
    words = words_of(pa.array(texts), BLANK)
    got = [[words.data[a:b].tobytes().decode() for a, b in zip(words.start[x:y], words.end[x:y], strict=True)]
           for x, y in zip(words.first[:-1], words.first[1:], strict=True)]
    assert got == [split(t) for t in texts]
    by_word = {}
    for word, h in zip(sum(got, []), words.hash.tolist(), strict=True):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)


@pytest.mark.parametrize("length", [1, 2, 3, 5, 8, 12, 50])
def test_run_hash_tells_runs_apart(length):
    numbers = np.random.default_rng(1).integers(0, 2, 600).astype(np.uint64)
    hashed = run_hash(numbers, length)
    runs = [tuple(numbers[i : i + length]) for i in range(len(numbers) - length + 1)]
    assert len(hashed) == len(runs)
    assert len({(r, h) for r, h in zip(runs, hashed.tolist(), strict=True)}) == len(set(runs)) == len(set(hashed.tolist()))


def test_stretches_cover_every_window_once():
    words = words_of(pa.array([" ".join(str(n % 37) for n in range(m)) for m in (0, 49, 50, 51, 400)]), BLANK)
    found = A.stretches_of(words, 50, 12)
    windows = [(r, f + i) for r, f, n in zip(found["row"], found["first"], found["windows"], strict=True) for i in range(n)]
    assert sorted(windows) == [(r, i) for r, m in enumerate((0, 49, 50, 51, 400)) for i in range(max(0, m - 49))]
