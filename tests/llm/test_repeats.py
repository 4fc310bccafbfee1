"""Removed words against a dictionary of all windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_rows import ODD

from shotspark.llm import repeats
from shotspark.llm.queries import ORACLES
from workload.check import compare, duck


def plain(rows, words=35):
    """(key, n_words, n_removed, kept) of each row."""
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    seen = Counter(tuple(w[i : i + words]) for w in split for i in range(len(w) - words + 1))
    out = []
    for (key, _), w in zip(rows, split):
        gone = [False] * len(w)
        for i in range(len(w) - words + 1):
            if seen[tuple(w[i : i + words])] > 1:
                gone[i : i + words] = [True] * words
        out.append((key is not None, key or 0, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


def digests(rows):
    return [(*r[:4], hashlib.sha256(r[4]).digest()) for r in rows]


def found(docs, words=35):
    marked, clean = repeats.parse(docs, words=words)
    got = [(r["key"] is not None, r["key"] or 0, r["n_words"], r["n_removed"], hashlib.sha256(r["kept"]).digest()) for r in marked.collect()]
    got += [(r["key"] is not None, r["key"] or 0, r["n_words"], 0, bytes(r["digest"])) for r in clean.collect()]
    return sorted(got)


def test_odd_rows(spark, odd_docs):
    assert found(odd_docs) == sorted(digests(plain(ODD)))


def test_empty_table(spark, make_docs):
    assert found(make_docs([])) == []


def test_borders_copies_and_hot_passages(spark, make_docs):
    """Passages of 33 to 80 words between own words, edited copies, equal texts, and one passage in
    a third of all texts."""
    rnd = random.Random(3)
    new = lambda n: [f"w{rnd.randrange(10**7)}" for _ in range(n)]
    passages, rows = [new(n) for n in (33, 34, 35, 36, 50, 80)], []
    hot = new(60)
    for _ in range(120):
        words = new(rnd.randrange(0, 40))
        for _ in range(rnd.randrange(3)):
            p = rnd.choice(passages)
            cut = rnd.randrange(len(p) // 2) if rnd.random() < 0.3 else 0
            words += p[cut:] + new(rnd.randrange(0, 30))
        if rnd.random() < 0.35:
            words += hot + new(rnd.randrange(5))
        rows.append(words)
    base = new(200)
    for _ in range(30):
        copy = list(base)
        for _ in range(rnd.randrange(5)):
            copy[rnd.randrange(200)] = new(1)[0]
        rows.append(copy)
    rows += [rows[5]] * 20 + [new(50) * 2, new(20) * 5, ["x"] * 300, ["a", "b"] * 60, ["b", "a"] * 19]
    rows = [(i, rnd.choice([" ", "\n", " \t\r\n"]).join(w)) for i, w in enumerate(rows)]
    rnd.shuffle(rows)
    assert found(make_docs(rows).repartition(7)) == sorted(digests(plain(rows)))


def test_small_windows(spark, make_docs):
    """Few words make matches of every kind."""
    rnd = random.Random(8)
    for words, kinds in ((1, 40), (2, 5), (4, 3), (6, 3), (7, 2)):
        rows = [(i, " ".join(rnd.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMN"[:kinds], k=rnd.randrange(0, 3 * words)))) for i in range(40)]
        assert found(make_docs(rows), words) == sorted(digests(plain(rows, words)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\x0b\x0c\r\x1c\x85\xa0ab\0é😀", max_size=30), min_size=1, max_size=6))
def test_words_are_those_of_the_pattern(texts):
    w = repeats.Words([t.encode() for t in texts], 3)
    split = [re.findall(rb"[^\x20\x09-\x0D]+", t.encode()) for t in texts]
    assert w.counts.tolist() == [len(s) for s in split]
    assert w.kept(np.zeros(len(w.starts), bool)) == [b" ".join(s) for s in split]
    every = [x for s in split for x in s]
    hashes = w.hashes().tolist()
    assert len(hashes) == len(every)
    assert len(set(zip(hashes, every))) == len(set(hashes)) == len(set(every))
    gone = np.arange(len(every)) % 3 == 1
    left, at = [], 0
    for s in split:
        left.append(b" ".join(x for x, g in zip(s, gone[at:]) if not g))
        at += len(s)
    assert w.kept(gone) == left


def test_long_words_and_pieces(monkeypatch):
    texts = [b"a" * 5000 + b" " + b"b" * 5000 + b" x", b"y " + b"a" * 5000, b"", b"a" * 4096 + b" " + b"a" * 4097]
    whole = repeats.Words(texts).hashes().tolist()
    assert whole[0] == whole[4] and len(set(whole)) == 6
    monkeypatch.setattr(repeats, "CHUNK", 7)
    assert repeats.Words(texts).hashes().tolist() == whole


@pytest.mark.parametrize("words", [1, 2, 5, 35])
def test_equal_windows_have_equal_anchors(words, monkeypatch):
    rnd = random.Random(words)
    texts = [" ".join(rnd.choices("abcd", k=rnd.randrange(120))).encode() for _ in range(20)]

    def anchors():
        w = repeats.Words(texts, words)
        h = w.hashes()
        pieces = list(w.windows(h))
        split = [t.split() for t in texts]
        every = [x for s in split for x in s]
        starts = np.concatenate([p[0] for p in pieces]) if pieces else []
        assert len(starts) == sum(max(0, len(s) - words + 1) for s in split)
        return {(tuple(every[i : i + words]), int(a - i)) for s, at in pieces for i, a in zip(s, at)}

    all_at_once = anchors()
    assert len({w for w, _ in all_at_once}) == len(all_at_once)
    assert all(0 <= offset <= words - max(1, (words + 1) // 3) for _, offset in all_at_once)
    monkeypatch.setattr(repeats, "CHUNK", 10)
    assert anchors() == all_at_once


def test_sql_agrees(spark, sf):
    problem, n = compare(duck(sf), repeats.op11_repeats(spark, sf), ORACLES["op11_repeats"])
    assert problem is None and n == 200
