"""Operators 5 and 7 against brute force: copies, shared passages, periodic and short texts, nulls, repeated rows, hot anchors."""

import dataclasses
import random

import numpy as np
import pytest

from tidewire.llm import fm_dedup, suffix_dedup
from tidewire.llm.induced import suffix_array

LAST = (1 << 63) - 1


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 4)))
    passages = [" ".join(word() for _ in range(r.randint(15, 60))) for _ in range(6)]
    docs = []
    for i in range(90):
        kind = r.random()
        if kind < 0.1 and docs:
            text = docs[-1][1]
        elif kind < 0.15:
            text = ""
        elif kind < 0.2:
            text = "a " * r.randint(10, 90)
        elif kind < 0.25:
            text = "x" * r.randint(30, 200)
        elif kind < 0.28:
            text = None
        else:
            text = " ".join(r.choice(passages) if r.random() < 0.4 else " ".join(word() for _ in range(r.randint(1, 40))) for _ in range(r.randint(1, 5)))
        docs.append((i * 3 if r.random() < 0.95 else None, text))
    return [*docs, docs[5], (docs[6][0], passages[0])]


def brute_bytes(docs):
    first, out = {}, []
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], LAST), LAST if d is None else d)
    for d, t in docs:
        b, key = (t or "").encode(), LAST if d is None else d
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < key:
                gone[i : i + 50] = b"\1" * 50
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def brute_words(docs):
    first, out = {}, []
    for d, t in docs:
        w = (t or "").encode().split()
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            first[key] = min(first.get(key, (LAST, LAST)), (LAST if d is None else d, i))
    for d, t in docs:
        w = (t or "").encode().split()
        gone = bytearray(len(w))
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] < (LAST if d is None else d, i):
                gone[i : i + 20] = b"\1" * 20
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:])))


@pytest.mark.parametrize(("seed", "hot"), [(1, 512), (2, 2)])
def test_against_brute_force(spark, seed, hot):
    docs = corpus(seed)
    df = spark.createDataFrame([(*d, "own") for d in docs], "doc_id long, text string, spans string").repartition(4)
    found = suffix_dedup.deduplicate(df, unit=dataclasses.replace(suffix_dedup.BYTES, hot=hot))
    assert ordered((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found.collect()) == ordered(brute_bytes(docs))
    found = fm_dedup.deduplicate(df, unit=dataclasses.replace(fm_dedup.WORDS, hot=hot))
    assert ordered((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in found.collect()) == ordered(brute_words(docs))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.deduplicate(df).collect() == [] == fm_dedup.deduplicate(df).collect()


@pytest.mark.parametrize("small", [False, True])
def test_suffix_array(monkeypatch, small):
    from tidewire.llm import induced

    if small:  # tiny blocks, and all but the one in turn on disk
        for name in ("BLOCK_ITEMS", "MEMORY_ITEMS", "POP_ITEMS"):
            monkeypatch.setattr(induced, name, 3)
    rng = np.random.RandomState(3)
    for _ in range(150):
        text = np.append(rng.randint(1, rng.choice([1, 2, 3, 10]) + 1, rng.randint(1, 60)), 0).astype(np.int64)
        assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def test_least_ranks():
    rng = np.random.RandomState(0)
    for width in (8, 9):
        text = rng.randint(0, 4, 150).astype(np.int64)
        valid = np.array([i + width <= len(text) and bool((text[i : i + width] > 0).all()) for i in range(len(text))])
        ranks = rng.permutation(len(text)).astype(np.int64)
        want = [min(ranks[j] for j in np.flatnonzero(valid) if (text[j : j + width] == text[i : i + width]).all()) if valid[i] else ranks[i] for i in range(len(text))]
        for module in (suffix_dedup, fm_dedup):
            assert module.least_ranks(text, valid, ranks, width).tolist() == want


def test_shards_take_segments_together(monkeypatch):
    """op7_suffix_dedup: what a shard does for each of its segments takes no arrays of their own; spans are those of brute force."""
    from tidewire.llm import anchors

    rng = random.Random(5)
    shard, want, calls = anchors._Shard(suffix_dedup.BYTES, suffix_dedup._symbols, suffix_dedup.least_ranks), {}, []
    stack = np.stack
    monkeypatch.setattr(np, "stack", lambda *a, **k: (calls.append(1), stack(*a, **k))[1])
    for i in range(1000):
        shared = bytes(rng.choices(range(97, 123), k=rng.choice([49, 50, 55])))
        first, second = b"%04d" % i + shared, shared + b"%04d" % i
        shard.add([(c, doc, 0, np.array([at], np.int64).tobytes()) for c, doc, at in ((second, 2 * i + 1, 7), (first, 2 * i, 3))])
        if len(shared) >= 50:
            want[2 * i + 1] = [(7, 7 + len(shared))]
    out = shard.settle()
    got = {doc: [tuple(x) for x in np.frombuffer(spans, np.int64).reshape(-1, 2).tolist()] for doc, spans in zip(out.column("doc").to_pylist(), out.column("spans").to_pylist(), strict=True)}
    assert got == want
    assert len(calls) < 10  # 2,000 and more before


def test_suffix_array_in_blocks_of_one_root(monkeypatch):
    """op7_suffix_dedup: the size of the queue's blocks and what goes to disk leave the order as it is."""
    from tidewire.llm import induced

    rng = np.random.RandomState(11)
    for name, value in (("BLOCK_ITEMS", 1), ("BLOCK_ROOTS", 1), ("MEMORY_ITEMS", 20), ("POP_ITEMS", 7)):
        monkeypatch.setattr(induced, name, value)
    for symbols in (1, 2, 26):
        text = np.append(rng.randint(1, symbols + 1, 700), 0).astype(np.int64)
        assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
