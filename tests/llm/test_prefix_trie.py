import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparrowmill.llm import prefix_trie as p

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role.encode(), text[:64].encode(), digest(role, text), (role, text)))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute(rows):
    """Nodes as prefixes of lists, each subtree summed by itself."""
    convs = rebuilt(rows)
    members = defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    children, below = defaultdict(set), defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].add(k)
        for d in range(len(k) + 1):
            below[k[:d]].append(k)
    out = []
    for k, m in members.items():
        ends = sorted(c for c in m if len(convs[c]) == len(k))
        saved = sum((len(members[v]) - 1) * len(v[-1][1].encode()) for v in below[k] if v)
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), sum(not children[v] for v in below[k]), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def nodes(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "'x' AS node", "2 AS n", "'y' AS i").repartition(3)
    return sorted((tuple(r) for r in p.prefix_trie(p.rebuilt_turns(df)).collect()), key=repr)


ODD = [
    (0, 0, "user", "hi"), (0, 1, "assistant", "hello"), (0, None, None, "first"), (1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 5, "a", "tie"), (2, 5, "a", "tie"), (2, 5, "b", ""), (3, 0, None, None), (7, 0, "user", "hi"),
    (7, 1, "assistant", "hello"), (None, 0, "user", "nobody's"), (12, 0, "user", "é" * 3000), (12, 1, "us", "er"), (13, 0, "u", "ser"), *[(10, i, "user", f"turn {i % 4}") for i in range(40)], *[(14, i, "user", f"turn {i % 4}") for i in range(45)],
]


@pytest.mark.parametrize("weight", [100_000, 12, 0])
def test_odd_rows_at_any_weight(spark, monkeypatch, weight):
    monkeypatch.setattr(p, "WEIGHT", weight or 1)
    monkeypatch.setattr(p, "BROADCAST_NODES", 0 if weight == 12 else 1000)
    monkeypatch.setattr(p, "PIECE", 2)
    assert nodes(spark, ODD) == brute(ODD)


def test_empty(spark):
    assert nodes(spark, []) == []
    assert nodes(spark, [(None, 1, "user", "x")]) == []


def test_hot_conversation_and_hot_beginning(spark, monkeypatch):
    monkeypatch.setattr(p, "WEIGHT", 150)
    monkeypatch.setattr(p, "PIECE", 16)
    rows = [(c, i, "user" if i % 2 == 0 else "assistant", f"same {i}" if c % 3 == 0 or i < 2 else f"{c} {i}") for c in range(150) for i in range(3 + c % 10)]
    rows += [(1000, i, "user", f"long {i}") for i in range(600)]
    assert nodes(spark, rows) == brute(rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=8), min_size=1, max_size=30), st.integers(0, 3))
def test_double_array_follows_every_walk(walks, tries):
    kept, p.TRIES = p.TRIES, tries
    try:
        flat = [(w, d, c) for w, codes in enumerate(walks) for d, c in enumerate(codes)]
        trie, states = p.build(*(np.array(x, np.int64) for x in zip(*flat, strict=True)))
        name = {}
        for (w, d, _), s in zip(flat, states.tolist(), strict=True):
            assert name.setdefault(s, tuple(walks[w][: d + 1])) == tuple(walks[w][: d + 1])
        assert len(name) == len({tuple(w[: d + 1]) for w in walks for d in range(len(w))})
        for state, path in [(0, ()), *name.items()]:
            to = trie.step(np.full(31, state), np.arange(31))
            assert [bool(x >= 0) for x in to] == [(*path, c) in set(name.values()) for c in range(31)]
    finally:
        p.TRIES = kept
