import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from sparrowmill.llm import ngram_join as j
from sparrowmill.llm.components import connected_components
from sparrowmill.llm.words import Texts, shingle_sets

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(rows):
    """{index: (n_shingles, component_id)} from all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for k in holders[x]:
                if k > i:
                    common[k] += 1
        for k, c in common.items():
            if 100 * c >= 75 * (len(s) + len(sets[k]) - c):
                parent[find(k)] = find(i)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return [(rows[i][0], len(sets[i]), min((g for g in groups[find(i)] if g is not None), default=None)) for i in range(len(rows))]


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert order(map(tuple, j.query(spark, d).collect())) == order(brute(rows))


@pytest.mark.parametrize("small", [3, 32])
def test_chains_at_the_border_and_blocks(spark, monkeypatch, small):
    monkeypatch.setattr(j, "BLOCK_SETS", 8)
    monkeypatch.setattr(j, "SMALL_GROUP", small)
    rng = random.Random(5)
    rows = []
    for base in range(12):
        n = [6, 9, 14, 30, 63, 64, 66, 120, 300, 500, 520, 700][base]
        words = [f"w{base}x{i}" for i in range(n)]
        for _ in range(25):
            own = list(words)
            for _ in range(rng.randrange(0, max(2, n // 12))):
                own[rng.randrange(len(own))] = f"q{rng.random()}"
            if rng.random() < 0.5:
                own = own[: int(len(own) * rng.uniform(0.7, 1))]
            rows.append((rng.randrange(10**9), " ".join(own)))
    rows += [(i, "shared passage of many words that all of these texts hold in the middle " * 1 + " ".join(f"z{i}y{k}" for k in range(9))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = j.near_duplicates(df).collect()
    want = brute(rows)
    assert order(map(tuple, got)) == order(want)
    assert len({c for _, _, c in want}) < len(rows) - 100


def test_odd_rows(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert order(map(tuple, j.near_duplicates(odd_docs).collect())) == order(brute(rows))
    by_text = j.near_duplicates(odd_docs.withColumn("doc_id", F.concat(F.lit("k"), F.col("doc_id").cast("string"))))
    assert by_text.count() == len(rows) and dict(by_text.dtypes)["component_id"] == "string"
    assert j.near_duplicates(odd_docs.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [50, 75, 90])
def test_partners_share_signatures_at_every_size(percent):
    rng = np.random.default_rng(3)
    levels = rng.integers(0, 64, 1 << j.SKETCH_BITS).astype(np.uint8)
    tried = 0
    for size in [1, 2, 3, 4, 5, 7, 8, 9, 16, 20, 32, 47, 50, 64, 65, 100, 128, 129, 380, 512, 513, 3000, 5000]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
            drop = rng.integers(0, int(len(a) * (100 - percent) / 100) + 1)
            b = np.delete(a, rng.choice(len(a), drop, replace=False))
            room = max(0, int(len(b) * 100 / percent - len(a) - 1e-9))
            b = np.unique(np.r_[b, rng.integers(0, 1 << 64, rng.integers(0, room + 1), dtype=np.uint64)])
            common = len(np.intersect1d(a, b))
            if a.tolist() != b.tolist() and 100 * common >= percent * (len(a) + len(b) - common):
                (x, n), (y, m) = j.sign_sets([a, b], levels, percent)
                assert len(np.intersect1d(x, y)) >= max(n, m) >= 1, (size, drop)
                tried += 1
    assert tried > 300


def test_signatures_of_many_sets_are_those_of_each():
    rng = np.random.default_rng(4)
    levels = rng.integers(0, 64, 1 << j.SKETCH_BITS).astype(np.uint8)
    sets = [np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for n in [1, 3, 30, 8, 8, 500, 2, 64, 1000]]
    for s, (keys, need) in zip(sets, j.sign_sets(sets, levels, 75)):
        (own, least), = j.sign_sets([s], levels, 75)
        assert sorted(keys.tolist()) == sorted(own.tolist()) and need == least
        assert len(keys) <= 4 * len(s) + 2 * j.MEETINGS


def test_parities_allow_every_link_and_few_others():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for n in (1, 2, 15, 16, 17, 60, 200, 500, 1030)]
    for s in list(sets):
        for share in (0.05, 0.13, 0.3, 0.5):
            drop = rng.choice(len(s), int(len(s) * share), replace=False)
            sets.append(np.unique(np.r_[np.delete(s, drop), rng.integers(0, 1 << 64, len(drop) // 2, dtype=np.uint64)]))
    allowed = j.may_link([j.parities(s) for s in sets], np.array(list(map(len, sets))), 75)
    link = j.linked(sets, 75)
    assert allowed[link].all() and allowed.sum() < link.sum() + 40


def test_sets_that_share_a_short_name_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(j, "short_name", lambda digest: digest[0] % 4)
    monkeypatch.setattr(j, "SHORT_NAME", "pmod(conv(hex(substring(digest, 1, 1)), 16, 10), 4)")
    rows = [(i, " ".join(f"g{i // 3}w{k}" for k in range(40)) + (f" end{i % 3}" if i % 3 else "")) for i in range(60)]
    got = j.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert order(map(tuple, got)) == order(brute(rows))


def test_sets_equal_shingles():
    texts = ["A b c d E f", "a B c d e F", "x", " x ", "x y", "", "é É a b c d e f a b c d e f", "a\x0bb\x0cc d e", "a b c d", "a b c d a b c d a"]
    found = shingle_sets(Texts.of(pa.array(texts)), 5, b"any key")
    want = [shingles(t) for t in texts]
    assert [len(s) for s in found] == [len(s) for s in want]
    for i in range(len(texts)):
        for k in range(len(texts)):
            assert len(np.intersect1d(found[i], found[k])) == len(want[i] & want[k])


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, rng.randrange(1001, 1400)) for _ in range(300)] + [(5000 + rng.randrange(90), 5000 + rng.randrange(90)) for _ in range(70)]
    rng.shuffle(edges)
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
