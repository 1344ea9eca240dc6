import random
import re

import numpy as np
import pytest

from vigil.llm import near_duplicates as nd
from vigil.llm.components import components


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def by_force(rows, n, parts=80):
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= parts * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets), key=str)


def corpus(seed):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    fresh = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    rows, common = [], fresh(60)
    for _ in range(120):
        rows.append(" ".join(fresh(draw.randint(1, 120))))
    for _ in range(40):  # near copies around the threshold
        w = rows[draw.randrange(100)].split()
        for _ in range(draw.randint(1, max(1, len(w) // 10))):
            w[draw.randrange(len(w))] = draw.choice(vocabulary)
        rows.append(" ".join(w))
    rows += [" ".join(common + fresh(draw.randint(5, 60))) for _ in range(40)]  # a shared passage
    base = fresh(150)
    rows += [" ".join(base[:k] + ["q"] + base[k + 1 :]) for k in range(60)]  # one group of near copies
    rows += [rows[3], rows[3].upper(), " " + rows[3] + "\n", None, "", "  ", "One", "one", "one two", "One\ttwo", "é", "É"]
    order = list(range(len(rows)))
    draw.shuffle(order)
    return [(1000 + k, rows[i]) for k, i in enumerate(order)] + [(None, rows[3]), (1000, rows[order[0]])]


@pytest.mark.parametrize("n,block", [(2, 4096), (5, 7)])
def test_groups_agree_with_brute_force(spark, monkeypatch, n, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    rows = corpus(n)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, component_id string").repartition(5)
    got = nd.NearDuplicates(spark, n).find(docs).collect()
    assert sorted(map(tuple, got), key=str) == by_force(rows, n)
    if n == 5:
        kept = nd.NearDuplicates(spark, n).keep_one(docs)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}


def test_every_pair_within_the_guarantee_shares_an_entry():
    draw = np.random.default_rng(7)
    one = draw.integers(0, 256, (300, nd.SYMBOLS), np.uint8)
    other = one.copy()
    for row in other:
        at = draw.permutation(nd.SYMBOLS)[: 2 * nd.CHUNKS - 1]
        row[at] ^= draw.integers(1, 256, len(at), np.uint8)
    for a, b in zip(nd.entries(one), nd.entries(other)):
        assert set(a) & set(b)
    assert not set(nd.entries(one[:1])[0]) & set(nd.entries(one[1:2])[0])


def test_components(spark):
    draw = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 100), (5, 5)] + [(draw.randint(500, 600), draw.randint(500, 600)) for _ in range(70)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = components(spark, spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, root(x)) for x in linked)
    assert components(spark, spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert nd.NearDuplicates(spark).find(docs).count() == 0
