import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from vigil.llm.decontaminate import Phrases, annotate
from vigil.llm.fmindex import FMIndex


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=120), st.integers(1, 5))
def test_search_and_locate_agree_with_scanning(sequence, step):
    symbols = np.array([0, *sequence, 0])
    index = FMIndex(symbols, step)
    patterns = [p for n in (1, 2, 3, 6) for p in {tuple(symbols[i : i + n]) for i in range(len(symbols) - n + 1)} | {(1,) * n} if 0 not in p]
    if not patterns:
        return
    width = max(map(len, patterns))
    grid = np.zeros((len(patterns), width), np.int64)
    for row, p in zip(grid, patterns):
        row[width - len(p) :] = p
    low, high = index.search(grid, np.array([len(p) for p in patterns]))
    for a, b, p in zip(low, high, patterns):
        want = [i for i in range(len(symbols) - len(p) + 1) if tuple(symbols[i : i + len(p)]) == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def by_force(text, items, width):
    own = WORD.findall(lowered(text))
    hit, found = set(), set()
    for name, content in items:
        w = WORD.findall(lowered(content))
        windows = [w] if 0 < len(w) < width else [w[i : i + width] for i in range(len(w) - width + 1)]
        for x in windows:
            for i in range(len(own) - len(x) + 1):
                if x and own[i : i + len(x)] == x:
                    hit |= set(range(i, i + len(x)))
                    found.add(name)
    return len(own), len(hit), sorted(found)


word = st.sampled_from(["a", "B", "ab", "É", "é", "x1", "zz"])
line = st.lists(word, max_size=25).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), line), min_size=1, max_size=5), st.lists(line, max_size=4))
def test_hits_agree_with_brute_force(texts, items):
    rows = [(str(i), x) for i, x in enumerate(items)]
    got = annotate(pa.array(texts, pa.string()), Phrases(rows, 4)).to_pylist()
    assert len(got) == len(texts)
    for text, row in zip(texts, got):
        n, hit, names = by_force(text, rows, 4)
        assert (row["n_words"], sum(s["word_end"] - s["word"] for s in row["hits"]), row["items"]) == (n, hit, names)


def test_blocks_add_up():
    texts = pa.array(["p q r s t u v w x", None, ""], pa.string())
    a, b = Phrases([("1", "q r s")], 3), Phrases([("2", "s t u"), (None, "w x")], 3)
    got = annotate(texts, a, b).to_pylist()
    assert got[0]["items"] == ["1", "2"]
    assert [(s["word"], s["word_end"]) for s in got[0]["hits"]] == [(1, 6), (7, 9)]
    assert [x["hits"] for x in got[1:]] == [[], []]


def test_tables(spark, monkeypatch):
    from vigil.llm import decontaminate

    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, f"Some words, {item.upper()}! and more", "x"), (2, None, "x"), (3, "", "x"), (1, f"Some words, {item.upper()}! and more", "x"), (4, "p " * 400_000 + item, None), (5, "solo", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, leaks string").repartition(3)
    items = spark.createDataFrame([("b", item, "z"), ("a", "so " + item, "z"), (None, "SOLO", "z"), ("c", None, "z"), ("b", item, "z")], "item_id string, text string, leaks string")
    # All in one block; a block for every item, all together, or two and two.
    for limit, group in ((decontaminate.BLOCK_BYTES, decontaminate.GROUP_BYTES), (10, 1000), (10, 20)):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", limit)
        monkeypatch.setattr(decontaminate, "GROUP_BYTES", group)
        got = sorted(decontaminate.find_passages(spark, docs, items).collect(), key=lambda r: r.doc_id)
        assert [(r.doc_id, r.leaks.n_words, [(s.word, s.word_end) for s in r.leaks.hits], r.leaks["items"]) for r in got] == [
            (1, 14, [(2, 12)], ["a", "b"]), (1, 14, [(2, 12)], ["a", "b"]), (2, 0, [], []), (3, 0, [], []), (4, 400_010, [(400_000, 400_010)], ["a", "b"]), (5, 1, [(0, 1)], []),
        ]
        clean = {r.doc_id: r.text for r in decontaminate.remove_passages(spark, docs, items).collect()}
        assert clean[1] == "Some words, \n! and more" and clean[2] is None and clean[4] == "p " * 400_000 + "\n" and clean[5] == "\n"
    none = items.limit(0)
    assert decontaminate.remove_passages(spark, docs, none).columns == docs.columns
    assert all(not r.leaks.hits for r in decontaminate.find_passages(spark, docs, none).collect())
    assert decontaminate.find_passages(spark, docs.limit(0), items).count() == 0
