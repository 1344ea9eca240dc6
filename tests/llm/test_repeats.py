"""Substring dedup against a plain dictionary of windows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from vigil.llm.repeats import Passages, ShardIndex, SubstringDedup


def brute(rows, width):
    """(doc_id, text) -> n_words, n_removed, kept, by a dictionary of windows."""
    first = {}
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in texts:
        if i is not None:
            for k in range(len(words) - width + 1):
                window = tuple(words[k : k + width])
                first[window] = min(first.get(window, i), i)
    out = []
    for i, words in texts:
        gone = set()
        if i is not None:
            for k in range(len(words) - width + 1):
                if first[tuple(words[k : k + width])] < i:
                    gone.update(range(k, k + width))
        kept = [w for k, w in enumerate(words) if k not in gone]
        out.append((i, len(words), len(gone), b" ".join(kept).decode()))
    return sorted(out, key=repr)


def corpus(seed, count=60):
    r = random.Random(seed)
    vocabulary = ["a", "b", "é", "ab", "Ab", "x" * 40, "née", "0"]
    passages = [[r.choice(vocabulary) for _ in range(r.randint(3, 40))] for _ in range(6)]
    rows = []
    for i in range(count):
        words = []
        for _ in range(r.randint(0, 4)):
            words += r.choice(passages) if r.random() < 0.6 else [r.choice(vocabulary) + str(r.randint(0, 99)) for _ in range(r.randint(1, 20))]
        rows.append((i, r.choice([" ", "\n", "\t ", " \x0b"]).join(words)))
    return rows


def removed(spark, rows, width, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = SubstringDedup(spark, width, **options).remove(docs)
    return sorted(((r.doc_id, r.repeats.n_words, r.repeats.n_removed, r.repeats.kept) for r in found.collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"crowd": 2, "shard_bytes": 200}, {"crowd": 0, "shard_bytes": 1, "partition_bytes": 100}])
def test_equals_dictionary(spark, options):
    for width, seed in ((5, 1), (13, 2), (3, 3)):
        rows = corpus(seed)
        assert removed(spark, rows, width, **options) == brute(rows, width)


def test_odd_rows(spark):
    """Nulls, empty and short texts, ids that repeat, rows that repeat, a very
    long text and non-breaking spaces, which don't end words."""
    passage = " ".join(f"w{k}" for k in range(20))
    rows = [(5, passage), (5, passage), (5, "x " + passage), (7, passage + " tail"), (None, passage), (8, None), (9, ""), (10, "w1 w2"), (11, passage.replace(" ", "\u00a0"))]
    rows += [(1000 + k, f"own{k} " + passage) for k in range(30)]
    rows += [(3, " ".join(f"v{k % 5000}" for k in range(60_000))), (12, " ".join(f"v{k}" for k in range(100)))]
    assert removed(spark, rows, 13) == brute(rows, 13)
    assert (5, 20, 0, passage) in removed(spark, rows, 13)


def test_empty_table_and_clashing_names(spark):
    assert removed(spark, [], 13) == []
    rows = [(1, "a b c d e f", 7, 8, 9), (2, "a b c d e g", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, repeats int, row int, key int")
    found = SubstringDedup(spark, 4).remove(docs)
    assert found.columns == ["doc_id", "text", "row", "key", "repeats"]
    assert sorted((r.doc_id, r.row, r.key, r.repeats.kept) for r in found.collect()) == [(1, 8, 9, "a b c d e f"), (2, 2, 3, "g")]


def test_equal_windows_share_a_name():
    """Whatever surrounds it, a window goes by the same name."""
    r = random.Random(4)
    window = [f"m{r.randint(0, 9)}" for _ in range(13)]
    texts = [" ".join([f"l{r.random()}"] * r.randint(0, 9) + window + [f"r{r.random()}"] * r.randint(0, 9)) for _ in range(50)]
    found = Passages(pa.array(texts), 13)
    names = set()
    for t in range(len(texts)):
        at = texts[t].split().index(window[0]) + found.at[t]
        at = next(k for k in range(found.at[t], found.at[t + 1] - 12) if texts[t].split()[k - found.at[t] : k - found.at[t] + 13] == window)
        own = np.flatnonzero((found.first <= at) & (at < found.first + found.count))
        names.add(int(found.name[own[0]]))
        assert len(own) == 1
    assert len(names) == 1


def test_statistics_of_a_shard():
    """Least documents by backward search are those of a dictionary."""
    r = random.Random(5)
    passages = [" ".join(r.choice("abc") for _ in range(r.randint(4, 11))) for _ in range(300)]
    least = np.array([r.randint(0, 1000) for _ in passages])
    want = {}
    for p, i in zip(passages, least.tolist()):
        words = p.split()
        for k in range(len(words) - 3):
            want[tuple(words[k : k + 4])] = min(i, want.get(tuple(words[k : k + 4]), i))
    which, found = ShardIndex(pa.array(passages), least, 4).statistics()
    expected = [(n, want[tuple(p.split()[k : k + 4])]) for n, p in enumerate(passages) for k in range(len(p.split()) - 3)]
    assert list(zip(which.tolist(), found.tolist())) == expected
