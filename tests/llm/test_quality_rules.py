import math
import re
from collections import Counter

import pytest

from vigil.llm import quality_rules as qr


def by_force(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
    )


TEXTS = [
    None, "", " \n\t ", "one", "a b c d e", "a b c d e f a b c d e", "x " * 40, "é|é # \x0b ü\x0c$\r\n<&>%*",
    "same line\nother\nsame line\n\n \nsame line ", "a b c d e " * 3 + "q r s t u v w " + "c d e a b " * 2, "p q\n" * 7,
    "long " * 3000 + "end", " nbsp stays in words",
]


def test_counts_agree_with_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in qr.measure(docs).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == by_force(t), t


def test_binomial_sums_are_exact():
    for n, k, p in ((10, 3, 0.2), (50, 0, 0.02), (200, 9, 0.05), (30, 29, 0.5), (5, 5, 0.1)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert qr.binomial_cdf(k, n, p) == pytest.approx(want, rel=1e-9)


def test_cutoffs_need_evidence():
    many = [("en", 0.1, True, 5000), ("en", 3.0, False, 100)]
    assert qr.choose(many) == {"en": 3.0}
    assert qr.choose([("en", 0.1, True, 50), ("en", 3.0, False, 100)]) == {}  # too few good texts to certify anything
    # A tenth of the good texts score 2 or more: certified cutoffs end above that.
    tenth = [("en", 0.1, True, 9000), ("en", 2.0, True, 1000), ("en", 2.5, False, 10), ("en", 1.5, False, 90)]
    assert qr.choose(tenth) == {"en": 2.5}
    # More strata share the same error: what one stratum alone may use needs more rows.
    edge = [("a", 0.1, True, 160), ("a", 1.0, False, 9)]
    assert qr.choose(edge) == {"a": 1.0} and qr.choose(edge + [(s, 0.1, True, 10) for s in "bcd"]) == {}


def test_likelihood_never_falls():
    table = qr.likelihood([90, 5, 5, 0], [0, 50, 10, 40])
    assert table == sorted(table) and table[0] == pytest.approx(0, abs=0.01) and table[3] > 2


def kept_by_force(rows, labels, risk=qr.RISK, error=qr.ERROR):
    """The verdict of every row, in plain Python."""
    import zlib

    def bins(text):
        text = text or ""
        n, chars, symbols, dup, repeat = by_force(text)
        lines = len([x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
        capitals = len(re.findall("[A-Z]", text))
        parts = [(symbols, chars), (dup, lines), (repeat, n), (capitals, chars)]
        return n < 10 or 100 * repeat > 20 * n, [min(qr.BINS, int(math.sqrt(a / b) * qr.BINS)) if b else 0 for a, b in parts]

    seen = {i: bins(t) for i, t, _ in rows}
    of = {i: s for i, _, s in rows}
    usable = [i for i in labels if i in seen and not seen[i][0]]
    good = Counter(of[i] for i in usable if labels[i] and of[i] is not None)
    named = sorted((s for s in good if good[s] >= qr.LEAST), key=lambda s: (-good[s], s))
    rest = sum(labels[i] for i in usable) - sum(good[s] for s in named)
    while named and 0 < rest < qr.LEAST:
        rest += good[named.pop()]
    group = {i: s if s in named else None for i, s in of.items()}
    tuning = {i: zlib.crc32(f"tune{i}".encode()) % 3 == 0 for i in usable}
    score, cutoff = {}, {}
    for g in {*named, None}:
        tables = []
        for r in range(4):
            tally = {0: [0] * (qr.BINS + 1), 1: [0] * (qr.BINS + 1)}
            for i in usable:
                if group[i] == g and tuning[i]:
                    tally[labels[i]][seen[i][1][r]] += 1
            tables.append(qr.likelihood(tally[1], tally[0]))
        score |= {i: max(t[b] for t, b in zip(tables, seen[i][1])) for i in seen if group[i] == g}
        holdout = [i for i in usable if group[i] == g and not tuning[i]]
        for c in sorted({score[i] for i in holdout if score[i] > 0}, reverse=True):
            lost = [sum(labels[i] == k and score[i] >= c for i in holdout) for k in (0, 1)]
            total = [sum(labels[i] == k for i in holdout) for k in (0, 1)]
            groups = len({group[i] for i in usable if not tuning[i]})
            if not total[1] or sum(math.comb(total[1], k) * risk**k * (1 - risk) ** (total[1] - k) for k in range(lost[1] + 1)) > error / groups:
                break
            gain = lost[0] / max(1, total[0]) - qr.GOOD_WEIGHT * lost[1] / total[1]
            if gain > cutoff.get(g, (0, 0))[0]:
                cutoff[g] = (gain, c)
    return {i: not seen[i][0] and not (group[i] in cutoff and score[i] >= cutoff[group[i]][1]) for i in seen}


def test_verdicts_agree_with_brute_force(spark):
    import random

    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7)))
    rows, labels = [], {}
    for i in range(2600):
        bad, lang = draw.random() < 0.3, draw.choice(["en"] * 5 + ["fr"] * 4 + ["de", None])
        words = [word() for _ in range(draw.randint(8, 40))]
        if bad or draw.random() < 0.01:
            words = draw.choice([[w + "##$" for w in words], [w.upper() for w in words], words])
        rows.append((i, draw.choice([" ", "\n"]).join(words), lang))
        if draw.random() < 0.8:
            labels[i] = int(not bad)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.kept for r in qr.apply_rules(spark, docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()}
    want = kept_by_force(rows, labels)
    assert got == want
    base = {r.doc_id: r.base_failed for r in qr.apply_rules(spark, docs, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert sum(not got[i] and not base[i] for i in got) > 100  # the method rejects beyond the base rules


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    plan = qr.measure(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_verdicts(spark):
    good = [(i, " ".join(f"w{i}x{k}" for k in range(30)), "en") for i in range(1500)]
    bad = [(5000 + i, " ".join(f"w{i}y{k}###" for k in range(30)), "en") for i in range(60)]
    odd = [(9000, None, None), (9001, "", "en"), (9002, "ab " * 50, "xx"), (9003, bad[0][1], None), (None, good[0][1], "en")]
    docs = spark.createDataFrame(good + bad + odd, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, *_ in good] + [(i, 0) for i, *_ in bad] + [(None, 1), (9001, None), (77777, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in qr.apply_rules(spark, docs, labels).collect()}
    assert all(got[i].kept for i, *_ in good) and not any(got[i].kept for i, *_ in bad)
    assert [got[i].base_failed for i in (9000, 9001, 9002, 9003, None)] == [True, True, True, False, False]
    assert got[9003].kept and got[None].kept  # no labels, no cutoff


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert qr.apply_rules(spark, docs, labels).count() == 0
