import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from vigil.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def by_force(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) < 256 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return [(a, b, pii.KINDS[k]) for a, k, b in sorted(out)]


piece = st.sampled_from(["a", "b.c", "@", "x-1", ".", "12", "255.1.2.3", "300.1.1.1", "+1 (555) 555-0100", "4111 1111 1111 1111", "4111-1111-1111-1112", "+", "-", " ", "é", "\n", "%", "1"])


@settings(max_examples=500, deadline=None)
@given(st.lists(piece, max_size=20).map("".join))
def test_base_spans_agree_with_the_patterns(text):
    assert pii.base_spans(text) == by_force(text)


def test_address_parts_may_be_of_any_length():
    long = "0" * 5000
    assert pii.base_spans("9" * 5000 + ".1.1.1") == pii.base_spans("1.1.1." + "2" * 5000) == []
    assert pii.base_spans(f"{long}255.{long}.00.7") == [(0, 10009, "ip")]
    assert pii.base_spans("256.0.0.1") == [] and pii.base_spans("099.255.0.1") == [(0, 11, "ip")]


def test_long_texts_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000, "a@" * 50_000, "1." * 100_000, "+1" + "-" * 100_000, "x1" * 100_000):
        spans = pii.base_spans(text)
        pii.candidates(text, spans)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["tel", "Tel", "x", "é", "12345", "ab", "9"]), max_size=12))
def test_pattern_hashes_match_counted_contexts(tokens):
    import numpy as np
    import pyarrow as pa

    text = " \n".join(tokens)
    one, two = pii._word_codes(pa.array([text, None, "tel 1"], pa.large_string()))
    counted = sorted(np.concatenate((one, two)).view(np.int64).tolist())
    want = []
    for m in list(re.finditer(r"\S+", text)):
        want += [pii._pattern_code(p) for p in pii.contexts(text, m.start())]
    assert counted == sorted(want + [pii._pattern_code("tel")])


def test_contexts_discover_unseen_identifiers(spark):
    draw = random.Random(5)
    filler = lambda: " ".join(draw.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(20))
    rows = []
    for i in range(60):
        rows.append(f"{filler()} contact: user{i}@mail.example.com {filler()} the 192.168.0.{i} {filler()}")
    rows += [f"{filler()} contact: user{i}-at-example-dot-com5, {filler()}" for i in range(5)]
    rows += [f"{filler()} the part4711{i} {filler()}" for i in range(40)] + [None, "", "no digits"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(rows)], "doc_id long, text string, spans string")
    extractor = pii.Extractor(spark)
    induced = {r.pattern: r.kind for r in extractor.induce(docs).collect()}
    assert induced["contact:"] == "email" and "the" not in induced
    got = {r.doc_id: r.found for r in extractor.find(docs).collect()}
    for i, text in enumerate(rows):
        base = [(s.start, s.stop, s.kind) for s in got[i].base]
        assert base == by_force(text or "")
        spans = [(s.start, s.stop, s.kind) for s in got[i].spans]
        extra = [(text or "")[a:b] for a, b, k in spans if (a, b, k) not in base]
        assert extra == ([f"user{i - 60}-at-example-dot-com5"] if 60 <= i < 65 else []), text
    masked = {r.doc_id: r.text for r in extractor.mask(docs).collect()}
    assert "[EMAIL]" in masked[0] and "[IP]" in masked[0] and "@" not in masked[0] and masked[len(rows) - 3] is None
    assert extractor.mask(docs).columns == docs.columns


def test_no_seeds(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.Extractor(spark).find(docs).count() == 0


def test_patterns_discover_secrets(spark):
    """The method's own spans: seeds alone are none, and plain digests aren't either."""
    value = lambda i: f"{i * 7919:08x}" * 5
    rows = [f'some words token = "{value(i)}" more words' for i in range(1, 21)]
    rows += [f"loose words token = {value(77)} and more", f'in brackets ("TOKEN = ({value(78)})")', f"commit {value(79)} is a digest", f'lonely secret: "{value(80)}"']
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r.pattern: r.kind for r in pii.Extractor(spark).induce(docs).collect()}["token ="] == "secret"
    got = {r.doc_id: [(s.kind, rows[r.doc_id][s.start : s.stop]) for s in r.found.spans] for r in pii.Extractor(spark).find(docs).collect()}
    assert all(got[i] == [("secret", value(i + 1))] for i in range(20))
    assert got[20] == [("secret", value(77))] and got[21] == [("secret", value(78))] and got[22] == got[23] == []


def test_contexts_reach_over_quotes_and_long_words():
    assert pii.contexts('a  b ("x1y2z', 7) == ["b", "a b"]
    assert pii.contexts('ab"x', 3) == [] and pii.contexts('"x', 1) == []
    long = "w" * 5000
    assert pii.contexts(f"{long} Tel: 12345", len(long) + 6) == ["tel:", f"{long} tel:"]


def scores(rows, support=8, rounds=20):
    """Confidences by dictionaries: the graph, its totals and its rounds."""
    edges, total = {}, {}
    for text in rows:
        tokens = list(re.finditer(r"[^ \t\n\x0b\x0c\r]+", text or ""))
        for m in tokens:  # every token counts for the contexts before it
            for p in pii.contexts(text, m.start()):
                total[p] = total.get(p, 0) + 1
        spans = pii.base_spans(text or "")
        seeds = sorted(spans + pii.secret_seeds(text or "", spans))
        for a, b, kind in seeds + [(a, b, None) for a, b in pii.candidates(text or "", seeds)]:
            form = pii.shape(text, a, b)
            total[form] = total.get(form, 0) + 1
            for p in (*pii.contexts(text, a), form):
                key = (p, text[a:b].lower(), kind)
                edges[key] = edges.get(key, 0) + 1
    of = {}
    for p in {p for p, _, k in edges if k}:
        count = {k: len({i for q, i, j in edges if (q, j) == (p, k)}) for k in pii.SPAN_KINDS}
        best = max(count, key=lambda k: (count[k], k))
        if count[best] >= support:
            of[p] = best
    graph = {(p, i, k): n for (p, i, k), n in edges.items() if p in of and k in (None, of[p])}
    family = lambda p: p.split(" ")[-1]
    score, before = {e: float(e[2] is not None) for e in graph}, None
    while True:
        now = {p: min(1.0, sum(score[e] * n for e, n in graph.items() if e[0] == p) / total[p]) for p in of}
        rounds -= 1
        if not rounds or before and max((abs(now[p] - before[p]) for p in of), default=0) <= pii.SETTLED:
            return {p: c for p, c in now.items() if not p.startswith("\0")}
        before = now
        for p, i, k in graph:
            if k is None:
                miss = 1.0
                for q, j, kind in graph:
                    if j == i and kind is None and of[q] == of[p] and family(q) != family(p):
                        miss *= max(1e-9, 1 - now[q])
                score[p, i, k] = 1 - miss


def secret_rows():
    draw = random.Random(9)
    value = lambda i: f"{i * 104729:010x}" * 4
    rows = [f'w{draw.randint(0, 9)} words token = "{value(i)}"{draw.choice(["", "###", ";", " #"])} more {draw.choice(["a1b2c", "x"])} words' for i in range(1, 61)]
    return rows + [f'version = {i}77.b and the = "v{i}"' for i in range(30)] + [None, "", rows[0], rows[0]], value


def test_scores_are_those_of_a_plain_graph(spark):
    rows, _ = secret_rows()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    want = scores(rows)
    got = {r.pattern: r.confidence for r in pii.Extractor(spark, confidence=-1.0).induce(docs).collect()}
    assert set(got) == set(want) and "token =" in got
    assert all(abs(got[p] - want[p]) < 1e-6 for p in got), (got, want)


def test_unseen_values_are_discovered_and_end_where_they_end(spark):
    """Half of the documents hold no seed; their values are found all the same."""
    rows, value = secret_rows()
    unseen = [i for i, t in enumerate(rows[:60]) if not pii.secret_seeds(t, [])]
    assert 20 <= len(unseen) <= 40
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: [rows[r.doc_id][s.start : s.stop] for s in r.found.spans] for r in pii.Extractor(spark).find(docs).collect()}
    assert all(got[i] == [value(i + 1)] for i in unseen)
    assert all(got[i] == [value(i + 1)] for i in range(60)) and not any(got[i] for i in range(60, 92))


def test_candidates_end_at_quotes_and_punctuation():
    found = lambda text: [text[a:b] for a, b in pii.candidates(text, [])]
    assert found('k = "ab12cd34"### x') == ["ab12cd34"] and found("k = 'ab12cd34'zz9 x") == ["ab12cd34"]
    assert found("$ab12cd=% #12345_&") == ["ab12cd=", "12345_"] and found('"12345') == ["12345"]
    assert pii.shape('"ab12"', 1, 5) == "\0qh4" and pii.shape("AB1z_", 0, 5) == "\0b5" and pii.shape("12345", 0, 5) == "\0d5"
