"""Byte-level BPE, language models and the quality classifier."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from vigil.llm import bpe, ppm, pu_quality
from vigil.llm.kernels import text_buffers


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    draw = random.Random(2)
    rows = ["".join(draw.choice("aab \n\t'sé你🙂ǅ²½ \x1c\xa0.,<>ZZ09") for _ in range(draw.randint(0, 80))) for _ in range(300)]
    return rows + [None, "", "a" * 30_000, "".join(draw.choice("abcdefgh") for _ in range(50_000)), "<|endoftext|> it's", "é"]


def test_round_trip_agrees_with_the_library(spark, reference):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, ids string").repartition(3)
    codec = bpe.ByteBPE(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = codec.encode(docs)
    got = {r.doc_id: (r.ids, bytes(r.decoded)) for r in codec.decode(coded).collect()}
    digests = {r.doc_id: r.coded for r in codec.round_trip(docs).collect()}
    for i, t in rows:
        want = reference.encode_ordinary(t or "")
        assert got[i] == (want, (t or "").encode())
        assert tuple(digests[i]) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def slow_bits(text, counts, depth, alphabet, unseen):
    """Code length by following escapes byte by byte, with exclusions."""
    total, line = 0.0, b"\n" * depth + text
    for at in range(depth, len(line)):
        byte = line[at]

        def chance(k):
            """P(byte) as seen from the context of k bytes."""
            if k < 0:
                return {b: 1 / 256 for b in range(256)}
            below = chance(k - 1)
            own = counts.get(line[at - k : at], {})
            n, kinds = sum(own.values()), len(own)
            if not n:
                return below
            left = sum(p for b, p in below.items() if b not in own)
            scale = n + kinds if left > 0 else n
            return {b: own[b] / scale if b in own else kinds / scale * below[b] / left for b in below}

        total -= np.log2(chance(depth)[byte])
    return total


def test_code_lengths_are_exact():
    text = b"abracadabra abracadabra"
    counts: dict = {}
    line = b"\n\n" + text
    for at in range(2, len(line)):
        for k in range(3):
            own = counts.setdefault(line[at - k : at], {})
            own[line[at]] = own.get(line[at], 0) + 1
    import pyarrow as pa

    raw, bounds = text_buffers(pa.array([text.decode()]))
    gram, n = np.unique(ppm._grams(raw, bounds, 2), return_counts=True)
    model = ppm.Model.fit(["x"], np.zeros(len(gram), np.int64), gram, n.astype(float), 2, min_count=1)
    for probe in ("abra cad", "zzz", "\n", "dabra zq a"):
        raw, bounds = text_buffers(pa.array([probe]))
        assert model.lengths(raw, bounds)[0, 0] == pytest.approx(slow_bits(probe.encode(), counts, 2, None, None), rel=1e-5)


def test_languages(spark):
    draw = random.Random(4)
    words = {"aa": ["the", "and", "with", "tion"], "bb": ["und", "der", "schön", "keit"], "cc": ["que", "été", "pour", "ment"]}
    make = lambda k, n: " ".join(draw.choice(words[k]) for _ in range(n))
    rows = [(i, make(k, 60), k, 0.5) for i, k in enumerate("aa bb cc".split() * 60)]
    docs = spark.createDataFrame(rows + [(900, "no label", None, 0.5), (901, None, "aa", 0.5)], "doc_id long, text string, lang string, score double")
    model = ppm.LanguageIdentifier.fit(spark, docs, "doc_id")
    probe = spark.createDataFrame([(1, make("aa", 20)), (2, make("bb", 20)), (3, make("cc", 20)), (4, None), (5, ""), (6, "123 !"), (7, "漢字")], "id long, text string")
    got = {r.id: r.language for r in model.predict(probe).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, 6)] == ["aa", "bb", "cc", "und", "und", "und"]
    assert got[7].lang_pred in words and all(0 <= r.score <= 1 for r in got.values())
    none = ppm.LanguageIdentifier.fit(spark, docs.limit(0), "doc_id")
    assert {r.language.lang_pred for r in none.predict(probe).collect()} == {"und"}


def test_languages_in_blocks_and_odd_rows(spark):
    """Blocks of one tree each change nothing; rows repeat, names clash, texts are long."""
    draw = random.Random(5)
    words = {f"l{k:02}": ["".join(draw.choice("abcdefghiklmnoprstuvw") for _ in range(4)) for _ in range(12)] for k in range(20)}
    make = lambda k, n: " ".join(draw.choice(words[k]) for _ in range(n))
    rows = [(i, make(k, 40), k) for i, k in enumerate(sorted(words) * 6)]
    rows.append((999, make("l03", 40).replace("a", "ø") + " " + "øre æble " * 40_000, "rare"))  # one long text is all there is
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = ppm.LanguageIdentifier.fit(spark, docs, "doc_id", sample_bytes=3_000)
    assert [m.value.languages[0] for m, _ in model.models] == sorted([*words, "rare"])
    probes = [(i, make(k, 15), k) for i, k in enumerate(sorted(words))] + [(50, "øre æble " * 5, "rare"), (51, make("l07", 60_000), "l07")]
    probe = spark.createDataFrame([(*p, "x", "y") for p in probes + probes[:2]], "id long, text string, want string, language string, _Best string")
    whole, blocks = (sorted(map(tuple, model.predict(probe, block_bytes=b).collect())) for b in (1 << 30, 1))
    assert model.predict(probe).columns == ["id", "text", "want", "language", "_Best"] and len(whole) == len(probes) + 2
    for one, other in zip(whole, blocks):
        assert one[3].lang_pred == other[3].lang_pred == one[2] and one[3].score == pytest.approx(other[3].score)
        assert one[:3] == other[:3] and one[4] == "y"
    assert model.predict(probe.limit(0)).count() == 0


def test_a_tree_does_not_depend_on_other_languages(spark):
    rows = [(i, "kaksi kolme neljä viisi", "fi") for i in range(50)]
    more = [(100 + i, f"word{i} of another {k}", f"x{k}") for k in range(30) for i in range(5)]
    few, many = (ppm.LanguageIdentifier.fit(spark, spark.createDataFrame(r, "doc_id long, text string, lang string"), "doc_id", max_cells=400) for r in (rows, rows + more))
    assert len(many.models) == 31 and np.array_equal(few.models[0][0].value.bits, many.models[0][0].value.bits)


def test_class_prior_and_scores():
    draw = np.random.default_rng(3)
    good = lambda n: draw.normal(0, 1, (n, 6))
    bad = lambda n: draw.normal(0, 1, (n, 6)) + [6, 0, 0, 0, 0, 0]
    network, prior = pu_quality.fit(good(800), np.concatenate((good(700), bad(300))))
    assert prior == pytest.approx(0.7, abs=0.06)
    assert (network.score(good(500)) >= 0.7).mean() > 0.97 and (network.score(bad(500)) < 0.7).mean() > 0.97


def test_quality(spark):
    draw = random.Random(6)
    fine = lambda: " ".join("".join(draw.choice("etaoinshr") for _ in range(draw.randint(2, 9))) for _ in range(80))
    rows = [(i, fine() if i % 5 else fine().upper().replace(" ", "!! "), 0.1) for i in range(600)]
    docs = spark.createDataFrame(rows + [(900, None, 0.0), (901, "", 0.0), (None, fine(), 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(0, 600, 2)] + [(2, None), (77777, 1), (None, 1)], "doc_id long, quality int")
    model = pu_quality.QualityClassifier.fit(spark, docs, labels)
    got = {r.doc_id: r.score for r in model.score(docs).collect()}
    right = [(got[i] >= 0.7) == (i % 5 > 0) for i in range(600)]
    assert sum(right) > 580 and all(0 <= s <= 1 for s in got.values())
    none = pu_quality.QualityClassifier.fit(spark, docs, labels.limit(0))
    assert {r.score for r in none.score(docs).select("score").collect()} == {0.5}
    assert model.score(docs.limit(0)).count() == 0


def test_shares_of_empty_texts():
    import pyarrow as pa

    x = pu_quality.features(*text_buffers(pa.array(["", None, " ", "a", "a a a a a a\na a a a a a"])))
    assert x.shape == (5, pu_quality.FEATURES) and np.isfinite(x).all()
