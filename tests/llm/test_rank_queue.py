"""The rank queue over many pre-tokens against merges of one pre-token."""

import base64
import hashlib
import random

import pytest
import tiktoken

import public_tokenizers
from vigil.llm import bpe
from vigil.llm.pretokens import Remembered


def plain(ranks, piece):
    """The least pair first, the leftmost of equals, one merge at a time."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


@pytest.mark.parametrize("ordered", [True, False])
def test_any_vocabulary(ordered):
    """Also where a merge makes a pair of a lower rank."""
    for seed in range(40):
        r = random.Random(seed)
        tokens = {bytes([b]) for b in range(256)}
        pool = [bytes([c]) for c in b"abc"]
        for _ in range(r.randint(0, 40)):
            token = r.choice(pool) + r.choice(pool)
            if token not in tokens:
                tokens.add(token)
                pool.append(token)
        made = pool[3:]
        if not ordered:
            r.shuffle(made)
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(made)}
        pairs = bpe.BytePairs(ranks, r".+")
        pieces = [bytes(r.choice(b"abcd") for _ in range(r.randint(1, 30))) for _ in range(60)] + [b"a" * 50, b"\xff"]
        ids, bounds = pairs.merge_all(pieces)
        for k, piece in enumerate(pieces):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == plain(ranks, piece) == (pairs.merge(piece) if piece not in ranks else plain(ranks, piece))


def test_batches_give_what_the_library_gives(spark, monkeypatch):
    """Repeated and null rows, long pre-tokens, caches that overflow, slices of
    one text, and an empty table."""
    monkeypatch.setattr(bpe, "QUEUED", 2)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in file.read().splitlines() if x)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(3)
    texts = ["".join(r.choice(["ab", "the ", "é", "日本", " ", "\n", "12", "x" * 80, "qzj", "Ünder", "😀"]) for _ in range(r.randint(0, 60))) for _ in range(80)]
    texts += [None, "", texts[0], texts[0], "z" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for limit, budget in ((16 << 20, 64 << 20), (10, 500)):
        monkeypatch.setattr(bpe, "SLICE_BYTES", limit)
        monkeypatch.setattr(Remembered, "BUDGET", budget)
        worker = bpe._Worker(open(path, "rb").read(), public_tokenizers.PATTERN)
        import numpy as np
        import pyarrow as pa

        got = [np.frombuffer(x, np.int32).tolist() for x in worker.encode(pa.array(texts))]
        want = [library.encode(t or "", disallowed_special=()) for t in texts]
        assert got == want
        codec = bpe.ByteBPE(spark, path, public_tokenizers.PATTERN)
        rows = codec.round_trip(df).orderBy("doc_id").collect()
        for row, ids, text in zip(rows, want, texts):
            assert (row.coded.n_tokens, row.coded.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            assert row.coded.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert codec.round_trip(df.where("doc_id < 0")).count() == codec.encode(df.where("doc_id < 0")).count() == 0
