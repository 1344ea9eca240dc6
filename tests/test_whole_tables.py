"""Queries over whole documents and over events' properties, on small tables
with what the driver's lack: long and non-ASCII texts, nested properties."""

import json
import math
from collections import Counter

from tests.compare import difference
from vigil.plans.queries import ORACLES, QUERIES


def test_entropy_of_whole_documents(spark, tmp_path):
    texts = ["", None, "é", "日本語 " * 50, "ab" * 100_000 + "c", "x" * 70_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    def model(text):
        data = (text or "").encode()
        return abs(sum(-n / len(data) * math.log2(n / len(data)) for n in Counter(data).values()))

    got = {r.doc_id: r.bits for r in QUERIES["entropy_documents"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts) and all(abs(got[i] - model(t)) < 1e-6 for i, t in enumerate(texts))
    assert difference(spark, str(tmp_path), "entropy_documents", QUERIES["entropy_documents"], ORACLES["entropy_documents"]) is None


def test_leaves_of_events(spark, tmp_path):
    props = [json.dumps({"k": 1, "s": "one", "a": ["two", "", {"b": "th\"ree", "n": None}]}), '{"cut', None, '"top"', "{}"]
    rows = [(i, 7, "click", p) for i, p in enumerate(props)] + [(9, 7, None, "{}")]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in QUERIES["json_leaves_events"](spark, str(tmp_path)).collect())
    own = lambda i: [(i, f"7-{i}"), (i, "click"), (i, "u7")]
    assert got == sorted([(0, "one"), (0, 'th"ree'), (0, "two"), (3, "top"), *own(0), *own(3), *own(4)])
    assert difference(spark, str(tmp_path), "json_leaves_events", QUERIES["json_leaves_events"], ORACLES["json_leaves_events"]) is None
