"""Entropies of whole texts, counted part by part."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vigil.functions import text as T


def model(text):
    data = (text or "").encode()
    return abs(sum(-n / len(data) * math.log2(n / len(data)) for n in Counter(data).values()))


@pytest.mark.parametrize("counted, texts", [(1, 1), (7, 3), (64, 4096), (1 << 20, 4096)])
def test_counts_in_parts(monkeypatch, counted, texts):
    monkeypatch.setattr(T, "COUNTED", counted)
    monkeypatch.setattr(T, "COUNTED_TEXTS", texts)
    draw = random.Random(counted)
    column = ["skipped", "", None, "é", "", *["".join(draw.choice("abé語") for _ in range(draw.randrange(0, 40))) for _ in range(30)], ""]
    got = T._entropy(pa.array(column).slice(1))
    assert [round(x, 9) for x in got.tolist()] == [round(model(t), 9) for t in column[1:]]


def test_entropy_is_one_arrow_step(spark):
    """The fold over an array of a text's byte pairs took about 500 ns a byte."""
    rows = spark.createDataFrame([("aab",), (None,), ("",)], "t string").select(T.entropy(F.col("t")).alias("e"))
    assert "ArrowEvalPython" in rows._jdf.queryExecution().executedPlan().toString()
    assert [round(r.e, 6) for r in rows.collect()] == [0.918296, 0.0, 0.0]
