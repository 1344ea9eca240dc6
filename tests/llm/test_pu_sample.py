import random

import numpy as np

from vigil.llm import pu_quality
from vigil.llm.pu_quality import QualityClassifier


def corpus(spark, count, labelled, step):
    """Documents of two kinds, few of them labelled; labels without documents."""
    draw = random.Random(7)
    plain = "the river runs past an old mill and people of this village meet there on market days nobody hurries".split()
    good = lambda: " ".join(draw.choices(plain, k=draw.randint(20, 60))).capitalize() + "."
    bad = lambda: " ".join(draw.choices(["CLICK>>", "$$$", "BUY!!", "#WIN#", "|", "99", "http://x/?"], k=draw.randint(20, 60)))
    docs = spark.createDataFrame([(i, good() if i % 2 else bad()) for i in range(count)], "doc_id long, text string")
    rows = [(i, i % 2) for i in range(0, step * labelled, step)] + [(count + i, 1) for i in range(400)]
    return docs, spark.createDataFrame(rows, "doc_id long, quality int")


def test_few_labels_beside_many_documents(spark, monkeypatch):
    docs, labels = corpus(spark, 3000, 60, 49)
    seen, fit = [], pu_quality.fit
    monkeypatch.setattr(pu_quality, "fit", lambda p, u: seen.append((len(p), len(u))) or fit(p, u))
    model = QualityClassifier.fit(spark, docs, labels, sample=300)
    # All labelled positives serve, though the sample holds about three.
    assert seen[0][0] == 30 and 230 < seen[0][1] < 370
    got = model.score(docs).select("doc_id", "score").toArrow()
    kind, score = got.column("doc_id").to_numpy() % 2, got.column("score").to_numpy()
    assert np.mean(score[kind == 1] > 0.7) > 0.9 and np.mean(score[kind == 0] < 0.7) > 0.9


def test_bound_of_positives(spark, monkeypatch):
    docs, labels = corpus(spark, 3000, 3000, 1)
    seen = []
    monkeypatch.setattr(pu_quality, "fit", lambda p, u: seen.append((len(p), len(u))) or (None, 0.5))
    QualityClassifier.fit(spark, docs, labels, sample=300, positives=200)
    assert 140 < seen[0][0] < 260 and 230 < seen[0][1] < 370
