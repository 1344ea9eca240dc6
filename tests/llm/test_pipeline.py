"""The pipeline over a small folder of tables, against plain models of its stages."""

import random
import re

import public_tokenizers
import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(2, 9)))
    fine = lambda n=80: [word() for _ in range(n)]
    rows, labels = {}, []
    for i in range(400):
        rows[i] = " ".join(fine(draw.randint(30, 300)))
        labels.append((i, 1))
    for i in range(400, 500):
        rows[i] = " ".join(w.upper() + "!!" for w in fine())
        labels.append((i, 0))
    base = fine(200)
    for i in range(600, 606):  # near copies: one word in two hundred differs
        rows[i] = " ".join(base[: i % 7 * 20] + ["changed"] + base[i % 7 * 20 + 1 :])
    item = fine(30)
    rows[700] = " ".join(fine(60) + item + fine(60))
    rows[701] = " ".join(fine(60) + ["mail", "someone@mail.example.com"] + fine(60))
    docs = [(i, t, "en", "src", len(t)) for i, t in rows.items()] + [(None, " ".join(fine()), None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, item


def test_stages(spark, folder):
    path, rows, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(spark, stage(spark, docs, path), name)
        if name != "byte_level_bpe":
            assert docs.columns == columns
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert all(r.n_chars is None or r.n_chars == len(r.text) for r in docs.collect())
        if name == "quality_classifier":
            assert sum(i in texts for i in range(400)) >= 396 and sum(i in texts for i in range(400, 500)) <= 4
        if name == "near_duplicates":
            assert [i for i in range(600, 606) if i in texts] == [600] and sum(i in texts for i in range(400)) >= 396 and None in texts
        if name == "decontamination":
            assert " ".join(item[:10]) not in texts[700] and texts[700].split() == [w for w in rows[700].split() if w not in item]
            assert all(texts[i] == rows[i] for i in texts if i not in (None, 700))
        if name == "pii":
            assert texts[701] == re.sub(r"\S+@\S+", "[EMAIL]", rows[701])
    import base64

    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in docs.collect():
        assert r.ids == library.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)


def test_empty_documents(spark, folder, tmp_path):
    path, *_ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
