import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vigil.llm import token_files as tf


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10**6) | st.integers(0, 2**40), max_size=200))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    made = tf.EliasFano.build(np.array(values, np.uint64))
    back, end = tf.EliasFano.read(memoryview(made.to_bytes()), 0)
    assert end == len(made.to_bytes())
    assert back.all().tolist() == values
    assert [back.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        back.select(len(values))


def test_boundaries_take_little_space():
    starts = np.cumsum(np.full(10_000, 500))
    assert len(tf.EliasFano.build(starts).to_bytes()) < 10_000 * 12 / 8 + 100


def test_image_round_trip():
    docs = [np.array(x, "<u2") for x in ([1, 2], [], [65535], [7])]
    image = tf.Image(tf.pack_image([None, -5, -5, 9], docs, 2))
    assert image.doc_ids() == [None, -5, -5, 9]
    assert [image.document(i).tolist() for i in range(4)] == [x.tolist() for x in docs]
    assert tf.Image(tf.pack_image([], [], 2)).documents == 0
    with pytest.raises(ValueError):
        tf.Image(b"x" * 100)


def expected(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    start, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_agree_with_the_library(spark, monkeypatch):
    monkeypatch.setattr(tf, "IMAGE_BYTES", 400)  # several images a task
    text = "It's a test,  of\n\n words\tand 123 númbérs! <|endoftext|> "
    rows = [(i, text * (i % 5) + "\U0001f600你好 x" * (i % 3)) for i in range(90)]
    rows += [(90, None), (91, ""), (None, "no id"), (5, "five again"), (92, "longword" * 3000), (-3, "below zero")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, start string").repartition(3)
    got = tf.token_files(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), 2).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tf.token_files(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), 2).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3) | st.integers(0, 2**45), min_size=1, max_size=300), st.data())
def test_many_elements_at_once(values, data):
    values = sorted(values)
    made = tf.EliasFano.build(np.array(values, np.uint64))
    places = data.draw(st.lists(st.integers(0, len(values) - 1), max_size=50))
    assert made.select_many(np.array(places, np.int64)).tolist() == [values[i] for i in places]


def test_readers_look_up_in_parts(spark, monkeypatch):
    monkeypatch.setattr(tf, "AT_ONCE", 3)
    image = tf.Image(tf.pack_image([None, None, 4, 5, 9, 9, 12], [np.array([k] * k, "<u2") for k in range(7)], 2))
    parts = [image.doc_ids(a, min(a + 3, 7)) for a in range(0, 7, 3)]
    assert sum(parts, []) == image.doc_ids() == [None, None, 4, 5, 9, 9, 12]
    docs = spark.createDataFrame([(i, "a b " * i) for i in range(10)] + [(None, "x")], "doc_id long, text string").repartition(1)
    got = tf.token_files(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), 2).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected([tuple(r) for r in docs.collect()])


def test_pieces_give_what_whole_texts_give():
    import public_tokenizers
    from tokenizers import Tokenizer

    from vigil.llm.token_files import _Encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = _Encoder(open(path, "rb").read())
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    texts = ["", "a  b\n\n c's it's 'x \t", "<|endoftext|> x", "naïve 日本 12 34!!?", "  "]
    for _ in range(2):  # new pieces, then known ones
        assert [x.tolist() for x in encoder.batch(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
