import hashlib

import pytest

from vigil.llm import warc


@pytest.fixture(scope="module")
def pages(spark):
    big = "é" * 600  # 1200 bytes
    rows = [(1, "http://a/", big), (5, "http://b/", big), (3, None, big), (5, "http://b/", big), (None, "u", big)]
    rows += [(7, "x y\r\nWARC-Type: fake", "small"), (8, "u", "small"), (9, "u", None), (10, "u", ""), (11, "u", "z" * 1000), (12, "u", "z" * 999), (13, "u", "z" * 999)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, sha256 string").repartition(3)


def test_types_and_figures(spark, pages, tmp_path):
    path = f"{tmp_path}/archive"
    warc.write_archive(spark, pages, path)
    got = warc.read_records(spark, path).collect()
    html = {r.page_id: r.html or "" for r in pages.collect()}
    assert len(got) == pages.count()
    for r in got:
        raw = html[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    kinds = sorted((r.page_id or -1, r.record_type, r.refers_to or 0) for r in got)
    assert kinds == sorted(
        [(1, "revisit", 5), (3, "revisit", 5), (5, "response", 0), (5, "revisit", 5), (-1, "revisit", 5)]
        + [(i, "response", 0) for i in (7, 8, 9, 10, 11, 12, 13)]
    )
    assert {r.target_uri for r in got if r.page_id == 7} == {"x%20y%0D%0AWARC-Type:%20fake"}
    assert spark.read.parquet(f"{path}/payloads").count() == len({h for h in html.values()})


def test_records_survive_a_second_archive(spark, pages, tmp_path):
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    warc.write_archive(spark, pages, a)
    first = warc.rebuild(spark, a)
    warc.import_records(spark, first, b)
    want = sorted(bytes(r.record) for r in first.collect())
    assert sorted(bytes(r.record) for r in warc.rebuild(spark, b).collect()) == want
    for r in want:
        head, _, rest = r.partition(b"\r\n\r\n")
        size = int([x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")][0].split()[1])
        assert rest[size:] == b"\r\n\r\n"


def test_damage_is_found(spark, pages, tmp_path):
    path = f"{tmp_path}/archive"
    warc.write_archive(spark, pages, path)
    from pyspark.sql import functions as F

    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.encode(F.lit("other"), "UTF-8")).write.parquet(f"{path}/changed")
    import os
    import shutil

    shutil.rmtree(f"{path}/payloads")
    os.rename(f"{path}/changed", f"{path}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_records(spark, path).collect()


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_round_trip(spark, none).count() == 0


def test_hot_payloads_and_bucketed_tables_change_nothing(spark, pages, tmp_path, monkeypatch):
    path = f"{tmp_path}/archive"
    warc.write_archive(spark, pages, path, table="warc_test_payloads")
    plain = sorted(map(str, warc.read_records(spark, path).collect()))
    assert sorted(map(str, warc.read_records(spark, path, "warc_test_payloads").collect())) == plain
    monkeypatch.setattr(warc, "HOT", 2)
    assert sorted(map(str, warc.read_records(spark, path, "warc_test_payloads").collect())) == plain
    assert sorted(map(str, warc.read_records(spark, path).collect())) == plain
    spark.sql("DROP TABLE warc_test_payloads")


def test_changed_headers_are_found(spark, pages, tmp_path):
    from pyspark.sql import functions as F

    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    warc.write_archive(spark, pages, a)
    wrong = F.encode(F.regexp_replace(F.decode("record", "UTF-8"), "Content-Length: 5", "Content-Length: 6"), "UTF-8")
    warc.import_records(spark, warc.rebuild(spark, a).withColumn("record", wrong), b)
    with pytest.raises(Exception, match="damaged record"):
        warc.read_records(spark, b).collect()


def test_very_long_payload(spark):
    rows = [(1, "u", "é" * 1_500_000), (2, "u", "é" * 1_500_000)]
    got = {r.page_id: (r.record_type, r.payload_bytes) for r in warc.archive_round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("revisit", 3_000_000), 2: ("response", 3_000_000)}


def test_round_trip_leaves_no_table_and_finds_long_headers(spark):
    from vigil.llm.warc import archive_round_trip

    before = {t.name for t in spark.catalog.listTables()}
    rows = [(1, "http://h/" + "u" * 70_000, "x" * 2000), (2, "http://h", "x" * 2000), (3, None, None)]
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in archive_round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("revisit", 2, 2000), 2: ("response", None, 2000), 3: ("response", None, 0)}
    assert {t.name for t in spark.catalog.listTables()} == before
