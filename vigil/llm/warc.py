"""Content-addressed WARC archive.

An archive is a folder with two tables. ``records`` has one row per WARC
record: the exact bytes of its header, the SHA-256 of its payload, and the
order it came in. ``payloads`` has each distinct payload once, under its
SHA-256. Joining both on the digest gives back the original records byte for
byte; reading verifies every stored payload against its digest first, rebuilds
the records and parses their bytes.

Writing: a payload that several records share, of ``revisit_bytes`` or more,
is carried by one ``response`` record (the largest page id; among equal page
ids the last row written) and the others become ``revisit`` records that name
it. Shorter payloads are always responses, and are stored once all the same.

Nulls: html null is an empty payload; url null leaves out the target line;
page_id null gives the record id ``urn:page:null`` and ranks below all ids.
Rows that repeat in full each get a record of their own. Other columns are not
archived. A very long payload is one cell, as the page is.

Payloads with the same digest collapse before the shuffle. In the session that
wrote them they can be a bucketed table, so that the join that rebuilds
records moves headers only. A digest with more than HOT records is joined
apart: its records are dealt to one copy of the payload for every HOT of them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import materialize, new_path

#: From this size on, a repeated payload is written as a revisit.
REVISIT_BYTES = 1000
#: Records of one payload that a task joins at most.
HOT = 10_000
#: Bytes of a record that are looked at first for its header's end.
HEAD_BYTES = 1 << 16
_CRLF = "\r\n"


def _line(name: str, value: Column) -> Column:
    """One header line; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF)), F.lit(""))


def _one_line(url: Column) -> Column:
    """White space and controls can't stand in a header line: each is escaped."""
    escaped = F.transform(F.split(url, "", -1), lambda c: F.when(c.rlike(r"[\x00-\x20\x7f]"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c))
    return F.when(url.rlike(r"[\x00-\x20\x7f]"), F.array_join(escaped, "")).otherwise(url)


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def write_archive(
    spark: SparkSession, pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
    date: str = "2024-01-01T00:00:00Z", revisit_bytes: int = REVISIT_BYTES, table: str | None = None,
) -> None:
    """Write one record for each row of ``pages`` to the archive ``path``;
    ``table`` names the payloads in this session, bucketed by digest."""
    payload = F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        _one_line(F.col(url).cast("string")).alias("url"),
        payload.alias("payload"),
    ).withColumns({"sha256": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long")})
    writer = rows.groupBy("sha256").agg(F.first("payload").alias("payload")).write.option("compression", "zstd")
    if table:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        writer.format("parquet").bucketBy(buckets, "sha256").sortBy("sha256").option("path", f"{path}/payloads").saveAsTable(table)
    else:
        writer.parquet(f"{path}/payloads")

    # seq tells rows apart that repeat; it only breaks ties among them.
    slim = rows.select("page_id", "url", "sha256", F.sha1("payload").alias("sha1"), "bytes").withColumn("seq", F.monotonically_increasing_id())
    slim.write.parquet(f"{path}/incoming")
    slim = spark.read.parquet(f"{path}/incoming")
    # All ranks of a digest are compared as sums run: no group is gathered.
    keeper = (
        slim.groupBy("sha256")
        .agg(F.max(F.struct(F.col("page_id").isNotNull().alias("known"), F.col("page_id").alias("id"), F.col("seq").alias("at"))).alias("k"), F.count("*").alias("n"))
        .where(F.col("n") > 1)
        .select(F.col("sha256").alias("digest"), F.col("k.id").alias("keeper"), F.col("k.at").alias("keeper_seq"), "n")
    )
    joined = slim.join(keeper, F.col("sha256") == F.col("digest"), "left")
    revisit = (F.col("bytes") >= revisit_bytes) & F.col("keeper_seq").isNotNull() & (F.col("seq") != F.col("keeper_seq"))
    kind = F.when(revisit, "revisit").otherwise("response")
    header = F.concat(
        F.lit("WARC/1.1" + _CRLF),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.upper("sha1"))),
        _line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("keeper")))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
        F.lit(_CRLF),
    )
    records = joined.select(F.encode(header, "UTF-8").alias("header"), "sha256", "seq", F.coalesce("n", F.lit(1)).alias("copies"))
    records.write.option("compression", "zstd").parquet(f"{path}/records")


def _field(text: Column, name: str) -> Column:
    """Value of a header line, or null."""
    found = F.regexp_extract(text, rf"(?i)\r\n{re.escape(name)}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def _checked(intact: Column, value: Column, what: str, name: Column) -> Column:
    return F.when(intact, value).otherwise(F.raise_error(F.concat(F.lit(f"archive: {what} "), name)))


def read_payloads(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """(sha256, payload) of every payload; a payload that doesn't match the
    digest it is stored under ends the job."""
    stored = spark.table(table) if table else spark.read.parquet(f"{path}/payloads")
    intact = F.sha2("payload", 256) == F.col("sha256")
    return stored.select("sha256", _checked(intact, F.col("payload"), "damaged payload", F.col("sha256")).alias("payload"))


def _restored(spark: SparkSession, path: str, table: str | None) -> DataFrame:
    """Rows of ``records`` with their payloads, and the record's bytes: header,
    block (a revisit's is empty) and the two line breaks that end it."""
    stored, payloads = spark.read.parquet(f"{path}/records"), read_payloads(spark, path, table)
    hot = stored.where(F.col("copies") > HOT)
    parts = F.ceil(F.col("copies") / HOT).cast("int")
    apart = hot.groupBy(F.col("sha256").alias("digest")).agg(F.max(parts).alias("parts"))
    dealt = payloads.join(apart, F.col("sha256") == F.col("digest")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cold = stored.where(F.col("copies") <= HOT).join(payloads, "sha256")
    warm = hot.withColumn("part", F.pmod(F.xxhash64("seq"), parts).cast("int")).join(dealt.select("sha256", "part", "payload"), ["sha256", "part"])
    every = cold.unionByName(warm.select(*cold.columns))
    revisit = F.decode("header", "UTF-8").contains("\r\nWARC-Type: revisit\r\n")
    block = F.when(revisit, F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    return every.select("seq", "sha256", "payload", F.concat("header", block, F.encode(F.lit(_CRLF * 2), "UTF-8")).alias("record"))


def rebuild(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """(seq, record): every record's original bytes."""
    return _restored(spark, path, table).select("seq", "record")


def read_records(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """The records, rebuilt and parsed from their bytes: page_id, record_type,
    refers_to, target_uri, payload_bytes and payload_digest (SHA-1) of the full
    payload, sha256, header and seq. A block that doesn't have the length and
    the digest that its header states ends the job; a revisit's header must
    state the digest of the payload that the join gave."""
    found = _restored(spark, path, table)
    # One character a byte; the first blank line ends the header, which is seldom long.
    blank = lambda part: F.locate("\r\n\r\n", F.decode(part, "ISO-8859-1"))
    near = blank(F.substring("record", F.lit(1), F.lit(HEAD_BYTES)))
    found = found.withColumn("size", F.when(near > 0, near).otherwise(blank(F.col("record"))) + 3)
    found = found.select(
        "seq", "sha256", "payload", F.substring("record", F.lit(1), F.col("size")).alias("header"),
        F.substring("record", F.col("size") + 1, F.octet_length("record") - F.col("size") - 4).alias("block"),
    )
    text = F.decode("header", "UTF-8")
    number = lambda name: F.regexp_extract(F.coalesce(_field(text, name), F.lit("")), r"<urn:page:(-?[0-9]+)>", 1)
    as_id = lambda name: F.when(number(name) != "", number(name)).cast("long")
    kind = _field(text, "WARC-Type")
    full = F.when(kind == "revisit", F.col("payload")).otherwise(F.col("block"))
    parsed = found.select(
        as_id("WARC-Record-ID").alias("page_id"), kind.alias("record_type"), as_id("WARC-Refers-To").alias("refers_to"), _field(text, "WARC-Target-URI").alias("target_uri"),
        F.octet_length(full).cast("long").alias("payload_bytes"), F.sha1(full).alias("payload_digest"), "sha256", "header", "seq",
        F.octet_length("block").cast("string").alias("_length"), _field(text, "Content-Length").alias("_stated"), _field(text, "WARC-Payload-Digest").alias("_digest"),
    )
    sound = (F.col("_length") == F.col("_stated")) & (F.col("_digest").isNull() | (F.col("_digest") == F.concat(F.lit("sha1:"), F.upper("payload_digest"))))
    digest = _checked(F.coalesce(sound, F.lit(False)), F.col("payload_digest"), "damaged record", F.col("seq").cast("string"))
    return parsed.withColumn("payload_digest", digest).drop("_length", "_stated", "_digest")


def import_records(spark: SparkSession, files: DataFrame, path: str, record: str = "record") -> None:
    """Put records given as bytes (one a row, as ``rebuild`` returns them) into
    an archive: the header is kept as it is, the block becomes the payload."""
    data = F.col(record)
    hexed = F.hex(data)
    # The first blank line ends the header; hex keeps the search on bytes.
    at = F.expr("regexp_instr(hexed, '^(?:..)*?0D0A0D0A')")
    size = F.length(F.regexp_extract("hexed", "^((?:..)*?0D0A0D0A)", 1)) / 2
    rows = files.select(data.alias("record"), hexed.alias("hexed")).where(at > 0).withColumn("head", size.cast("int"))
    rows = rows.select(
        F.substring("record", F.lit(1), F.col("head")).alias("header"),
        F.substring("record", F.col("head") + 1, F.octet_length("record") - F.col("head") - 4).alias("payload"),
        F.monotonically_increasing_id().alias("seq"),
    ).withColumn("sha256", F.sha2("payload", 256))
    rows.groupBy("sha256").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    counts = rows.groupBy("sha256").agg(F.count("*").alias("copies"))
    rows.select("header", "sha256", "seq").join(counts, "sha256").write.option("compression", "zstd").parquet(f"{path}/records")


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a new archive in the shared folder and read it back.
    The table that names the payloads in this session goes once the rows are
    read; the archive stays."""
    path = new_path(spark, "warc")
    table = f"vigil_warc_{path.rsplit('-', 1)[-1]}"
    write_archive(spark, pages, path, table=table)
    try:
        return materialize(spark, read_records(spark, path, table), "warc-rows")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
