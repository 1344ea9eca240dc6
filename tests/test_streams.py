"""Growing histories, entries cut by micro-batches, and groups that expire."""

import os
import random
import time

import pytest

from vigil.sources import parsers
from vigil.sources.tail import tail
from vigil.streaming.state import fish_entry_stream, group_stream


@pytest.fixture(autouse=True)
def only_batches_with_data(spark):
    """Timers would have Spark run empty batches for ever; here they are looked
    at whenever there is data."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def drained(df, path, mode="append"):
    """Rows of one run over all there is, from where the last run ended."""
    got = []

    def keep(batch, _):
        got.extend(map(tuple, batch.collect()))

    query = df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    query.awaitTermination()
    return got


def test_restarts_neither_repeat_nor_lose_lines(spark, tmp_path):
    a, b, told = tmp_path / ".a_history", tmp_path / ".b_history", []
    paths = [str(a), str(b)]

    def more():
        found = sorted(drained(tail(spark, paths, part_bytes=16), tmp_path / "c"))
        told.extend(found)
        return [(os.path.basename(f), at, raw) for f, at, raw in found]

    a.write_text("one é\ntwo\nhalf")
    assert more() == [(".a_history", 0, "one é"), (".a_history", 7, "two")]
    with a.open("a") as file:
        file.write(" of it\n" + "x" * 50 + "\n\nend\n")
    b.write_text("late\n")
    assert more() == [(".a_history", 11, "half of it"), (".a_history", 22, "x" * 50), (".a_history", 73, ""), (".a_history", 74, "end"), (".b_history", 0, "late")]
    assert more() == []
    a.write_text("cut\n")  # truncated
    os.rename(b, tmp_path / "b.1")
    b.write_text("rotated\nmore\n")
    assert more() == [(".a_history", 0, "cut"), (".b_history", 0, "rotated"), (".b_history", 8, "more")]
    b.unlink()
    assert more() == []
    assert len(told) == len(set(told)) + 0 == 10


def test_entries_however_the_file_is_cut(spark, tmp_path):
    """Micro-batches of any size give the entries of the whole file; the last
    one is told when nothing follows for a while."""
    draw = random.Random(4)
    text = "  when: 9\n" + "".join(draw.choice(["- cmd: ls é\n", "  when: 12\n", "  when: x\n", "  paths:\n", "- cmd: cd\r\n", "    - p\n"]) for _ in range(60)) + "- cmd: last\n  when: 7\n"
    want = sorted(((c, t) for _, t, _, c in parsers.entries("/h/fish_history", text.encode())), key=repr)
    file = tmp_path / "fish_history"
    file.write_text("")
    stream = fish_entry_stream(tail(spark, [str(file)]), ttl="1 second")
    got, data = [], text.encode()
    cuts = sorted(draw.sample(range(1, len(data)), 3)) + [len(data)]
    for start, end in zip([0, *cuts], cuts):
        with file.open("ab") as out:
            out.write(data[start:end])
        got += drained(stream, tmp_path / "c")
    assert sorted(((c, t) for _, _, t, c in got if c != "last"), key=repr) == [w for w in want if w[0] != "last"]
    # The entry that is still open is told by its timer.
    if not any(c == "last" for *_, c in got):
        time.sleep(2)
        with (tmp_path / "other").open("w") as out:
            out.write("- cmd: x\n")
        both = fish_entry_stream(tail(spark, [str(file), str(tmp_path / "other")]), ttl="1 second")
        got += drained(both, tmp_path / "c")
    assert ("last", 7) in {(c, t) for _, _, t, c in got}


def test_groups_expire(spark, tmp_path):
    rows = [("f", "t", 2), ("f", "t", 3), ("g", "t", 1)]
    source = tmp_path / "in"
    put = lambda rows: spark.createDataFrame(rows, "file string, token string, severity_rank int").coalesce(1).write.mode("append").parquet(str(source))
    put(rows)
    stream = group_stream(spark.readStream.schema("file string, token string, severity_rank int").parquet(str(source)), ttl="1 second")
    assert sorted(drained(stream, tmp_path / "c", "update")) == [("f", "t", 2, 3, False), ("g", "t", 1, 1, False)]
    time.sleep(2)
    put([("g", "t", 2), ("h", "u", 1)])
    assert sorted(r for r in drained(stream, tmp_path / "c", "update") if not r[4] or r[0] == "f") == [("f", "t", 2, 3, True), ("g", "t", 2, 2, False), ("h", "u", 1, 1, False)]
