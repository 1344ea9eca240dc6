from pyspark.sql import functions as F

from vigil import sinks


def test_prompt_histories_by_the_end_of_their_path(spark):
    ends = ("/.codex/history.jsonl", "/.claude/history.jsonl", "/.ollama/history", "/.aider.input.history")
    yes = ["/home/u" + e for e in ends] + ["C:\\Users\\u" + e.replace("/", "\\") for e in ends]
    no = ["/home/u/.zsh_history", "/tmp/history.jsonl", "/home/u/.codex/history.jsonl/x", "/home/u/.ollama/history.bak", "<env>"]
    rows = spark.createDataFrame([(f,) for f in yes + no], "file string")
    got = [r.file for r in rows.where(sinks.from_prompt_history(F.col("file"))).collect()]
    assert sorted(got) == sorted(yes)
    for f in yes:
        assert sinks.needs_transcript_warning(rows.where(F.col("file") == f))
