"""The command corpus over any number of tasks."""

from vigil.plans import corpora


def test_tasks_grow_with_the_rows(spark, tmp_path, monkeypatch):
    """A table of one file was read by as many tasks as ran at once, however large."""
    spark.range(95).withColumnRenamed("id", "o_orderkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(corpora, "TASK_ROWS", 10)
    rows = corpora.commands(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 10
    assert sorted(r.key for r in rows.select("key").collect()) == list(range(95))


def test_conditions_on_commands_stay_above_the_shuffle_and_dont_make_them_again(spark):
    """They went below it, into the few tasks that read the table, and each
    test in them made the command anew."""
    import __spark_entry__

    plan = __spark_entry__.queries()["anti_rule_table"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Repartition", 1)
    assert "Filter" in above and "Filter" not in below.split("Relation", 1)[0]
    assert above.count("md5(") == 1
