"""Writes that break off or are repeated, and pages read out of the stored layout."""

import pytest
from pyspark.sql import functions as F

from harvest.sources import store
from harvest.sources.store import read_stored, stored_task_data, write_commit

RECORD = "task_id string, source_id string, id string, title string, collected_at timestamp"


def rows(spark, tasks, per_task=3, title="t"):
    made = spark.createDataFrame([(t, s) for t, s in tasks], "task_id string, source_id string")
    records = made.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(per_task)))).select(
        "task_id", "source_id", F.concat("task_id", F.lit("-"), F.lpad(F.col("k").cast("string"), 6, "0")).alias("id"),
        F.lit(title).alias("title"), F.timestamp_seconds(F.floor(F.col("k") / 2)).alias("collected_at"))
    logs = made.select(F.concat(F.lit("log-"), "task_id").alias("id"), "task_id", "source_id")
    return records, logs, made.withColumn("total_items", F.lit(per_task))


def counts(spark, folder):
    return {t: read_stored(spark, folder, t).count() for t in (store.RECORDS, store.LOGS, store.RESULTS)}


def test_a_broken_write_is_never_seen_and_can_be_repeated(spark, tmp_path):
    folder = str(tmp_path / "out")
    records, logs, results = rows(spark, [("a", "s"), ("b", "s"), ("c", None)])
    broken = logs.withColumn("id", F.when(F.col("id") > "", F.raise_error(F.lit("disk full"))).cast("string"))
    with pytest.raises(Exception, match="disk full"):
        write_commit(folder, records, broken, results)
    assert store.commits(spark, folder) is None and (tmp_path / "out" / store.RECORDS).exists()
    write_commit(folder, records, logs, results)
    first = counts(spark, folder)
    assert first == {store.RECORDS: 9, store.LOGS: 3, store.RESULTS: 3}
    write_commit(folder, records, logs, results)
    assert counts(spark, folder) == first and store.commits(spark, folder).count() == 2


def test_runs_of_a_later_write_that_are_stored_already_are_left_out(spark, tmp_path):
    folder = str(tmp_path / "out")
    write_commit(folder, *rows(spark, [("a", "s")]))
    write_commit(folder, *rows(spark, [("a", "s"), ("b", "s")], title="again"))
    got = {(r.task_id, r.title) for r in read_stored(spark, folder, store.RECORDS).collect()}
    assert got == {("a", "t"), ("b", "again")} and counts(spark, folder)[store.RECORDS] == 6


def test_two_writes_of_one_run_at_once_count_as_the_first(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "out")
    monkeypatch.setattr(store, "commits", lambda *_: None)          # neither sees the other
    write_commit(folder, *rows(spark, [("a", "s")], title="one"))
    write_commit(folder, *rows(spark, [("a", "s"), ("b", "s")], title="two"))
    monkeypatch.undo()
    got = {(r.task_id, r.title) for r in read_stored(spark, folder, store.RECORDS).collect()}
    assert got == {("a", "one"), ("b", "two")} and counts(spark, folder)[store.LOGS] == 2


def test_empty_and_unknown(spark, tmp_path):
    folder = str(tmp_path / "out")
    assert store.owners(spark, folder).count() == 0
    write_commit(folder, *rows(spark, []))
    write_commit(folder, *rows(spark, [("a", "s")]))
    assert counts(spark, folder)[store.RECORDS] == 3 and stored_task_data(spark, folder, "zzz").count() == 0


def test_pages_follow_each_other(spark, tmp_path):
    folder = str(tmp_path / "out")
    write_commit(folder, *rows(spark, [("a", "s"), ("b", "s")], per_task=25))
    write_commit(folder, *rows(spark, [("c", "s")], per_task=5))
    seen, after = [], None
    while True:
        page = stored_task_data(spark, folder, "a", 4, after).collect()
        if not page:
            break
        seen += [r.id for r in page]
        after = (F.lit(page[-1].collected_at), F.lit(page[-1].id))
    assert seen == [f"a-{k:06d}" for k in range(1, 26)]


def test_a_page_reads_only_its_folders_and_row_groups(spark, tmp_path):
    folder = str(tmp_path / "out")
    spark.conf.set("parquet.block.size", "4096")
    spark.conf.set("parquet.page.row.count.limit", "100")
    try:
        write_commit(folder, *rows(spark, [(f"t{k:02d}", f"s{k % 2}") for k in range(20)], per_task=2_000))
    finally:
        spark.conf.unset("parquet.block.size")
        spark.conf.unset("parquet.page.row.count.limit")
    page = stored_task_data(spark, folder, "t07", 10)
    assert [r.id for r in page.collect()] == [f"t07-{k:06d}" for k in range(1, 11)]
    text = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in text and "EqualTo(task_id,t07)" in text
    scan = page._jdf.queryExecution().executedPlan().collectLeaves()
    from_files = [scan.apply(i) for i in range(scan.length())]
    read = sum(s.metrics().apply("numOutputRows").value() for s in from_files if s.metrics().contains("numOutputRows"))
    assert 2_000 <= read < 12_000       # of 40,000 rows
