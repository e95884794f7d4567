"""Stored results of runs: all tables are written first, then one commit makes them visible together.

Every write goes into folders of its own, ``<table>/commit=<name>/…``, and ends with one row in
``commits``. Readers follow the commits, so a write that broke off is never seen, and a run that was
written twice counts once, by its first commit. Nothing is ever changed in place.

Records lie by source and, inside a file, by task, time and id: a task's records are found by its
commit and source (folders), then by the statistics of the row groups.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harvest.operators.catalog import after_record
from harvest.session import cut_lineage

RECORDS, LOGS, RESULTS, COMMITS = "collected_data", "crawler_logs", "run_results", "commits"


def commits(spark: SparkSession, folder: str) -> DataFrame | None:
    """Names of the finished writes; None before the first one."""
    try:
        return spark.read.schema("commit string").parquet(f"{folder}/{COMMITS}").distinct()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def owners(spark: SparkSession, folder: str) -> DataFrame:
    """(task_id, commit): the first commit of each run."""
    done = commits(spark, folder)
    if done is None:
        return spark.createDataFrame([], "task_id string, commit string")
    results = spark.read.parquet(f"{folder}/{RESULTS}").select("task_id", "commit")
    return results.join(done, "commit", "left_semi").groupBy("task_id").agg(F.min("commit").alias("commit"))


def write_commit(folder: str, records: DataFrame, logs: DataFrame, results: DataFrame) -> str:
    """Store the ``records`` and ``logs`` of the runs in ``results`` (``task_id, source_id``, and any counts).

    Runs that a commit holds already are left out, so a write may be repeated as a whole, whether it
    broke off or not. Returns the commit's name.
    """
    spark = results.sparkSession
    name = f"{int(time.time() * 1000):013d}-{uuid.uuid4().hex}"         # names sort by time
    if commits(spark, folder) is not None:
        known = cut_lineage(results.select("task_id").join(owners(spark, folder), "task_id", "left_semi").distinct())
        if not known.isEmpty():
            results, records, logs = (df.join(known, "task_id", "left_anti").select(df.columns) for df in (results, records, logs))
    results.write.parquet(f"{folder}/{RESULTS}/commit={name}")
    # the hint lets a source that holds much of the data keep many writers
    (records.hint("rebalance", "source_id").sortWithinPartitions("source_id", "task_id", "collected_at", "id")
     .write.partitionBy("source_id").parquet(f"{folder}/{RECORDS}/commit={name}"))
    logs.write.parquet(f"{folder}/{LOGS}/commit={name}")
    # one row in one file: it is there or it isn't
    spark.range(1).select(F.lit(name).alias("commit")).coalesce(1).write.mode("append").parquet(f"{folder}/{COMMITS}")
    return name


def read_stored(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The committed rows of ``collected_data``, ``crawler_logs`` or ``run_results``; raises before the first commit."""
    rows = spark.read.parquet(f"{folder}/{table}")
    return rows.join(owners(spark, folder), ["task_id", "commit"], "left_semi").select([c for c in rows.columns if c != "commit"])


def stored_task_data(
    spark: SparkSession, folder: str, task_id: str, limit: int = 100, after: tuple[Column, Column] | None = None,
) -> DataFrame:
    """A page of a task's records by ``(collected_at, id)``; ``after`` holds both of the last row seen.

    The commit and source of the task come first, out of the small table of results; the records are
    then read from their folders alone.
    """
    results = spark.read.parquet(f"{folder}/{RESULTS}").filter(F.col("task_id") == task_id)
    places = results.join(commits(spark, folder), "commit", "left_semi").select("commit", "source_id").distinct().collect()   # few
    first = min((p["commit"] for p in places), default="")
    sources = [p["source_id"] for p in places if p["commit"] == first]
    here = F.col("source_id").isin([s for s in sources if s is not None])
    if None in sources:
        here = here | F.col("source_id").isNull()
    rows = spark.read.parquet(f"{folder}/{RECORDS}")
    found = rows.filter((F.col("commit") == first) & here & (F.col("task_id") == task_id)).drop("commit")
    if after is not None:
        found = after_record(found, *after)
    return found.orderBy("collected_at", "id").limit(limit)
