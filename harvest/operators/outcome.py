"""What became of requests, tasks and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvest.operators.ordered import OrderedGroups

TASK = ["crawl_id", "task_ord"]


def resolve_attempts(
    log: DataFrame, retry_max: int | Column = 3, retry_delay: float | Column = 1.0,
) -> DataFrame:
    """Fold an attempt log (``request_id, url, attempt, status_code, error``) to one row per request.

    Below 400 succeeds and 4xx fails at once; 5xx and errors are tried again, ``retry_max`` times
    at most, after a fixed delay each time. An exhausted request ends with its last attempt. Both
    settings may be columns of the log, one value per request.
    """
    final = F.col("status_code") < 500
    delay = retry_delay if isinstance(retry_delay, Column) else F.lit(float(retry_delay))
    tried = log.filter(F.col("attempt") <= retry_max).withColumn("_delay", delay)
    row = F.struct("attempt", "status_code", "error", "url", "_delay")
    folded = tried.groupBy("request_id").agg(
        F.min_by(row, F.when(final, F.col("attempt"))).alias("hit"), F.max_by(row, "attempt").alias("last"))
    ended = F.coalesce("hit", "last")
    return folded.select("request_id", ended.alias("e")).select(
        "request_id",
        F.when(F.col("e.status_code") < 400, "ok").otherwise("failed").alias("outcome"),
        F.col("e.status_code").alias("status_code"),
        F.when(F.col("e.status_code") >= 400, F.format_string("HTTP %d: %s", "e.status_code", "e.url"))
        .otherwise(F.col("e.error")).alias("error"),
        (F.col("e.attempt") + 1).cast("long").alias("attempts"),
        (F.col("e.attempt") * F.col("e._delay")).alias("waited"),
    )


def task_outcome(tasks: DataFrame, failures: DataFrame, item_counts: DataFrame) -> DataFrame:
    """Status of each task: one failed fetch fails it, with the first error in visit order and
    no items; everything else succeeds, also with nothing found.

    ``failures``: task columns, ``stage, at, error``; ``item_counts``: task columns, ``item_count``.
    """
    first = failures.groupBy(*TASK).agg(F.min(F.struct("stage", "at", "error"))["error"].alias("error"))
    return (
        tasks.join(first, TASK, "left").join(item_counts, TASK, "left")
        .withColumn("status", F.when(F.col("error").isNull(), "success").otherwise("failed"))
        .withColumn("item_count", F.when(
            F.col("error").isNull(), F.coalesce("item_count", F.lit(0))).otherwise(F.lit(0)).cast("long")))


def task_item_count(tasks: DataFrame, items: DataFrame) -> DataFrame:
    """Items per task, 0 where there are none (``task_id`` on both sides)."""
    counts = items.groupBy("task_id").agg(F.count("*").alias("item_count"))
    return tasks.join(counts, "task_id", "left").fillna(0, ["item_count"])


def run_summary(task_results: DataFrame) -> DataFrame:
    """Items, successful and failed tasks of each run."""
    return task_results.groupBy("crawl_id", "source_id").agg(
        F.sum("item_count").alias("total_items"),
        F.count_if(F.col("status") == "success").alias("success_count"),
        F.count_if(F.col("status") == "failed").alias("failed_count"))


def rate_schedule(requests: DataFrame, rows_in_one_task: int | None = None) -> DataFrame:
    """Earliest start of each request under its run's ``rate_limit`` (requests per second).

    ``requests``: ``run_id, request_id, arrival`` (seconds, double), ``rate_limit``. Each start is
    the later of the arrival and one interval after the start before it; no rate, no wait. Since
    start_i - i/rate = max over j <= i of (arrival_j - j/rate), a running maximum gives it, also
    in blocks for a run too large for one task.
    """
    if not requests.filter("rate_limit <= 0").isEmpty():
        raise ValueError("rate_limit must be positive")
    interval = F.lit(1.0) / F.col("rate_limit")
    groups = OrderedGroups(requests, ["run_id"], ["arrival", "request_id"], rows_in_one_task)
    groups.running("_place", F.lit(1).cast("long"))
    groups.running("_lead", F.coalesce(
        F.col("arrival") - F.col("_place") * interval, F.col("arrival")), "max")
    return groups.frame().withColumn("start", F.when(
        F.col("rate_limit").isNull(), F.col("arrival")).otherwise(
        F.col("_lead") + F.col("_place") * interval)).drop("_place", "_lead")
