"""Writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvest.operators.changes import run_log_rows
from harvest.operators.extract import truncate_content
from harvest.operators.ordered import number_rows
from harvest.plans.results import CrawlResult
from harvest.session import cut_lineage
from harvest.sources.store import write_commit

DOCUMENT_ITEMS = 1_000


def write_result_json(result: CrawlResult, folder: str) -> None:
    """Runs, tasks and records as three folders of JSON lines, records by source."""
    result.runs.write.json(f"{folder}/runs")
    result.tasks.write.json(f"{folder}/tasks")
    result.items.write.partitionBy("source_id").json(f"{folder}/items")


def task_documents(result: CrawlResult, items_per_document: int = DOCUMENT_ITEMS) -> DataFrame:
    """Nested form: each task with its records in visit order.

    A task with more than ``items_per_document`` records goes on in further documents
    (``part`` 1, 2, …), so no row and no task of the job holds an unbounded list.
    """
    fields = [c for c in result.items.columns if c not in ("crawl_id", "task_ord", "order_key")]
    placed = number_rows(result.items, ["crawl_id", "task_ord"], ["order_key"], "place")
    placed = placed.withColumn("part", F.floor((F.col("place") - 1) / items_per_document).cast("int"))
    lists = placed.groupBy("crawl_id", "task_ord", "part").agg(F.array_sort(F.collect_list(
        F.struct("place", F.struct(*fields).alias("item")))).alias("sorted"))
    lists = lists.select(
        "crawl_id", "task_ord", "part", F.transform("sorted", lambda e: e["item"]).alias("items"))
    return result.tasks.join(lists, ["crawl_id", "task_ord"], "left").withColumns({
        "part": F.coalesce("part", F.lit(0)) + 1,
        "items": F.coalesce("items", F.array().cast(lists.schema["items"].dataType))})


def collected_rows(items: DataFrame, now: Column) -> DataFrame:
    """Records in the form of the stored table ``collected_data``; ``task_id`` is the run's."""
    raw = F.to_json(F.struct("status_code", "published_at_raw"))
    return truncate_content(items).select(
        F.col("item_id").alias("id"), F.col("crawl_id").alias("task_id"), "source_id", "line_id",
        "url", "title", "content", "content_type", raw.alias("raw"), F.lit("{}").alias("meta"),
        now.alias("collected_at"))


def persist_run(
    result: CrawlResult, folder: str, now: Column, broken: DataFrame | None = None,
) -> None:
    """Store the records, one log row and one result row per run, visible together or not at all;
    ``broken`` runs (``task_id, source_id, total_items, error``) get no records.

    May be repeated: runs that are stored already are left out (see :mod:`harvest.sources.store`).
    """
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("total_items", "success_count", "failed_count")]
    runs = result.runs.select(
        F.col("crawl_id").alias("task_id"), "source_id", *counts, F.lit(None).cast("string").alias("error"))
    if broken is not None:
        runs = runs.unionByName(broken.select(
            "task_id", "source_id", F.col("total_items").cast("long").alias("total_items"),
            F.lit(0).cast("long").alias("success_count"), F.lit(0).cast("long").alias("failed_count"), "error"))
    runs = cut_lineage(runs)
    write_commit(folder, collected_rows(result.items, now), run_log_rows(runs, now), runs.withColumn("finished_at", now))
