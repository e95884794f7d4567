"""Triggered runs over the stored tables, and runs from bare addresses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvest.operators.catalog import validate_triggers
from harvest.operators.changes import finish_tasks, insert_new, new_tasks, task_key
from harvest.operators.config import (
    apply_detected, normalise_line_owner, plan_tasks, resolve_run_config, seeds_to_sources,
    with_default_lines)
from harvest.operators.detect import detect_selectors
from harvest.plans.crawl import crawl
from harvest.plans.results import CrawlResult
from harvest.session import cut_lineage
from harvest.sources.sinks import persist_run


def run_sources(
    sources: DataFrame, pages: DataFrame, lines: DataFrame | None = None, missing: str = "fail",
    extractor=None,
) -> CrawlResult:
    """Resolve settings of all sources, plan their tasks and run them.

    Options and overrides travel as columns, see :func:`harvest.operators.config.with_run_options`.
    """
    whole = normalise_line_owner(with_default_lines(sources))
    config = resolve_run_config(whole)
    return crawl(plan_tasks(config, lines), pages, missing, extractor)


def detect_for_sources(sources: DataFrame, pages: DataFrame, detector=None) -> DataFrame:
    """Detect selectors on each source's own page and write them into its lines.

    Link and record selectors both come from that one page. Sources sharing an address share
    its detection: the pages meet the distinct addresses only.
    """
    addresses = sources.filter(F.coalesce("url", F.lit("")) != "").select("url").distinct()
    found = detect_selectors(pages.join(addresses, "url"), detector)
    of_source = sources.select(F.col("id").alias("source_id"), F.col("url").alias("page_url")).join(
        found, "page_url").drop("page_url")
    return apply_detected(sources, of_source)


def auto_crawl(seeds: DataFrame, pages: DataFrame, missing: str = "fail") -> CrawlResult:
    """Addresses to records: one source per seed, selectors detected, then run."""
    return run_sources(detect_for_sources(seeds_to_sources(seeds), pages), pages, missing=missing)


@dataclass
class JobResult:
    answers: DataFrame      # one row per trigger: accepted or why not
    tasks: DataFrame        # next version of the task table
    result: CrawlResult


def _new_only(answers: DataFrame, given: list[str], tasks: DataFrame) -> DataFrame:
    """Answers with 409 for an accepted trigger whose task exists, or that repeats another one."""
    key = task_key()
    first = Window.partitionBy("_key").orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in given])))
    there = tasks.select(F.col("id").alias("_key")).distinct().withColumn("_there", F.lit(True))
    numbered = answers.withColumn("_key", key).withColumn("_n", F.row_number().over(first)).join(there, "_key", "left")
    again = (F.col("code") == 201) & (F.col("_there").isNotNull() | (F.col("_n") > 1))
    return numbered.withColumns({
        "reason": F.when(again, F.lit("Task exists already")).otherwise(F.col("reason")),
        "code": F.when(again, F.lit(409)).otherwise(F.col("code"))}).drop("_key", "_n", "_there")


def run_job(
    triggers: DataFrame, sources: DataFrame, lines: DataFrame, tasks: DataFrame, pages: DataFrame,
    folder: str, now: Column, missing: str = "fail",
) -> JobResult:
    """Check triggers (``trigger_id, source_id``, optional ``overrides`` JSON), enter their tasks
    as running, run the accepted ones together, store records and logs, finish the tasks. A run
    whose settings are invalid is not started: its task and log say why. A trigger whose task
    exists, or that comes twice, is answered 409 and not run again.

    ``lines`` needs ``line_ord``. The caller writes ``JobResult.tasks`` as the new task table.
    """
    answers = cut_lineage(_new_only(validate_triggers(triggers, sources, lines), triggers.columns, tasks))
    accepted = answers.filter("code = 201")
    started = cut_lineage(new_tasks(accepted, now))
    opened, _ = insert_new(tasks, started)

    extra = [c for c in ("overrides",) if c in triggers.columns]
    named = accepted.select("source_id", *extra, task_key().alias("crawl_id"))
    chosen = sources.join(named.withColumnRenamed("source_id", "id"), "id")
    config = cut_lineage(resolve_run_config(chosen))
    planned = cut_lineage(plan_tasks(config, lines.filter("enabled")))
    # settings first, then the selectors of lines; a run without tasks keeps its own error
    wrong = planned.groupBy("crawl_id").agg(F.first("config_error").alias("_wrong"))
    judged = config.join(wrong, "crawl_id", "left").withColumn("config_error", F.coalesce("config_error", "_wrong"))
    broken = judged.filter("config_error IS NOT NULL").select(
        F.col("crawl_id").alias("id"), "crawl_id", F.col("id").alias("source_id"),
        *[F.lit(0).cast("long").alias(c) for c in ("total_items", "success_count", "failed_count")],
        F.col("config_error").alias("error"), now.alias("finished_at"))
    result = crawl(planned.filter("config_error IS NULL"), pages, missing)
    finished = result.runs.select(
        F.col("crawl_id").alias("id"), "crawl_id", "source_id", "total_items", "success_count",
        "failed_count", F.lit(None).cast("string").alias("error"), now.alias("finished_at"))
    finished = finished.unionByName(broken)
    persist_run(result, folder, now, broken.withColumnRenamed("id", "task_id"))
    return JobResult(answers, finish_tasks(opened, finished), result)
