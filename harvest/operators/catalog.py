"""Queries over the stored tables: sources, lines, runs, collected records and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvest.functions.text import title_preview
from harvest.schemas import TASK_STATES


def run_duration(runs: DataFrame) -> DataFrame:
    """Seconds from start to finish with one decimal; null unless both are known."""
    seconds = F.col("finished_at").cast("double") - F.col("started_at").cast("double")
    return runs.withColumn("duration", F.round(seconds, 1))


def list_lines(lines: DataFrame, source_id: str) -> DataFrame:
    return lines.filter(F.col("source_id") == source_id)


def by_id(table: DataFrame, row_id) -> DataFrame:
    """The row with this id, or no row."""
    return table.filter(F.col("id") == row_id)


def get_source(sources: DataFrame, lines: DataFrame, source_id: str) -> DataFrame:
    return list_sources(by_id(sources, source_id), list_lines(lines, source_id))


def get_task(tasks: DataFrame, sources: DataFrame, task_id: str) -> DataFrame:
    return with_source_name(by_id(tasks, task_id), sources)


def with_source_name(tasks: DataFrame, sources: DataFrame) -> DataFrame:
    """Add the source's name; a task of an unknown source shows the id."""
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return tasks.join(names, "source_id", "left").withColumn(
        "source_name", F.coalesce("source_name", "source_id"))


def list_sources(sources: DataFrame, lines: DataFrame, enabled: bool | None = None) -> DataFrame:
    """Sources with the number of all their lines, enabled or not."""
    counts = lines.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("line_count"))
    kept = sources if enabled is None else sources.filter(F.col("enabled") == enabled)
    return kept.join(counts, "id", "left").fillna(0, ["line_count"])


def validate_triggers(triggers: DataFrame, sources: DataFrame, lines: DataFrame) -> DataFrame:
    """Answer to each trigger: 404 unknown source, 400 no enabled line, 201 accepted."""
    known = sources.select(F.col("id").alias("source_id"), F.lit(True).alias("known"))
    active = lines.filter("enabled").groupBy("source_id").agg(F.count("*").alias("active_lines"))
    return (
        triggers.join(known, "source_id", "left").join(active, "source_id", "left")
        .withColumn("active_lines", F.coalesce("active_lines", F.lit(0)))
        .withColumn("code", F.when(F.col("known").isNull(), 404)
                    .when(F.col("active_lines") == 0, 400).otherwise(201))
        .withColumn("reason", F.when(F.col("code") == 404, "Source not found")
                    .when(F.col("code") == 400, "No enabled lines for this source"))
        .drop("known"))


def orphans(child: DataFrame, parent: DataFrame, reference: str) -> DataFrame:
    """Rows whose ``reference`` names no parent."""
    ids = parent.select(F.col("id").alias(reference))
    return child.join(ids, reference, "left_anti")


def task_status_counts(tasks: DataFrame) -> DataFrame:
    """One row: tasks per known status as columns; other statuses show in the total only."""
    return tasks.agg(F.count("*").alias("task_count"), *[
        F.count_if(F.col("status") == state).alias(state) for state in TASK_STATES])


def stats_overview(
    sources: DataFrame, tasks: DataFrame, data: DataFrame, logs: DataFrame,
) -> DataFrame:
    """One row of counts over all tables.

    Each table gives one row of its own counts; they meet by adding up, not by a join.
    """
    parts = [
        sources.agg(F.count("*").alias("source_count"),
                    F.count_if("enabled").alias("enabled_source_count")),
        task_status_counts(tasks),
        data.agg(F.count("*").alias("total_collected_items")),
        logs.agg(F.count("*").alias("log_count")),
    ]
    names = [c for part in parts for c in part.columns]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.agg(*[F.sum(c).alias(c) for c in names])


def _matching(table: DataFrame, **filters) -> DataFrame:
    """Filters given as None or '' do not apply."""
    for column, value in filters.items():
        if value not in (None, ""):
            table = table.filter(F.col(column) == value)
    return table


def page_total(table: DataFrame, **filters) -> DataFrame:
    """Number of all matching rows beside a page, as a count of its own."""
    return _matching(table, **filters).agg(F.count("*").alias("total"))


def _newest(table: DataFrame) -> DataFrame:
    return table.orderBy(F.desc("created_at"), F.desc("id"))


def _page(ordered: DataFrame, limit: int, offset: int) -> DataFrame:
    return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)


def list_tasks(
    tasks: DataFrame, sources: DataFrame, source_id: str | None = None, status: str | None = None,
    limit: int = 50, offset: int = 0,
) -> DataFrame:
    """A page of tasks, newest first. The page is cut before the names are joined."""
    chosen = _newest(_matching(tasks, source_id=source_id, status=status))
    return with_source_name(_page(chosen, limit, offset), sources)


def list_logs(
    logs: DataFrame, task_id: str | None = None, source_id: str | None = None,
    level: str | None = None, limit: int = 100, offset: int = 0,
) -> DataFrame:
    return _page(_newest(_matching(logs, task_id=task_id, source_id=source_id, level=level)),
                 limit, offset)


def after_record(data: DataFrame, collected_at: Column, row_id: Column) -> DataFrame:
    """Records behind a place in the order ``(collected_at, id)``."""
    return data.filter((F.col("collected_at") > collected_at) | (
        (F.col("collected_at") == collected_at) & (F.col("id") > row_id)))


def task_data(data: DataFrame, task_id: str, limit: int = 100, offset: int = 0,
              after: tuple[Column, Column] | None = None) -> DataFrame:
    """A page of a task's records by ``(collected_at, id)``, so that pages do not overlap.

    ``after`` holds both of the last row seen: the page behind it, without counting off the rows before.
    """
    own = data.filter(F.col("task_id") == task_id)
    if after is not None:
        own = after_record(own, *after)
    return _page(own.orderBy("collected_at", "id"), limit, offset)


def older_than(table: DataFrame, created_at: Column, row_id: Column, limit: int = 50) -> DataFrame:
    """The page after a row, newest first, without counting off the rows before it: deep pages
    cost no more than the first one."""
    behind = (F.col("created_at") < created_at) | (
        (F.col("created_at") == created_at) & (F.col("id") < row_id))
    return _newest(table.filter(behind)).limit(limit)


def recent_tasks(tasks: DataFrame, sources: DataFrame, n: int = 5) -> DataFrame:
    """The newest tasks with their source's name and an ISO time text."""
    newest = _newest(tasks.select("id", "source_id", "status", "total_items", "created_at")).limit(n)
    return with_source_name(newest, sources).withColumn(
        "created_at", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"))


def result_preview(items: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """First ``n`` records of each task with a short title, and how many more there are.

    The rank filter is applied before and after the shuffle, so a task of any size sends at most
    ``n`` rows per partition; the totals are counted apart.
    """
    first = Window.partitionBy("task_id").orderBy(*order)
    shown = items.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= n)
    totals = items.groupBy("task_id").agg(F.count("*").alias("_all"))
    return shown.join(totals, "task_id").select(
        "task_id", "place", title_preview(F.col("title")).alias("title"), "url",
        F.greatest(F.col("_all") - n, F.lit(0)).alias("more"))
