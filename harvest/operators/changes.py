"""Changes to stored tables: (table, changes) to the next version of the table.

Write the result to a new path and switch over; with a table format that has MERGE the same
keys and expressions go into its clauses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvest.functions.text import record_id


def finish_tasks(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Enter finished runs (``id, crawl_id, source_id, total_items, success_count, failed_count,
    error, finished_at``) into their task rows.

    A run that ended counts as ``success`` whatever its lines did: their failures show in the
    counters. Only a run that broke off (``error``) is ``failed`` and leaves the counters alone.
    """
    done = results.select("id", F.struct(
        "crawl_id", "source_id", "total_items", "success_count", "failed_count", "error",
        "finished_at").alias("r"))
    ended, broke = F.col("r").isNotNull(), F.col("r.error").isNotNull()
    values = {
        "status": F.when(broke, "failed").when(ended, "success").otherwise(F.col("status")),
        "error": F.when(broke, F.col("r.error")).otherwise(F.col("error")),
        "finished_at": F.coalesce("r.finished_at", "finished_at"),
        "config": F.when(ended & ~broke, F.to_json(F.struct(
            F.col("r.crawl_id").alias("crawler_id"), F.col("r.source_id").alias("source_id"))))
        .otherwise(F.col("config")),
    }
    for count in ("total_items", "success_count", "failed_count"):
        values[count] = F.when(ended & ~broke, F.col(f"r.{count}")).otherwise(F.col(count))
    return tasks.join(done, "id", "left").select(*[
        values.get(c, F.col(c)).alias(c) for c in tasks.columns])


def insert_new(table: DataFrame, rows: DataFrame, seq: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Add the rows whose id is new; the second result are the conflicts (409).

    Among rows with the same new id the first by ``seq``, then by content, wins; the others are
    conflicts.
    """
    ids = table.select("id")
    order = ([F.col(seq)] if seq else []) + [F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))]
    numbered = rows.join(ids, "id", "left_anti").withColumn(
        "_n", F.row_number().over(Window.partitionBy("id").orderBy(*order)))
    fresh = numbered.filter("_n = 1").drop("_n")
    clash = rows.join(ids, "id", "left_semi").unionByName(numbered.filter("_n > 1").drop("_n"))
    shape = [c for c in fresh.columns if c in table.columns]
    return table.unionByName(fresh.select(shape), allowMissingColumns=True), clash


def insert_lines(
    lines: DataFrame, rows: DataFrame, sources: DataFrame, path_source: Column,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Add lines under the source named by the path, which replaces the one in the row.

    Results: new table, conflicting rows (409), rows without a source (404).
    """
    owned = rows.withColumn("source_id", path_source)
    ids = sources.select(F.col("id").alias("source_id"))
    table, clash = insert_new(lines, owned.join(ids, "source_id", "left_semi"))
    return table, clash, owned.join(ids, "source_id", "left_anti")


def patch(
    table: DataFrame, changes: DataFrame, now: Column, fields: list[str],
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Change the fields present in each change (``id``, ``changes map<string,string>``); a present
    null overwrites. ``updated_at`` becomes ``now``. Only ``fields`` can be changed, never ``id``.

    Second result: changes for ids that do not exist (404). Third: changes not made, because a value
    doesn't fit its field or an earlier one (by content) changes the same id (422).
    """
    if {"id", "type"} & set(fields):
        raise ValueError("id and type can't be changed")
    kinds = dict(table.dtypes)
    value = {name: F.element_at("changes", name).try_cast(kinds[name]) for name in fields}
    wrong = [F.element_at("changes", name).isNotNull() & value[name].isNull() for name in fields]
    bad = F.coalesce(F.array_max(F.array(*wrong)), F.lit(False)) if wrong else F.lit(False)
    first = Window.partitionBy("id").orderBy("_bad", F.to_json("changes"))
    judged = changes.withColumn("_bad", bad).withColumn("_n", F.row_number().over(first)).join(
        table.select("id"), "id", "left_semi")
    made = judged.filter("NOT _bad AND _n = 1").select("id", F.col("changes").alias("_c"))
    joined = table.join(made, "id", "left")
    touched = F.col("_c").isNotNull()
    values = {name: F.when(
        touched & F.map_contains_key("_c", name),
        F.element_at("_c", name).try_cast(kinds[name])).otherwise(F.col(name)) for name in fields}
    values["updated_at"] = F.when(touched, now).otherwise(F.col("updated_at"))
    out = joined.select(*[values.get(c, F.col(c)).alias(c) for c in table.columns])
    refused = judged.filter("_bad OR _n > 1").drop("_bad", "_n")
    return out, changes.join(table.select("id"), "id", "left_anti"), refused


def delete(
    table: DataFrame, ids: DataFrame, children: list[tuple[DataFrame, str]] = (),
) -> tuple[DataFrame, DataFrame]:
    """Remove rows by id, but none that a child row still refers to (second result)."""
    wanted = ids.select("id").distinct()
    refused = None
    for child, reference in children:
        held = wanted.join(child.select(F.col(reference).alias("id")), "id", "left_semi")
        refused = held if refused is None else refused.unionByName(held)
    if refused is None:
        return table.join(wanted, "id", "left_anti"), wanted.limit(0)
    refused = refused.distinct()
    return table.join(wanted.join(refused, "id", "left_anti"), "id", "left_anti"), refused


def run_log_rows(runs: DataFrame, now: Column) -> DataFrame:
    """One log row per run (``task_id, source_id, total_items, error``)."""
    broke = F.col("error").isNotNull()
    return runs.select(
        record_id(F.col("task_id"), F.lit("end")).alias("id"), "task_id", "source_id",
        F.when(broke, "ERROR").otherwise("INFO").alias("level"),
        F.when(broke, F.concat(F.lit("Crawl failed: "), "error")).otherwise(F.concat(
            F.lit("Crawl completed: "), F.col("total_items").cast("string"), F.lit(" items")))
        .alias("message"),
        now.alias("created_at"))


def task_key() -> Column:
    """Id of the task a trigger starts, the same whenever it is computed."""
    return F.concat(F.lit("ct-"), record_id(F.col("trigger_id"), F.col("source_id")))


def new_tasks(triggers: DataFrame, now: Column) -> DataFrame:
    """Task rows of accepted triggers (``trigger_id, source_id``), running from ``now``."""
    none = F.lit(0).cast("long")
    return triggers.select(
        task_key().alias("id"),
        "source_id", F.lit("running").alias("status"), F.lit("{}").alias("config"),
        none.alias("total_items"), none.alias("success_count"), none.alias("failed_count"),
        F.lit(None).cast("string").alias("error"), now.alias("started_at"),
        F.lit(None).cast("timestamp").alias("finished_at"), now.alias("created_at"))
