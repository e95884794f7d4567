"""Queries and changes over the stored tables; outcomes of attempts and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from harvest.operators import catalog as K
from harvest.operators import changes as M
from harvest.operators import outcome as O
from harvest.operators.frontier import dedup_urls, drop_seen, limit_items
from harvest.sources.store import stored_task_data, write_commit

_NOW = "2024-05-01 12:00:00"


def _now():
    return F.lit(_NOW).cast("timestamp_ntz")


@check("run_duration", """
SELECT id, CASE WHEN status <> 'pending' THEN round(CAST(total_items * 61.25 AS DOUBLE), 1) END AS duration FROM v_tasks""")
def _(t):
    runs = t.tasks.withColumn("started_at", F.col("created_at").cast("timestamp"))
    seconds = F.col("total_items") * 61.25
    finished = F.timestamp_micros(F.unix_micros("started_at") + (seconds * 1_000_000).cast("long"))
    return K.run_duration(runs.withColumn("finished_at", F.when(
        F.col("status") != "pending", finished))).select("id", "duration")


@check("list_lines", "SELECT id, name, url, enabled FROM v_lines WHERE source_id = 'src3'")
def _(t):
    return K.list_lines(t.lines, "src3").select("id", "name", "url", "enabled")


@check("get_source", """
SELECT id, name, type, (SELECT count(*) FROM v_lines WHERE source_id = 'src7') AS line_count
FROM v_sources WHERE id = 'src7'""")
def _(t):
    return K.get_source(t.sources, t.lines, "src7").select("id", "name", "type", "line_count")


@check("get_task", """
SELECT t.id, t.status, coalesce(s.name, t.source_id) AS source_name
FROM v_tasks t LEFT JOIN v_sources s ON s.id = t.source_id WHERE t.id = 'ct-33'""")
def _(t):
    return K.get_task(t.tasks, t.sources, "ct-33").select("id", "status", "source_name")


@check("with_source_name", """
SELECT t.id, coalesce(s.name, t.source_id) AS source_name
FROM v_tasks t LEFT JOIN v_sources s ON s.id = t.source_id""")
def _(t):
    return K.with_source_name(t.tasks, t.sources).select("id", "source_name")


@check("list_sources", """
SELECT s.id, s.enabled, count(l.id) AS line_count FROM v_sources s LEFT JOIN v_lines l ON l.source_id = s.id
WHERE s.enabled GROUP BY s.id, s.enabled""")
def _(t):
    return K.list_sources(t.sources, t.lines, enabled=True).select("id", "enabled", "line_count")


def _triggers(t):
    return t.tasks.select(F.col("id").alias("trigger_id"), "source_id")


def _some_lines(t):
    """All lines, those of every fourth source switched off."""
    return t.lines.join(t.sources.select(F.col("id").alias("source_id"), "i"), "source_id").withColumn(
        "enabled", F.col("enabled") & (F.col("i") % 4 != 1))


_CODE = """CASE WHEN s.id IS NULL THEN 404 WHEN s.id = 'src19' OR s.i % 4 = 1 THEN 400 ELSE 201 END"""


@check("validate_triggers", f"""
SELECT t.id AS trigger_id, {_CODE} AS code FROM v_tasks t LEFT JOIN v_sources s ON s.id = t.source_id""")
def _(t):
    return K.validate_triggers(_triggers(t), t.sources, _some_lines(t)).select("trigger_id", "code")


@check("orphans", "SELECT id, source_id FROM v_tasks WHERE source_id NOT IN (SELECT id FROM v_sources)")
def _(t):
    return K.orphans(t.tasks, t.sources, "source_id").select("id", "source_id")


@check("task_status_counts", """
SELECT count(*) AS task_count, count(*) FILTER (status = 'pending') AS pending,
       count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'success') AS success,
       count(*) FILTER (status = 'failed') AS failed FROM v_tasks""")
def _(t):
    return K.task_status_counts(t.tasks)


@check("stats_overview", """
SELECT (SELECT count(*) FROM v_sources) AS source_count,
       (SELECT count(*) FROM v_sources WHERE enabled) AS enabled_source_count,
       count(*) AS task_count, count(*) FILTER (status = 'pending') AS pending,
       count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'success') AS success,
       count(*) FILTER (status = 'failed') AS failed,
       (SELECT count(*) FROM v_data) AS total_collected_items, (SELECT count(*) FROM v_logs) AS log_count
FROM v_tasks""")
def _(t):
    return K.stats_overview(t.sources, t.tasks, t.data, t.logs)


@check("page_total", "SELECT count(*) AS total FROM v_tasks WHERE status = 'running'")
def _(t):
    return K.page_total(t.tasks, source_id="", status="running")


@check("recent_tasks", """
SELECT t.id, t.source_id, coalesce(s.name, t.source_id) AS source_name, status, total_items,
       strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at
FROM (SELECT * FROM v_tasks ORDER BY created_at DESC, id DESC LIMIT 5) t LEFT JOIN v_sources s ON s.id = t.source_id""")
def _(t):
    return K.recent_tasks(t.tasks, t.sources)


@check("list_tasks", """
SELECT t.id, coalesce(s.name, t.source_id) AS source_name, status, total_items
FROM (SELECT * FROM v_tasks WHERE status = 'success' ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 100) t
LEFT JOIN v_sources s ON s.id = t.source_id""")
def _(t):
    return K.list_tasks(t.tasks, t.sources, source_id="", status="success", offset=100).select(
        "id", "source_name", "status", "total_items")


@check("list_tasks_keyset", """
SELECT id, created_at FROM v_tasks WHERE (created_at, id) < (TIMESTAMP '1998-01-01 00:00:00', 'ct-5')
ORDER BY created_at DESC, id DESC LIMIT 50""")
def _(t):
    return K.older_than(t.tasks, F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"), F.lit("ct-5")).select(
        "id", "created_at")


@check("list_logs", """
SELECT id, task_id, level, message FROM v_logs WHERE level = 'ERROR' ORDER BY created_at DESC, id DESC
LIMIT 100 OFFSET 20""")
def _(t):
    return K.list_logs(t.logs, level="ERROR", offset=20).select("id", "task_id", "level", "message")


@check("task_data", """
SELECT id, title FROM v_data WHERE task_id = 'ct-7' ORDER BY id LIMIT 100 OFFSET 3""")
def _(t):
    data = t.data.withColumn("collected_at", F.lit(_NOW).cast("timestamp_ntz"))
    return K.task_data(data, "ct-7", offset=3).select("id", "title")


@check("task_data_keyset", """
SELECT id, title FROM v_data WHERE task_id = 'ct-7'
  AND id > (SELECT max(id) FROM (SELECT id FROM v_data WHERE task_id = 'ct-7' ORDER BY id LIMIT 3) q) ORDER BY id LIMIT 100""")
def _(t):
    """The page behind the first three records of a task, out of the stored layout."""
    folder = t.new_folder()
    records = t.data.withColumn("collected_at", _now())
    runs = records.select("task_id", "source_id").distinct()
    write_commit(folder, records, runs, runs)
    seen = stored_task_data(t.spark, folder, "ct-7", limit=3).collect()[-1]
    return stored_task_data(t.spark, folder, "ct-7", after=(_now(), F.lit(seen["id"]))).select("id", "title")


@check("result_preview", """
SELECT task_id, CAST(place AS INT) AS place, title, CAST(greatest(n - 5, 0) AS BIGINT) AS more
FROM (SELECT task_id, title, row_number() OVER (PARTITION BY task_id ORDER BY id) AS place,
             count(*) OVER (PARTITION BY task_id) AS n FROM v_data) q WHERE place <= 5""")
def _(t):
    return K.result_preview(t.data.withColumn("url", F.col("id")), ["id"]).drop("url")


# -- attempts, outcomes, schedules -----------------------------------------------------------


@check("resolve_attempts", """
SELECT request_id, CASE WHEN e.status_code < 400 THEN 'ok' ELSE 'failed' END AS outcome, e.status_code AS status_code,
       CASE WHEN e.status_code >= 400 THEN concat('HTTP ', CAST(e.status_code AS VARCHAR), ': ', e.url) ELSE e.error END AS error,
       CAST(e.attempt + 1 AS BIGINT) AS attempts, CAST(e.attempt * 2.0 AS DOUBLE) AS waited
FROM (SELECT request_id, coalesce(
        arg_min({'attempt': attempt, 'status_code': status_code, 'error': error, 'url': url}, attempt) FILTER (status_code < 500),
        arg_max({'attempt': attempt, 'status_code': status_code, 'error': error, 'url': url}, attempt)) AS e
      FROM v_attempts WHERE attempt <= 3 GROUP BY request_id) q""")
def _(t):
    return O.resolve_attempts(t.attempts, retry_max=3, retry_delay=2.0)


@check("rate_schedule", """
SELECT event_id AS request_id, round(CASE WHEN user_id % 20 = 0 THEN a ELSE
         max(a - n * 500.0) OVER (PARTITION BY user_id % 20 ORDER BY a, event_id) + n * 500.0 END, 3) AS start
FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 20 ORDER BY a, event_id) AS n
      FROM (SELECT *, epoch(ts) AS a FROM events) e) q""")
def _(t):
    run = F.col("user_id") % 20
    requests = t.raw("events").select(
        run.alias("run_id"), F.col("event_id").alias("request_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("arrival"),
        F.when(run != 0, F.lit(0.002)).alias("rate_limit"))
    return O.rate_schedule(requests, rows_in_one_task=100).select(
        "request_id", F.round("start", 3).alias("start"))


def _requests(t):
    """Every event asks for an address named by its props, in the order of arrival."""
    return t.raw("events").select(
        (F.col("user_id") % 20).alias("crawl_id"), F.col("user_id").cast("int").alias("task_ord"),
        F.array(F.col("event_id").cast("int")).alias("order_key"),
        F.col("props").alias("url"), F.col("event_id"),
        F.when(F.col("user_id") % 3 == 0, F.lit(None)).otherwise(F.col("user_id") % 7).cast("int").alias("max_items"),
        (F.col("user_id") % 20 != 4).alias("dedup_enabled"))


@check("dedup_urls", """
SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 20, props ORDER BY user_id, event_id) AS n
FROM events) q WHERE n = 1 OR user_id % 20 = 4""")
def _(t):
    return dedup_urls(_requests(t)).select("event_id")


@check("custom_dedup_key", """
SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 20, length(props) ORDER BY user_id, event_id) AS n
FROM events) q WHERE n = 1 OR user_id % 20 = 4""")
def _(t):
    return dedup_urls(_requests(t), key=lambda url: F.length(url)).select("event_id")


@check("limit_items", """
SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 20, user_id ORDER BY event_id) AS n FROM events) q
WHERE user_id % 3 = 0 OR n <= user_id % 7""")
def _(t):
    return limit_items(_requests(t)).select("event_id")


@check("limit_items_weighted", """
SELECT event_id FROM (SELECT *, coalesce(sum(length(props) % 3) OVER (PARTITION BY user_id % 20, user_id ORDER BY event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events) q
WHERE user_id % 3 = 0 OR before < user_id % 7""")
def _(t):
    weighed = _requests(t).withColumn("records", F.length("url") % 3)
    return limit_items(weighed, weight="records", rows_in_one_task=20).select("event_id")


@check("drop_seen", "SELECT event_id FROM events WHERE props NOT IN (SELECT props FROM events WHERE event_type = 'error')")
def _(t):
    seen = t.raw("events").filter("event_type = 'error'").select(F.md5("props").alias("url_key"))
    return drop_seen(_requests(t), seen).select("event_id")


@check("drop_seen_some", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 97 = 0)")
def _(t):
    asked = t.raw("events").select("event_id", F.concat(F.lit("https://x.test/"), F.col("user_id").cast("string")).alias("url"))
    seen = asked.filter("event_id % 97 = 0").select(F.md5("url").alias("url_key"))
    return drop_seen(asked, seen).select("event_id")


# -- changes -----------------------------------------------------------------------------------


def _full_tasks(t):
    null = lambda kind: F.lit(None).cast(kind)
    return t.tasks.select(
        "id", "source_id", "status", F.lit("{}").alias("config"), "total_items",
        F.lit(0).cast("long").alias("success_count"), F.lit(0).cast("long").alias("failed_count"),
        null("string").alias("error"), F.col("created_at").alias("started_at"),
        null("timestamp_ntz").alias("finished_at"), "created_at")


@check("finish_tasks", f"""
SELECT id, CASE WHEN status <> 'running' THEN status WHEN total_items % 2 = 1 THEN 'failed' ELSE 'success' END AS status,
       CASE WHEN status = 'running' AND total_items % 2 = 0 THEN total_items * 10 ELSE total_items END AS total_items,
       CASE WHEN status = 'running' AND total_items % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS success_count,
       CASE WHEN status = 'running' AND total_items % 2 = 0
            THEN concat('{{"crawler_id":"run-', id, '","source_id":"', source_id, '"}}') ELSE '{{}}' END AS config,
       CASE WHEN status = 'running' AND total_items % 2 = 1 THEN 'broke' END AS error,
       CASE WHEN status = 'running' THEN TIMESTAMP '{_NOW}' END AS finished_at
FROM v_tasks""")
def _(t):
    results = t.tasks.filter("status = 'running'").select(
        "id", F.concat(F.lit("run-"), "id").alias("crawl_id"), "source_id",
        (F.col("total_items") * 10).alias("total_items"), F.lit(1).cast("long").alias("success_count"),
        F.lit(0).cast("long").alias("failed_count"),
        F.when(F.col("total_items") % 2 == 1, "broke").alias("error"), _now().alias("finished_at"))
    return M.finish_tasks(_full_tasks(t), results).select(
        "id", "status", "total_items", "success_count", "config", "error", "finished_at")


def _new_sources(t):
    return t.tasks.select(
        F.col("source_id").alias("id"), F.concat(F.lit("New "), "source_id").alias("name"),
        F.col("id").alias("seq"))


@check("insert_new", """
SELECT id, name FROM v_sources UNION ALL
SELECT DISTINCT source_id, concat('New ', source_id) FROM v_tasks WHERE source_id NOT IN (SELECT id FROM v_sources)""")
def _(t):
    return M.insert_new(t.sources.select("id", "name"), _new_sources(t), seq="seq")[0]


@check("insert_new_conflicts", """
SELECT id AS seq FROM (SELECT id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY id) AS n FROM v_tasks) q
WHERE n > 1 OR source_id IN (SELECT id FROM v_sources)""")
def _(t):
    return M.insert_new(t.sources.select("id", "name"), _new_sources(t), seq="seq")[1].select("seq")


@check("insert_lines", """
SELECT id, source_id FROM v_lines UNION ALL SELECT concat('x-', id), id FROM v_sources""")
def _(t):
    rows = t.tasks.select("source_id").distinct().select(
        F.concat(F.lit("x-"), "source_id").alias("id"), F.lit("body").alias("source_id"),
        F.col("source_id").alias("path"))
    return M.insert_lines(t.lines.select("id", "source_id"), rows, t.sources, F.col("path"))[0]


@check("patch", f"""
SELECT id, CASE WHEN i % 2 = 0 THEN concat(name, '!') ELSE name END AS name,
       CASE WHEN i % 4 = 0 THEN NULL ELSE url END AS url, CASE WHEN i % 2 = 0 THEN false ELSE enabled END AS enabled,
       CASE WHEN i % 2 = 0 THEN TIMESTAMP '{_NOW}' END AS updated_at, type FROM v_sources""")
def _(t):
    table = t.sources.withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    base = F.create_map(F.lit("name"), F.concat("name", F.lit("!")), F.lit("enabled"), F.lit("false"),
                        F.lit("type"), F.lit("ignored"))
    null_url = F.create_map(F.lit("url"), F.lit(None).cast("string"))
    changes = t.sources.filter("i % 2 = 0").select("id", F.when(
        F.col("i") % 4 == 0, F.map_concat(base, null_url)).otherwise(base).alias("changes"))
    return M.patch(table, changes, _now(), ["name", "url", "description", "enabled", "meta"][:2] + ["enabled"])[0].select(
        "id", "name", "url", "enabled", "updated_at", "type")


@check("delete", "SELECT id FROM v_sources WHERE id IN (SELECT source_id FROM v_lines)")
def _(t):
    # a source with lines stays
    return M.delete(t.sources, t.sources, [(t.lines, "source_id")])[0].select("id")


@check("delete_lines", "SELECT id FROM v_lines WHERE enabled")
def _(t):
    return M.delete(t.lines, t.lines.filter("NOT enabled"))[0].select("id")


@check("run_log_rows", f"""
SELECT id AS task_id, CASE WHEN status = 'failed' THEN 'ERROR' ELSE 'INFO' END AS level,
       CASE WHEN status = 'failed' THEN 'Crawl failed: no luck'
            ELSE concat('Crawl completed: ', CAST(total_items AS VARCHAR), ' items') END AS message,
       TIMESTAMP '{_NOW}' AS created_at FROM v_tasks""")
def _(t):
    runs = t.tasks.select(F.col("id").alias("task_id"), "source_id", "total_items",
                          F.when(F.col("status") == "failed", "no luck").alias("error"))
    return M.run_log_rows(runs, _now()).drop("id", "source_id")


@check("new_tasks", f"""
SELECT concat('ct-', substr(sha256(concat(id, chr(31), source_id)), 1, 32)) AS id, source_id, 'running' AS status,
       '{{}}' AS config, TIMESTAMP '{_NOW}' AS started_at, TIMESTAMP '{_NOW}' AS created_at FROM v_tasks""")
def _(t):
    return M.new_tasks(_triggers(t), _now()).select("id", "source_id", "status", "config", "started_at", "created_at")


@check("task_item_count", """
SELECT t.id AS task_id, count(d.id) AS item_count FROM v_tasks t LEFT JOIN v_data d ON d.task_id = t.id GROUP BY t.id""")
def _(t):
    return O.task_item_count(t.tasks.select(F.col("id").alias("task_id")), t.data)


@check("run_summary", """
SELECT source_id, sum(total_items)::BIGINT AS total_items, count(*) FILTER (status = 'success') AS success_count,
       count(*) FILTER (status = 'failed') AS failed_count FROM v_tasks GROUP BY source_id""")
def _(t):
    results = t.tasks.withColumnRenamed("total_items", "item_count").withColumn("crawl_id", F.col("source_id"))
    return O.run_summary(results).drop("crawl_id")
