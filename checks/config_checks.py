"""Documents, settings and tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from harvest.operators import config as C
from harvest.operators.ordered import number_rows
from harvest.plans.job import detect_for_sources
from harvest.sources.documents import read_run_configs, read_sources, read_tables, refused_run_configs

# Request defaults by source type.
_PRESETS = """(VALUES ('website', 30.0::DOUBLE, 3, 2.0::DOUBLE, 3, 2.0::DOUBLE, 3),
  ('api', 30.0, 3, 1.0, 10, NULL, 2), ('file', 120.0, 2, 5.0, 3, NULL, 0),
  ('stream', 0.0, 5, 3.0, 1, NULL, 0), ('external', 60.0, 3, 2.0, 5, NULL, 0))
  p(type, timeout, retry_max, retry_delay, concurrency, rate_limit, n_headers)"""


@check("read_sources", """
SELECT s.id, s.name, s.type, count(l.id) + CASE WHEN count(l.id) = 0 THEN 1 ELSE 0 END AS n_lines,
       CASE WHEN count(l.id) = 0 THEN concat(s.id, '-default-line') ELSE min(l.id) END AS first_line
FROM v_sources s LEFT JOIN v_lines l ON l.source_id = s.id GROUP BY s.id, s.name, s.type""")
def _(t):
    folder = t.new_folder()
    whole = t.nested_sources().drop("i")
    parsed = F.transform("lines", lambda line: line.withField(
        "meta", F.from_json(line["meta"], "struct<extractor_config:struct<link_selectors:array<string>,title_selector:string>,lane:string>")))
    broken = whole.select(F.concat("id", F.lit("-x")).alias("id"), F.lit("odd").alias("type"), "url")
    whole.withColumn("lines", parsed).drop("meta").write.json(f"{folder}/good")
    broken.write.json(f"{folder}/bad")
    accepted, _ = read_sources(t.spark, f"{folder}/*", multiline=False)
    return accepted.select(
        "id", "name", "type", F.size("lines").cast("long").alias("n_lines"),
        F.array_min(F.transform("lines", lambda n: n["id"])).alias("first_line"))


@check("read_sources_refused", "SELECT concat(id, '-x') AS id, 'odd' AS type FROM v_sources")
def _(t):
    folder = t.new_folder()
    t.sources.select("id", "name", "type").write.json(f"{folder}/good")
    t.sources.select(F.concat("id", F.lit("-x")).alias("id"), F.lit("odd").alias("type")).write.json(
        f"{folder}/bad")
    return read_sources(t.spark, f"{folder}/*", multiline=False)[1].select("id", "type")


@check("read_run_configs", """
SELECT concat('run-', source_id) AS crawl_id, id AS task_id, name AS line_name, url,
       item_limit AS max_items, 3 AS retry_max, true AS dedup_enabled, '.list a' AS first_selector
FROM v_lines""")
def _(t):
    folder = t.new_folder()
    task = F.struct(
        F.col("id").alias("task_id"), F.col("id").alias("line_id"), F.col("name").alias("line_name"),
        "url", F.col("item_limit").alias("max_items"),
        F.struct(F.array(F.lit(".list a")).alias("link_selectors")).alias("extractors"))
    (t.lines.groupBy("source_id").agg(F.collect_list(task).alias("tasks"))
     .select(F.concat(F.lit("run-"), "source_id").alias("crawler_id"), "source_id", "tasks")
     .write.json(f"{folder}/runs"))
    return read_run_configs(t.spark, f"{folder}/runs", multiline=False).select(
        "crawl_id", "task_id", "line_name", "url", "max_items", "retry_max", "dedup_enabled",
        F.col("extractors.link_selectors")[0].alias("first_selector"))


def _run_documents(t):
    """A run document for each line: as it should be, with a wrong limit, and with a task that lacks its line."""
    odd = F.when(F.col("k") == 0, F.lit('"line_id":"l","max_items":7.0')).when(
        F.col("k") == 1, F.lit('"line_id":"l","max_items":"many"')).otherwise('"url":5')
    return t.lines.select(F.concat(
        F.lit('{"crawler_id":"'), "id", F.lit('","source_id":"'), "source_id", F.lit('","tasks":[{"task_id":"t",'), odd, F.lit("}]}")).alias("value"))


@check("read_run_configs_refused", """
SELECT id AS crawler_id, source_id, CASE WHEN k = 1 THEN 'tasks[0].max_items: must be a whole number'
       ELSE 'tasks[0].line_id: is missing; tasks[0].url: must be a text' END AS reason FROM v_lines WHERE k > 0""")
def _(t):
    folder = t.new_folder()
    _run_documents(t).write.text(f"{folder}/runs")
    return refused_run_configs(t.spark, f"{folder}/runs", multiline=False).drop("document")


@check("read_run_configs_typed", "SELECT id AS crawl_id, 7 AS max_items FROM v_lines WHERE k = 0")
def _(t):
    folder = t.new_folder()
    _run_documents(t).write.text(f"{folder}/runs")
    return read_run_configs(t.spark, f"{folder}/runs", multiline=False).select("crawl_id", "max_items")


@check("read_sources_reasons", """
SELECT id, CASE i % 3 WHEN 0 THEN 'name: is missing' WHEN 1 THEN 'enabled: must be true or false'
       ELSE 'lines[0].item_limit: must be a whole number' END AS reason FROM v_sources""")
def _(t):
    folder = t.new_folder()
    third = F.col("i") % 3
    odd = F.when(third == 0, F.lit("")).when(third == 1, F.lit('"name":"n","enabled":"maybe",')).otherwise(
        F.lit('"name":"n","lines":[{"id":"l","source_id":"s","name":"n","item_limit":2.5}],'))
    t.sources.select(F.concat(F.lit("{"), odd, F.lit('"type":"api","id":"'), "id", F.lit('"}')).alias("value")).write.text(f"{folder}/in")
    return read_sources(t.spark, f"{folder}/in", multiline=False)[1].select("id", "reason")


@check("plan_tasks_refused", """
SELECT l.id AS line_id, CASE WHEN s.i % 2 = 0 THEN concat('invalid selectors of line ', s.id, '-l0: max_pages: must be a whole number')
       END AS config_error FROM v_lines l JOIN v_sources s ON s.id = l.source_id WHERE l.enabled""")
def _(t):
    bad = F.lit('{"extractor_config":{"link_selectors":["a"],"max_pages":"x"}}')
    lines = F.transform("lines", lambda n, k: n.withField("meta", F.when(
        (F.col("i") % 2 == 0) & (k == 0), bad).otherwise(n["meta"])))
    return C.plan_tasks(t.nested_sources().withColumn("lines", lines)).select("line_id", "config_error")


@check("presets", f"""
SELECT p.type, timeout, retry_max, retry_delay, concurrency, rate_limit, n_headers, count(*) AS sources
FROM v_sources s JOIN {_PRESETS} ON p.type = s.type GROUP BY ALL""")
def _(t):
    presets = C.presets(t.spark).withColumnRenamed("source_type", "type")
    return t.sources.groupBy("type").agg(F.count("*").alias("sources")).join(presets, "type").select(
        "type", "timeout", "retry_max", "retry_delay", "concurrency", "rate_limit",
        F.size("headers").alias("n_headers"), "sources")


@check("with_preset", f"""
SELECT s.id, s.type, p.timeout, p.concurrency FROM v_sources s JOIN {_PRESETS} ON p.type = s.type""")
def _(t):
    return C.with_preset(t.sources).select("id", "type", "preset.timeout", "preset.concurrency")


@check("read_tables", """
SELECT 'sources' AS name, count(*) AS n FROM v_sources UNION ALL
SELECT 'lines', count(*) FROM v_lines UNION ALL SELECT 'crawler_tasks', count(*) FROM v_tasks UNION ALL
SELECT 'collected_data', count(*) FROM v_data UNION ALL SELECT 'crawler_logs', count(*) FROM v_logs""")
def _(t):
    folder = t.new_folder()
    t.sources.drop("i").write.parquet(f"{folder}/sources")
    t.lines.drop("k", "item_limit").write.parquet(f"{folder}/lines")
    t.tasks.withColumn("created_at", F.col("created_at").cast("timestamp")).write.parquet(
        f"{folder}/crawler_tasks")
    t.data.write.parquet(f"{folder}/collected_data")
    t.logs.selectExpr("CAST(id AS STRING) AS id", "task_id", "source_id", "level", "message").write.parquet(
        f"{folder}/crawler_logs")
    tables = read_tables(t.spark, folder, register=False)
    rows = [df.select(F.lit(name).alias("name")) for name, df in tables.items()]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out.groupBy("name").agg(F.count("*").alias("n"))


@check("seeds_to_sources", """
SELECT concat('seed-', CAST(page_id AS STRING)) AS id, url AS name, 'website' AS type, url,
       CASE WHEN page_id % 3 = 0 THEN '{"crawler_build_options":{"concurrency":4,"rate_limit":2.5}}'
            ELSE '{}' END AS meta,
       CASE WHEN page_id % 2 = 0 THEN '{"extractor_config":{"link_selectors":["li a"],"title_selector":"h1"}}'
            ELSE '{}' END AS line_meta,
       CASE WHEN page_id % 2 = 0 THEN 7 END AS item_limit
FROM pages""")
def _(t):
    even, third = F.col("page_id") % 2 == 0, F.col("page_id") % 3 == 0
    seeds = t.raw("pages").select(
        F.concat(F.lit("seed-"), F.col("page_id").cast("string")).alias("id"), "url",
        F.when(third, 4).alias("concurrency"), F.when(third, 2.5).alias("rate_limit"),
        F.when(even, F.array(F.lit("li a"))).otherwise(F.array().cast("array<string>")).alias("link_selectors"),
        F.when(even, "h1").otherwise("").alias("title_selector"), F.when(even, 7).alias("max_items"))
    return C.seeds_to_sources(seeds).select(
        "id", "name", "type", "url", "meta", F.col("lines")[0]["meta"].alias("line_meta"),
        F.col("lines")[0]["item_limit"].alias("item_limit"))


@check("with_default_lines", """
SELECT s.id, coalesce(l.id, concat(s.id, '-default-line')) AS line_id, coalesce(l.name, 'default') AS line_name,
       coalesce(l.url, s.url) AS url
FROM v_sources s LEFT JOIN v_lines l ON l.source_id = s.id""")
def _(t):
    return C.with_default_lines(t.nested_sources()).select("id", F.explode("lines").alias("l")).select(
        "id", F.col("l.id").alias("line_id"), F.col("l.name").alias("line_name"), "l.url")


@check("normalise_line_owner", "SELECT id AS line_id, source_id FROM v_lines")
def _(t):
    return C.normalise_line_owner(t.nested_sources()).select(F.explode("lines").alias("l")).select(
        F.col("l.id").alias("line_id"), "l.source_id")


@check("plan_tasks", """
SELECT concat('run-', source_id) AS crawl_id, CAST(k AS INT) AS task_ord, id AS line_id, name AS line_name, url,
       CAST(item_limit AS INT) AS max_items,
       CASE WHEN k = 1 THEN '' ELSE '.list a' END AS links, CASE WHEN k = 1 THEN '' ELSE 'lane=main' END AS params
FROM v_lines WHERE enabled UNION ALL
SELECT concat('run-', id), 0, concat(id, '-default-line'), 'default', url, NULL, '', ''
FROM v_sources WHERE id NOT IN (SELECT source_id FROM v_lines)""")
def _(t):
    tasks = C.plan_tasks(C.with_default_lines(t.nested_sources()))
    return tasks.select(
        "crawl_id", "task_ord", "line_id", "line_name", "url", "max_items",
        F.array_join("extractors.link_selectors", ",").alias("links"),
        F.array_join(F.transform(F.map_entries("params"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
        .alias("params"))


@check("extract_mode", """
SELECT id AS line_id, CASE WHEN k = 0 THEN 'links' ELSE 'page' END AS mode FROM v_lines WHERE enabled""")
def _(t):
    return C.extract_mode(C.plan_tasks(t.nested_sources())).select("line_id", "mode")


_LAYERED = {
    "meta": '{"crawler_build_options":{"timeout":45,"concurrency":null,"headers":{"X-A":"meta","Accept":"x"},"other":1}}',
    "options": '{"timeout":null,"retry_max":9,"headers":{"X-A":"options","X-B":"b"}}',
    "overrides": '{"rate_limit":null,"retry_delay":0.5,"headers":{"x-a":"low"},"meta":{"k":"v"}}',
}


def _layered(t):
    third = F.col("i") % 3
    return t.sources.withColumns({
        name: F.when(third >= at, text).otherwise("{}")
        for (name, text), at in zip(_LAYERED.items(), (0, 1, 2))})


@check("resolve_run_config", f"""
SELECT s.id, 45.0::DOUBLE AS timeout,
       CASE WHEN s.i % 3 >= 1 THEN 9 ELSE p.retry_max END AS retry_max,
       CASE WHEN s.i % 3 = 2 THEN 0.5::DOUBLE ELSE p.retry_delay END AS retry_delay, p.concurrency,
       CASE WHEN s.i % 3 = 2 THEN NULL ELSE p.rate_limit END AS rate_limit, 'http' AS downloader,
       true AS dedup_enabled, CASE WHEN s.i % 3 = 2 THEN 'v' END AS meta_k
FROM v_sources s JOIN {_PRESETS} ON p.type = s.type""")
def _(t):
    return C.resolve_run_config(_layered(t)).select(
        "id", "timeout", "retry_max", "retry_delay", "concurrency", "rate_limit", "downloader",
        "dedup_enabled", F.element_at("run_meta", "k").alias("meta_k"))


@check("merge_headers", f"""
SELECT s.id, 'x' AS accept, CASE WHEN s.i % 3 >= 1 THEN 'options' ELSE 'meta' END AS xa_upper,
       CASE WHEN s.i % 3 = 2 THEN 'low' END AS xa_lower, CASE WHEN s.i % 3 >= 1 THEN 'b' END AS xb,
       CAST(CASE WHEN n_headers = 0 THEN 2 ELSE n_headers + 1 END + CASE WHEN s.i % 3 >= 1 THEN 1 ELSE 0 END
       + CASE WHEN s.i % 3 = 2 THEN 1 ELSE 0 END AS INT) AS n
FROM v_sources s JOIN {_PRESETS} ON p.type = s.type""")
def _(t):
    h = lambda key: F.element_at("headers", key)
    return C.merge_headers(_layered(t)).select(
        "id", h("Accept").alias("accept"), h("X-A").alias("xa_upper"), h("x-a").alias("xa_lower"),
        h("X-B").alias("xb"), F.size("headers").alias("n"))


def _configs(sources):
    return sources.select("id", F.explode("lines").alias("l")).select(
        "id", F.col("l.id").alias("line_id"),
        F.get_json_object("l.meta", "$.extractor_config.title_selector").alias("title"),
        F.get_json_object("l.meta", "$.extractor_config.link_selectors[0]").alias("link"),
        F.get_json_object("l.meta", "$.lane").alias("lane"))


@check("apply_detected", """
SELECT source_id AS id, id AS line_id, CASE WHEN k = 1 THEN 'h2' ELSE 'h1.title' END AS title,
       CASE WHEN k <> 1 THEN '.list a' END AS link, CASE WHEN k <> 1 THEN 'main' END AS lane
FROM v_lines""")
def _(t):
    found = t.sources.select(
        F.col("id").alias("source_id"), F.array().cast("array<string>").alias("link_selectors"),
        F.lit("h2").alias("title_selector"), F.lit(None).cast("string").alias("time_selector"),
        F.lit(None).cast("string").alias("content_selector"))
    return _configs(C.apply_detected(t.nested_sources(), found).filter(F.size("lines") > 0))


@check("detect_for_sources", """
SELECT id, concat(id, '-default-line') AS line_id, CAST(NULL AS VARCHAR) AS title, 'li a[href]' AS link,
       CAST(NULL AS VARCHAR) AS lane FROM v_sources""")
def _(t):
    sources = t.sources.withColumns({
        "url": F.concat("url", F.lit("list")), "meta": F.lit("{}"),
        "lines": F.lit(None).cast(t.nested_sources().schema["lines"].dataType)})
    return _configs(detect_for_sources(C.with_default_lines(sources), t.site()))


@check("number_rows", """
SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents""")
def _(t):
    docs = t.documents.select("source", "doc_id")
    # small groups on purpose, so that the spread form runs
    return number_rows(docs, ["source"], ["doc_id"], "place", rows_in_one_task=5)


