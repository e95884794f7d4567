"""Frontier operators, whole runs, jobs and streams on the site built from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.page_checks import _H1, _HREFS, _SITE_OF, _fetched
from checks.registry import check, kept
from harvest.operators import extract as E
from harvest.operators import frontier as R
from harvest.plans.job import auto_crawl, run_job
from harvest.plans.results import CrawlResult
from harvest.sources.store import read_stored
from harvest.streaming.status import LiveStatus, stream_status
from harvest.sources import sinks
from harvest.sources.pages import as_pages
from harvest.sources.site import detail_pages
from harvest.streaming import streams as S

_NOW = "2024-05-01 12:00:00"


# -- single steps ------------------------------------------------------------------------------


@check("fetch", """
SELECT url, 200 AS status_code, md5(url) AS key, CAST(NULL AS VARCHAR) AS error FROM x_docs
UNION ALL SELECT concat(url, '-gone'), 404, md5(concat(url, '-gone')), concat('HTTP 404: ', url, '-gone') FROM x_docs""")
def _(t):
    url = detail_pages(t.documents).select("url")
    gone = url.select(F.concat("url", F.lit("-gone")).alias("url"))
    wanted = url.unionByName(gone).withColumn("key", F.md5("url"))
    return R.fetch(wanted, t.site()).select("url", "status_code", "key", "error")


@check("fetch_missing_empty", """
SELECT concat(url, '-gone') AS url, 200 AS status_code, '' AS html FROM x_docs""")
def _(t):
    gone = detail_pages(t.documents).select(F.concat("url", F.lit("-gone")).alias("url"))
    return R.fetch(gone, t.site(), missing="empty").select("url", "status_code", "html")


@check("custom_fetch", """
SELECT url, CASE WHEN doc_id % 97 = 0 THEN 500 WHEN doc_id % 89 = 0 THEN 0 ELSE 203 END AS status_code,
       CASE WHEN doc_id % 97 = 0 THEN concat('HTTP 500: ', url) WHEN doc_id % 89 = 0 THEN 'reset' END AS error,
       concat(url, '#moved') AS response_url FROM x_docs""")
def _(t):
    number = F.regexp_extract("url", "([0-9]+)$", 1).cast("long")
    provider = as_pages(detail_pages(t.documents).withColumns({
        "status_code": F.when(number % 97 == 0, 500).when(number % 89 == 0, 0).otherwise(203),
        "error": F.when((number % 89 == 0) & (number % 97 != 0), "reset"),
        "response_url": F.concat("url", F.lit("#moved"))}))
    return R.fetch(provider.select("url"), provider).select("url", "status_code", "error", "response_url")


@check("expand_level", """
SELECT l.source AS crawl_id, concat('0,', CAST(l.k - 1 AS VARCHAR), ',', CAST((d.r - 1) % 10 AS VARCHAR)) AS order_key, d.url
FROM x_listings l JOIN x_docs d ON d.source = l.source AND (d.r + 9) // 10 = l.k""")
def _(t):
    page = F.coalesce(F.nullif(F.regexp_extract("url", "page=([0-9]+)", 1), F.lit("")).cast("int"), F.lit(1))
    frontier = t.listings().select(
        F.regexp_extract("url", "//([a-z0-9]+)", 1).alias("crawl_id"), F.array(F.lit(0)).alias("order_key"),
        (page - 1).alias("page_no"), "url")
    reached = R.expand_level(frontier, E.extract_links(t.listings(), ".list a"))
    return reached.select("crawl_id", F.array_join("order_key", ",").alias("order_key"), "url")


_WALK = """
SELECT a.url AS start, CAST(CASE WHEN b.k >= a.k THEN b.k - a.k ELSE b.k - a.k + a.last END AS INT) AS page_no, b.url
FROM x_listings a JOIN x_listings b ON b.source = a.source AND (b.k >= a.k OR a.i % 2 = 1)"""


@check("paginate", _WALK)
def _(t):
    return R.paginate(t.listings().select(F.col("url").alias("start")),
                      t.stored(E.next_link(t.listings(), "a.next-page")))


@check("paginate_max_pages", f"SELECT * FROM ({_WALK}) w WHERE page_no < 3")
def _(t):
    return R.paginate(t.listings().select(F.col("url").alias("start")),
                      t.stored(E.next_link(t.listings(), "a.next-page")), max_pages=3)


@check("union_frontiers", """
SELECT url, count(*) AS n FROM (SELECT url FROM x_docs UNION ALL SELECT url FROM x_docs UNION ALL SELECT url FROM x_listings) q
GROUP BY url""")
def _(t):
    links = E.extract_links(t.listings(), ".list a").select(F.col("target_url").alias("url"))
    return R.union_frontiers(links, t.details().select("url"), t.listings().select("url")).groupBy("url").agg(
        F.count("*").alias("n"))


@check("collect_items", """
SELECT url, 'the line' AS title FROM x_listings
UNION ALL SELECT url, concat('Doc ', CAST(doc_id AS VARCHAR)) FROM x_docs""")
def _(t):
    return R.collect_items(
        E.page_items(_fetched(t.listings())), E.data_items(_fetched(t.details()), title="h1")).select("url", "title")


# -- whole runs --------------------------------------------------------------------------------

_ITEM = """SELECT source AS source_id, {line} AS line_id, url, concat('Doc ', CAST(doc_id AS VARCHAR)) AS title,
 md5(text) AS body, lang AS published_at_raw FROM x_docs WHERE {where}"""
_PLAIN = _ITEM.format(line="CASE WHEN r <= 15 THEN 'l0' ELSE 'l1' END", where="r <= 27")


def _items(result):
    return result.items.select(
        "source_id", "line_id", "url", "title", F.md5("content").alias("body"), "published_at_raw")


@check("crawl", _PLAIN)
def _(t):
    return _items(t.crawled())


@check("crawl_tasks", """
SELECT concat(source, '-', line) AS task_id, 'success' AS status, CAST(n AS BIGINT) AS item_count FROM (
  SELECT source, 'l0' AS line, least(count(*), 15) AS n FROM documents GROUP BY source UNION ALL
  SELECT source, 'l1', least(greatest(count(*) - 15, 0), 12) FROM documents GROUP BY source) q""")
def _(t):
    return t.crawled().tasks.select("task_id", "status", "item_count")


@check("crawl_runs", """
SELECT source AS source_id, CAST(least(count(*), 27) AS BIGINT) AS total_items, 2::BIGINT AS success_count,
       0::BIGINT AS failed_count FROM documents GROUP BY source""")
def _(t):
    return t.crawled().runs.drop("crawl_id")


@check("crawl_two_level", _PLAIN)
def _(t):
    return _items(t.crawled("two level", front=True))


@check("crawl_unlimited", _ITEM.format(line="'l0'", where="true"))
def _(t):
    return _items(t.crawled("unlimited", limits=(None, None)))


@check("crawl_max_pages", _ITEM.format(line="'l0'", where="r <= 20"))
def _(t):
    return _items(t.crawled("max pages", limits=(None, None), max_pages=2))


@check("crawl_single_page", _ITEM.format(line="'l0'", where="r <= 10"))
def _(t):
    return _items(t.crawled("single page", limits=(None,), follow=False))


@check("crawl_no_dedup", _ITEM.format(line="'l0'", where="r <= 15") + " UNION ALL "
       + _ITEM.format(line="'l1'", where="r <= 12"))
def _(t):
    return _items(t.crawled("no dedup", dedup=False))


def _holed(t):
    number = F.regexp_extract("url", "/doc/([0-9]+)$", 1)
    return kept(t, "holed", lambda: t.stored(t.site().filter((number == "") | (number.cast("long") % 97 != 0))))


@check("crawl_missing_empty", """
SELECT source AS source_id, line AS line_id, url,
       CASE WHEN doc_id % 97 = 0 THEN line ELSE concat('Doc ', CAST(doc_id AS VARCHAR)) END AS title,
       CASE WHEN doc_id % 97 = 0 THEN md5('') ELSE md5(text) END AS body,
       CASE WHEN doc_id % 97 <> 0 THEN lang END AS published_at_raw
FROM (SELECT *, CASE WHEN r <= 15 THEN 'l0' ELSE 'l1' END AS line FROM x_docs WHERE r <= 27) q""")
def _(t):
    return _items(t.crawled("missing empty", pages=_holed(t), missing="empty"))


_FATE = """
SELECT source, min(r) FILTER (doc_id % 97 = 0 AND r <= 27) AS bad,
       arg_min(url, r) FILTER (doc_id % 97 = 0 AND r <= 27) AS bad_url, count(*) AS n FROM x_docs GROUP BY source"""


@check("crawl_missing_fail", f"""
SELECT d.source AS source_id, CASE WHEN r <= 15 THEN 'l0' ELSE 'l1' END AS line_id, url,
       concat('Doc ', CAST(doc_id AS VARCHAR)) AS title, md5(text) AS body, lang AS published_at_raw
FROM x_docs d JOIN ({_FATE}) f ON f.source = d.source
WHERE r <= 27 AND (bad IS NULL OR (bad > 15 AND r <= 15))""")
def _(t):
    return _items(t.crawled("missing fail", pages=_holed(t)))


@check("task_outcome", f"""
SELECT concat(source, '-l0') AS task_id, CASE WHEN bad <= 15 THEN 'failed' ELSE 'success' END AS status,
       CASE WHEN bad <= 15 THEN concat('HTTP 404: ', bad_url) END AS error,
       CAST(CASE WHEN bad <= 15 THEN 0 ELSE least(n, 15) END AS BIGINT) AS item_count FROM ({_FATE}) f
UNION ALL
SELECT concat(source, '-l1'), CASE WHEN bad IS NOT NULL THEN 'failed' ELSE 'success' END,
       CASE WHEN bad IS NOT NULL THEN concat('HTTP 404: ', bad_url) END,
       CAST(CASE WHEN bad IS NOT NULL THEN 0 ELSE least(greatest(n - 15, 0), 12) END AS BIGINT) FROM ({_FATE}) f""")
def _(t):
    return t.crawled("missing fail", pages=_holed(t)).tasks.select("task_id", "status", "error", "item_count")


def _two_records(row):
    return [{"title": f"{row['line_name']}-{n}", "content": row["html"][n:]} for n in range(2)]


@check("crawl_custom_extractor", """
SELECT url, line AS line_id, concat(line, '-', CAST(n AS VARCHAR)) AS title FROM (
  SELECT url, CASE WHEN r <= 8 THEN 'l0' ELSE 'l1' END AS line, unnest([0, 1]) AS n, r FROM x_docs WHERE r <= 10) q
WHERE NOT (r = 8 AND n = 1)""")
def _(t):
    # 15 records are reached within the eighth page, whose second record is cut off
    result = t.crawled("extractor", extractor=_two_records, limits=(15, 12), follow=False)
    return result.items.select("url", "line_id", "title")


@check("write_result_json", """
SELECT source AS source_id, url, md5(text) AS body FROM x_docs WHERE r <= 27""")
def _(t):
    folder = t.new_folder()
    sinks.write_result_json(t.crawled(), folder)
    return t.spark.read.json(f"{folder}/items").select("source_id", "url", F.md5("content").alias("body"))


@check("task_documents", """
SELECT concat(source, '-', line) AS task_id, CAST(p + 1 AS INT) AS part, count(url) AS n, min(url) AS first_url FROM (
  SELECT source, 'l0' AS line, (r - 1) // 4 AS p, url FROM x_docs WHERE r <= 15 UNION ALL
  SELECT source, 'l1', (r - 16) // 4, url FROM x_docs WHERE r BETWEEN 16 AND 27 UNION ALL
  SELECT source, 'l1', 0, NULL FROM x_docs GROUP BY source) q
GROUP BY source, line, p""")
def _(t):
    return sinks.task_documents(t.crawled(), items_per_document=4).select(
        "task_id", "part", F.size("items").cast("long").alias("n"),
        F.array_min(F.transform("items", lambda i: i["url"])).alias("first_url"))


_PERSISTED = f"""
SELECT concat('run-', source) AS task_id, source AS source_id, url, md5(substr(text, 1, 10000)) AS body,
       concat('{{"status_code":200,"published_at_raw":"', lang, '"}}') AS raw FROM x_docs WHERE r <= 27
UNION ALL SELECT concat('run-', source), source, 'log INFO',
       md5(concat('Crawl completed: ', CAST(least(count(*), 27) AS VARCHAR), ' items')), NULL FROM documents GROUP BY source"""


def _persisted(t, folder):
    rows = read_stored(t.spark, folder, "collected_data").select(
        "task_id", "source_id", "url", F.md5("content").alias("body"), "raw")
    logs = read_stored(t.spark, folder, "crawler_logs").select(
        "task_id", "source_id", F.concat(F.lit("log "), "level").alias("url"),
        F.md5("message").alias("body"), F.lit(None).cast("string").alias("raw"))
    return rows.unionByName(logs)


@check("persist_run", _PERSISTED)
def _(t):
    folder = t.new_folder()
    sinks.persist_run(t.crawled(), folder, F.lit(_NOW).cast("timestamp"))
    return _persisted(t, folder)


@check("persist_run_again", _PERSISTED)
def _(t):
    # a write that breaks off between its tables, then two whole ones
    folder, whole, now = t.new_folder(), t.crawled(), F.lit(_NOW).cast("timestamp")
    full = F.when(F.length("url") > 0, F.raise_error(F.lit("no space left"))).cast("string")
    try:
        sinks.persist_run(CrawlResult(whole.items.withColumn("title", full), whole.tasks, whole.runs), folder, now)
    except Exception as problem:
        if "no space left" not in str(problem):
            raise
    sinks.persist_run(whole, folder, now)
    sinks.persist_run(whole, folder, now)
    return _persisted(t, folder)


def _job(t, tasks=None, twice=False):
    """The job over all sources; again over ``tasks`` with every trigger ``twice``."""
    def run():
        meta = ('{"extractor_config":{"link_selectors":[".list a"],"title_selector":"h1.title",'
                '"next_page_selector":"a.next-page","max_pages":2}}')
        lines = t.lines.withColumn("meta", F.lit(meta)).withColumnRenamed("k", "line_ord").drop("item_limit")
        sources = t.sources.withColumn("meta", F.lit("{}"))
        triggers = t.sources.select(F.concat(F.lit("go-"), "id").alias("trigger_id"), F.col("id").alias("source_id"))
        triggers = triggers.unionByName(triggers.withColumn("source_id", F.concat(F.lit("x"), "source_id")))
        none = t.tasks.limit(0).select(
            "id", "source_id", "status", F.lit("").alias("config"), "total_items",
            F.lit(0).cast("long").alias("success_count"), F.lit(0).cast("long").alias("failed_count"),
            F.lit("").alias("error"), *[F.lit(None).cast("timestamp").alias(c) for c in (
                "started_at", "finished_at", "created_at")])
        folder = t.new_folder()
        given = triggers.unionByName(triggers) if twice else triggers
        job = run_job(given, sources, lines, none if tasks is None else tasks, t.site(), folder, F.lit(_NOW).cast("timestamp"))
        return job, folder
    return run() if twice else kept(t, "job", run)


@check("run_job", """
SELECT source AS source_id, 'success' AS status, CAST(least(count(*), 20) AS BIGINT) AS total_items,
       2::BIGINT AS success_count, 0::BIGINT AS failed_count FROM documents WHERE source <> 'src19' GROUP BY source""")
def _(t):
    return _job(t)[0].tasks.select("source_id", "status", "total_items", "success_count", "failed_count")


@check("run_job_answers", """
SELECT id AS source_id, CASE WHEN id = 'src19' THEN 400 ELSE 201 END AS code FROM v_sources
UNION ALL SELECT concat('x', id), 404 FROM v_sources""")
def _(t):
    return _job(t)[0].answers.select("source_id", "code")


@check("run_job_again", """
SELECT id AS source_id, CASE WHEN id = 'src19' THEN 400 ELSE 409 END AS code, CAST(2 AS BIGINT) AS answers, CAST(0 AS BIGINT) AS records
FROM v_sources UNION ALL SELECT concat('x', id), 404, 2, 0 FROM v_sources""")
def _(t):
    # the same triggers once more, each twice: nothing runs and nothing is stored again
    job, first = _job(t)
    again, folder = _job(t, t.stored(job.tasks), twice=True)
    kinds = t.spark.read.parquet(f"{first}/collected_data").schema
    records = t.spark.read.schema(kinds).parquet(f"{folder}/collected_data").groupBy("source_id").agg(F.count("*").alias("records"))
    return again.answers.groupBy("source_id", "code").agg(F.count("*").alias("answers")).join(records, "source_id", "left").select(
        "source_id", "code", "answers", F.coalesce("records", F.lit(0)).cast("long").alias("records"))


@check("run_job_data", """
SELECT source AS source_id, concat(source, '-l0') AS line_id, url, concat('Doc ', CAST(doc_id AS VARCHAR)) AS title
FROM x_docs WHERE r <= 20 AND source <> 'src19'""")
def _(t):
    return t.spark.read.parquet(f"{_job(t)[1]}/collected_data").select("source_id", "line_id", "url", "title")


_ESCAPED = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@check("auto_crawl", f"""
SELECT url, concat(site, '/list') AS title, md5(concat('<h1 class="title">Doc ', CAST(doc_id AS VARCHAR),
  '</h1><span class="date">', lang, '</span><div class="body"><p>', {_ESCAPED}, '</p></div>')) AS body
FROM x_docs WHERE r <= 10""")
def _(t):
    seeds = t.sources.select("id", F.concat("url", F.lit("list")).alias("url"))
    return auto_crawl(seeds, t.site()).items.select("url", "title", F.md5("content").alias("body"))


# -- streams -----------------------------------------------------------------------------------


def _through(t, stream):
    folder = t.new_folder()
    S.write_stream(stream, folder).awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/rows")


@check("stream_extract", f"""
SELECT url, CASE WHEN {_H1} = '' THEN 'the line' ELSE {_H1} END AS title, md5(html) AS body FROM pages""")
def _(t):
    pages = _fetched(as_pages(S.read_stream(t.spark, t.folder, "pages.parquet")))
    return _through(t, S.stream_extract(pages, title="h1")).select("url", "title", F.md5("content").alias("body"))


@check("stream_links", f"""
SELECT DISTINCT url AS page_url, concat({_SITE_OF}, h) AS target_url
FROM (SELECT url, unnest({_HREFS}) AS h FROM pages) q""")
def _(t):
    pages = as_pages(S.read_stream(t.spark, t.folder, "pages.parquet"))
    return _through(t, S.stream_extract(pages, mode="links")).select("page_url", "target_url")


@check("stream_dedup", "SELECT DISTINCT user_id % 20 AS crawl_id, md5(props) AS url_key FROM events")
def _(t):
    asked = S.read_stream(t.spark, t.folder, "events.parquet").select(
        (F.col("user_id") % 20).alias("crawl_id"), F.col("props").alias("url"))
    return _through(t, S.stream_dedup(asked)).select("crawl_id", "url_key")


@check("stream_status", """
SELECT count(*) AS task_count, count(*) FILTER (e = 'view') AS pending, count(*) FILTER (e = 'click') AS running,
       count(*) FILTER (e = 'purchase') AS success, count(*) FILTER (e = 'error') AS failed
FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS e FROM events GROUP BY user_id) q""")
def _(t):
    states = F.create_map(*[F.lit(x) for x in (
        "view", "pending", "click", "running", "purchase", "success", "error", "failed")])
    changes = S.read_stream(t.spark, t.folder, "events.parquet").select(
        F.col("user_id").alias("id"), F.coalesce(states[F.col("event_type")], F.lit("skipped")).alias("status"),
        F.col("ts").alias("changed_at"), F.col("event_id").alias("seq"))
    folder = t.new_folder()
    board = LiveStatus(t.spark, folder)
    stream_status(changes, board, folder).awaitTermination()
    return board.counts()
