"""The given tables read as sources, lines, runs, records, logs and attempts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import kept
from harvest.operators.ordered import number_rows
from harvest.plans.crawl import crawl
from harvest.session import cut_lineage, scratch_dir
from harvest.sources.pages import read_pages
from harvest.sources.site import site_tasks, written_site

# the same text for both engines
_SOURCES = """
SELECT s AS id, concat('Site ', s) AS name,
       CASE i % 5 WHEN 0 THEN 'website' WHEN 1 THEN 'api' WHEN 2 THEN 'file'
                  WHEN 3 THEN 'stream' ELSE 'external' END AS type,
       concat('https://', s, '.test/') AS url, (i % 4 <> 0) AS enabled, i
FROM (SELECT DISTINCT source AS s, CAST(substr(source, 4) AS INT) AS i FROM {documents}) d"""
_TASKS = """
SELECT concat('ct-', CAST(o_orderkey AS STRING)) AS id,
       concat('src', CAST(o_custkey % 25 AS STRING)) AS source_id,
       CASE WHEN o_orderstatus = 'O' THEN 'running' WHEN o_orderstatus = 'P' THEN 'pending'
            WHEN o_orderpriority = '1-URGENT' THEN 'failed' ELSE 'success' END AS status,
       coalesce(n, 0) AS total_items, o_orderdate AS created_at
FROM {orders} LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM {lineitem} GROUP BY l_orderkey) x
     ON l_orderkey = o_orderkey"""
_DATA = """
SELECT CAST(doc_id AS STRING) AS id, concat('ct-', CAST(doc_id % 50 AS STRING)) AS task_id,
       source AS source_id, lang AS line_id, substr(text, 1, 60) AS title, text AS content
FROM {documents}"""
_LOGS = """
SELECT event_id AS id, concat('ct-', CAST(user_id AS STRING)) AS task_id,
       concat('src', CAST(user_id % 20 AS STRING)) AS source_id,
       CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level,
       props AS message, ts AS created_at
FROM {events}"""
_LINE = """
SELECT concat(id, '-l', CAST(k AS STRING)) AS id, id AS source_id,
       concat('line ', CAST(k AS STRING)) AS name, concat(url, 'list') AS url, (k <> 2) AS enabled,
       CASE WHEN k = 0 THEN 15 WHEN k = 1 THEN 12 END AS item_limit, k
FROM """

_NAMES = {n: n for n in ("documents", "orders", "lineitem", "events", "pages")}
_VIEWS = {
    "v_sources": _SOURCES.format(**_NAMES),
    "v_lines": _LINE + "(SELECT *, unnest([0, 1, 2]) AS k FROM v_sources WHERE id <> 'src19') t",
    "v_tasks": _TASKS.format(**_NAMES),
    "v_data": _DATA.format(**_NAMES),
    "v_logs": _LOGS.format(**_NAMES),
    "v_attempts": """
SELECT user_id AS request_id, concat('https://x.test/', CAST(user_id AS VARCHAR)) AS url, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS attempt,
       CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 WHEN 'purchase' THEN NULL
            ELSE 200 END AS status_code,
       CASE WHEN event_type = 'purchase' THEN 'timeout' END AS error
FROM events""",
    "x_docs": """
SELECT d.*, CAST(substr(source, 4) AS INT) AS i, concat('https://', source, '.test') AS site,
       concat('https://', source, '.test/doc/', CAST(doc_id AS STRING)) AS url,
       row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r,
       count(*) OVER (PARTITION BY source) AS n
FROM documents d""",
    "x_listings": """
SELECT source, i, site, k, last, CASE WHEN k = 1 THEN concat(site, '/list')
       ELSE concat(site, '/list?page=', CAST(k AS STRING)) END AS url
FROM (SELECT source, any_value(i) AS i, any_value(site) AS site, CAST((r + 9) // 10 AS BIGINT) AS k,
             CAST((any_value(n) + 9) // 10 AS BIGINT) AS last
      FROM x_docs GROUP BY source, CAST((r + 9) // 10 AS BIGINT)) q""",
}


def with_views(sql: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in _VIEWS.items()) + "\n" + sql


class Tables:
    """The given tables and what is read out of them, for one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _sql(self, text: str, *names: str) -> DataFrame:
        return self.spark.sql(text, **{n: self.raw(n) for n in names})

    @property
    def documents(self) -> DataFrame:
        return self.raw("documents")

    @property
    def pages(self) -> DataFrame:
        return read_pages(self.spark, f"{self.folder}/pages.parquet")

    @property
    def sources(self) -> DataFrame:
        return self._sql(_SOURCES, "documents")

    @property
    def lines(self) -> DataFrame:
        each = self.sources.filter("id <> 'src19'").withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))
        return self.spark.sql(_LINE + "{each}", each=each)

    @property
    def tasks(self) -> DataFrame:
        return self._sql(_TASKS, "orders", "lineitem")

    @property
    def data(self) -> DataFrame:
        return self._sql(_DATA, "documents")

    @property
    def logs(self) -> DataFrame:
        return self._sql(_LOGS, "events")

    @property
    def attempts(self) -> DataFrame:
        events = self.raw("events").select("user_id", "ts", "event_id", "event_type")
        numbered = number_rows(events, ["user_id"], ["ts", "event_id"], "n")
        return numbered.selectExpr(
            "user_id AS request_id", "concat('https://x.test/', CAST(user_id AS STRING)) AS url", "n - 1 AS attempt",
            "CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 "
            "WHEN 'purchase' THEN NULL ELSE 200 END AS status_code",
            "CASE WHEN event_type = 'purchase' THEN 'timeout' END AS error")

    def nested_sources(self) -> DataFrame:
        """Sources with their lines inside; the lines carry an extractor config and one more field."""
        meta = F.when(F.col("k") == 1, F.lit("{}")).otherwise(F.lit(
            '{"extractor_config":{"link_selectors":[".list a"],"title_selector":"h1.title"},"lane":"main"}'))
        line = F.struct(
            "id", F.lit("someone-else").alias("source_id"), "name", "url", F.lit("").alias("description"),
            "enabled", F.col("item_limit").cast("int").alias("item_limit"), meta.alias("meta"),
            F.lit(None).cast("timestamp").alias("created_at"),
            F.lit(None).cast("timestamp").alias("updated_at"))
        packed = self.lines.groupBy(F.col("source_id").alias("id")).agg(
            F.array_sort(F.collect_list(F.struct("k", line.alias("line")))).alias("ls"))
        return self.sources.join(packed, "id", "left").select(
            "id", "name", "type", "url", F.lit("").alias("description"), "enabled",
            F.lit("{}").alias("meta"),
            F.transform("ls", lambda e: e["line"]).alias("lines"), "i")

    # -- the synthetic site ---------------------------------------------------------------

    def site(self, with_front: bool = False) -> DataFrame:
        return kept(self, f"site {with_front}",
                    lambda: written_site(self.documents, with_front=with_front))

    def listings(self) -> DataFrame:
        return self.site().filter(F.col("url").contains(".test/list"))

    def details(self) -> DataFrame:
        return self.site().filter(F.col("url").contains(".test/doc/"))

    def crawled(self, name: str = "plain", pages=None, missing: str = "fail", limits=(15, 12),
                extractor=None, **options):
        """One crawl of the whole site, shared by the queries that look at its parts."""
        def run():
            front = options.get("front", False)
            return crawl(site_tasks(self.documents, list(limits), **options),
                         self.site(front) if pages is None else pages, missing, extractor)
        return kept(self, f"crawl {name}", run)

    def new_folder(self) -> str:
        """A fresh folder beside the other intermediate tables."""
        return f"{scratch_dir(self.spark)}/out-{uuid.uuid4().hex}"

    def stored(self, df: DataFrame) -> DataFrame:
        return cut_lineage(df)
