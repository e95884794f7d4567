"""Links and records out of fetched pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvest.functions.page import check_selector, match_page, parse_page
from harvest.functions.text import clean_href, or_else, record_id, resolve_url, resolve_urls, strip

ITEM_COLUMNS = [
    "item_id", "line_id", "source_id", "url", "title", "content", "content_type",
    "status_code", "published_at_raw",
]
CONTENT_LIMIT = 10_000


def html_nodes(pages: DataFrame, *keep: str) -> DataFrame:
    """One row per element of every page, in document order by ``ord``; ``keep`` names columns of the
    page that go with it, such as an id where pages share an address.

    The outer form with a filter behind it: for the plain form the optimizer would test the list
    for emptiness below, which means parsing every page a second time.
    """
    return pages.select(*keep, F.col("url").alias("page_url"), parse_page("html").alias("page")).select(
        *keep, "page_url", F.inline_outer("page.nodes")).filter(F.col("ord").isNotNull())


def select_nodes(pages: DataFrame, selector: str) -> DataFrame:
    """Matches of a selector in document order: ``page_url, pos, ord, href``.

    Supported: tag, ``*``, ``.class``, ``#id``, attribute tests, descendant, ``>`` and commas.
    Anything else raises here, not on the executors.
    """
    match = match_page(F.col("html"), F.array(F.lit(check_selector(selector))))
    return (
        pages.select(F.col("url").alias("page_url"), F.get(match, F.lit(0)).alias("m"))
        .select("page_url", F.posexplode(F.arrays_zip("m.ords", "m.hrefs")).alias("pos", "hit"))
        .select("page_url", "pos", F.col("hit.ords").alias("ord"), F.col("hit.hrefs").alias("href"))
    )


def select_text(pages: DataFrame, selector: str) -> DataFrame:
    """Text of the first match per page; null where nothing matches."""
    match = match_page(F.col("html"), F.array(F.lit(check_selector(selector))))
    return pages.select(
        F.col("url").alias("page_url"), F.get(match, F.lit(0))["text"].alias("text"))


def page_links(base: Column, hrefs: Column) -> Column:
    """Absolute links of one page in document order, each once; null marks an unusable one."""
    kept = F.filter(F.transform(hrefs, clean_href), lambda href: href.isNotNull())
    return F.array_distinct(resolve_urls(base, kept))


def page_next(base: Column, match: Column) -> Column:
    """Address of the next listing page: the first match's reference, if it is not blank."""
    href = strip(F.get(match["hrefs"], F.lit(0)))
    return resolve_url(base, F.when(href != "", href))


def extract_links(pages: DataFrame, selector: str = "a[href]") -> DataFrame:
    """Links of each page, absolute, each once per page at its first position."""
    match = match_page(F.col("html"), F.array(F.lit(check_selector(selector))))
    return (
        pages.select("url", F.get(match, F.lit(0))["hrefs"].alias("hrefs"))
        .select(F.col("url").alias("page_url"),
                F.posexplode(page_links(F.col("url"), F.col("hrefs"))).alias("pos", "target_url"))
        .filter(F.col("target_url").isNotNull())
    )


def next_link(pages: DataFrame, selector: str) -> DataFrame:
    """Next listing page of each page, where there is one.

    A list of at most one that is unfolded, not a filter: a filter would be computed below the
    projection too, with a second parse.
    """
    match = match_page(F.col("html"), F.array(F.lit(check_selector(selector))))
    found = pages.select("url", F.get(match, F.lit(0)).alias("m"))
    onward = F.array_compact(F.array(page_next(F.col("url"), F.col("m"))))
    return found.select(F.col("url").alias("page_url"), F.explode(onward).alias("next_url"))


def page_items(fetched: DataFrame) -> DataFrame:
    """The whole page as one record: title is the line's name, content the raw text."""
    return fetched.select(*_item(F.col("line_name"), F.col("html"), F.lit(None).cast("string")))


def data_items(
    fetched: DataFrame, title: str | None = None, time: str | None = None,
    content: str | None = None,
) -> DataFrame:
    """One record per page by selectors given once for all pages."""
    for selector in (title, time, content):
        if selector:
            check_selector(selector)
    return selected_items(fetched.withColumns({
        "title_selector": F.lit(title).cast("string"),
        "time_selector": F.lit(time).cast("string"),
        "content_selector": F.lit(content).cast("string"),
    }))


def selected_items(fetched: DataFrame) -> DataFrame:
    """One record per page by the selectors in its own row.

    A title that is missing or empty becomes the line's name, a content that is missing or empty
    the raw page; the time text is kept as found, absent when empty. Rows without any of the
    three selectors give the whole page, as :func:`page_items` does.
    """
    selectors = F.array("title_selector", "time_selector", "content_selector")
    # the parse reads each row once; the page itself stays only as the fallback content
    found = fetched.withColumn("m", match_page(F.col("html"), selectors))
    return found.select(*_item(
        or_else(F.col("m")[0]["text"], F.col("line_name")),
        or_else(F.col("m")[2]["text"], F.col("html")),
        F.nullif(F.col("m")[1]["text"], F.lit("")),
    ), *[c for c in ("crawl_id", "task_id", "task_ord", "order_key") if c in fetched.columns])


def _item(title: Column, content: Column, time_text: Column) -> list[Column]:
    return [
        "line_id", "source_id", F.col("response_url").alias("url"),
        F.coalesce(title, F.lit("")).alias("title"),
        F.coalesce(content, F.lit("")).alias("content"),
        "content_type", "status_code", time_text.alias("published_at_raw"),
    ]


def with_item_id(items: DataFrame, *parts: str) -> DataFrame:
    """Add ``item_id``, the same for the same parts in every run of the plan."""
    return items.withColumn("item_id", record_id(*[F.col(p) for p in parts]))


def truncate_content(items: DataFrame) -> DataFrame:
    """Stored form of the content: its first 10,000 characters."""
    return items.withColumn("content", F.substring("content", 1, CONTENT_LIMIT))


CUSTOM_ITEM = T.StructType([
    T.StructField("request_url", T.StringType(), False),
    T.StructField("record_no", T.IntegerType(), False),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("published_at_raw", T.StringType()),
    T.StructField("extract_error", T.StringType()),
])


def custom_items(fetched: DataFrame, extractor: Callable, keep_errors: bool = False) -> DataFrame:
    """Run a user's extractor: one fetched row (a dict) to any number of record dicts.

    The extractor sees Arrow batches of the fetched pages on the executors; each record may set
    ``url, title, content, content_type, published_at_raw``. ``record_no`` keeps their order.
    With ``keep_errors`` a page whose extraction raises gives one row with ``extract_error``
    instead of ending the job.
    """
    keys = [f.name for f in fetched.schema.fields]
    carried = [f for f in fetched.schema.fields if f.name not in ("html", "response_url", "status_code",
                                                                   "content_type")]
    own = [f for f in CUSTOM_ITEM.fields if f.name not in {c.name for c in carried}]
    schema = T.StructType([*carried, T.StructField("status_code", T.IntegerType()), *own])

    def records(row: dict) -> list[dict]:
        made = []
        for record in extractor(row):
            unknown = set(record) - {"url", "title", "content", "content_type", "published_at_raw"}
            if unknown:
                raise ValueError(f"extractor returned unknown fields: {sorted(unknown)}")
            made.append({"title": "", "content": "", "url": row.get("response_url"),
                         "content_type": row.get("content_type"), **record})
        return made

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                try:
                    made = records(row)
                except Exception as problem:
                    if not keep_errors:
                        raise
                    made = [{"extract_error": str(problem)}]
                base = {k: row.get(k) for k in keys}
                base["request_url"] = row.get("request_url") or row.get("url")
                for number, record in enumerate(made):
                    out = {**base, "record_no": number, **record}
                    rows.append({name: out.get(name) for name in arrow.names})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return fetched.mapInArrow(run, schema)
