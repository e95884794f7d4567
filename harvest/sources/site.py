"""A linked web site built from a table of documents, as a Spark job.

Every document becomes a detail page; its source lists ten documents per listing page, in
``doc_id`` order. Listings link onward by ``a.next-page``; the last listing of an odd source
links back to the first. Each listing repeats its first document at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvest.operators.ordered import number_rows
from harvest.schemas import EXTRACTORS
from harvest.session import cut_lineage

PER_PAGE = 10


def escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def _site(source: Column) -> Column:
    return F.concat(F.lit("https://"), source, F.lit(".test"))


def listing_url(source: Column, number: Column) -> Column:
    return F.concat(_site(source), F.when(number == 1, F.lit("/list")).otherwise(
        F.concat(F.lit("/list?page="), number.cast("string"))))


def listing_pages(documents: DataFrame) -> DataFrame:
    """``source, k, url, html`` of the listing pages; at most ten documents meet in one row."""
    ranked = number_rows(documents.select("source", "doc_id"), ["source"], ["doc_id"], "r")
    rows = ranked.withColumn("k", F.ceil(F.col("r") / PER_PAGE).cast("int"))
    last = ranked.groupBy("source").agg(F.ceil(F.max("r") / PER_PAGE).cast("int").alias("last"))
    pages = rows.groupBy("source", "k").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    pages = pages.join(last, "source")
    shown = F.transform(F.concat("ids", F.slice("ids", 1, 1)), lambda i: F.concat(
        F.lit('<li><a href="/doc/'), i.cast("string"), F.lit('">Doc '), i.cast("string"), F.lit("</a></li>")))
    odd = F.substring("source", 4, 9).cast("int") % 2 == 1
    onward = (
        F.when(F.col("k") < F.col("last"), F.concat(F.lit("/list?page="), (F.col("k") + 1).cast("string")))
        .when(odd, F.lit("/list")))
    return pages.select(
        "source", "k", listing_url(F.col("source"), F.col("k")).alias("url"),
        F.concat(
            F.lit('<nav><a href="#top">Top</a><a href="javascript:void(0)">M</a></nav><ul class="list">'),
            F.array_join(shown, ""), F.lit("</ul>"),
            F.coalesce(F.concat(F.lit('<a class="next-page" href="'), onward, F.lit('">next</a>')),
                       F.lit(""))).alias("html"))


def detail_pages(documents: DataFrame) -> DataFrame:
    number = F.col("doc_id").cast("string")
    return documents.select(
        F.concat(_site(F.col("source")), F.lit("/doc/"), number).alias("url"),
        F.concat(
            F.lit('<h1 class="title">Doc '), number, F.lit('</h1><span class="date">'), "lang",
            F.lit('</span><div class="body"><p>'), escape(F.col("text")), F.lit("</p></div>")).alias("html"))


def site_pages(documents: DataFrame, with_front: bool = False) -> DataFrame:
    """All pages of all sites, ``url, html``; ``with_front`` adds a front page at ``/`` whose
    ``.cat`` links lead to the first listing."""
    listings = listing_pages(documents)
    pages = listings.select("url", "html").unionByName(detail_pages(documents))
    if with_front:
        front = documents.select("source").distinct().select(
            F.concat(_site(F.col("source")), F.lit("/")).alias("url"),
            F.lit('<div class="cat"><a href="list">All</a></div>').alias("html"))
        pages = pages.unionByName(front)
    return pages


def site_tasks(
    documents: DataFrame, limits: list[int | None], front: bool = False, dedup: bool = True,
    follow: bool = True, max_pages: int | None = None,
) -> DataFrame:
    """One run per source with one task per entry of ``limits``, all on the same listing."""
    lanes = F.array(*[F.struct(F.lit(n).alias("task_ord"), F.lit(limit).cast("int").alias("max_items"))
                      for n, limit in enumerate(limits)])
    links = [".list a"] if not front else [".cat a", ".list a"]
    values = {
        "link_selectors": F.array(*map(F.lit, links)), "title_selector": F.lit("h1.title"),
        "time_selector": F.lit(".date"), "content_selector": F.lit(".body"),
        "next_page_selector": F.lit("a.next-page" if follow else None), "max_pages": F.lit(max_pages),
    }
    line = F.concat(F.lit("l"), F.col("lane.task_ord").cast("string"))
    return documents.select("source").distinct().select(
        "source", F.explode(lanes).alias("lane")).select(
        F.concat(F.lit("run-"), "source").alias("crawl_id"), F.col("source").alias("source_id"),
        "lane.task_ord", F.concat("source", F.lit("-"), line).alias("task_id"),
        line.alias("line_id"), line.alias("line_name"),
        F.concat(_site(F.col("source")), F.lit("/" if front else "/list")).alias("url"),
        F.create_map().cast("map<string,string>").alias("params"), "lane.max_items",
        F.struct(*[values[f.name].cast(f.dataType).alias(f.name) for f in EXTRACTORS.fields])
        .alias("extractors"),
        F.lit(dedup).alias("dedup_enabled"))


def written_site(documents: DataFrame, **options) -> DataFrame:
    """The site as stored pages in the shape the operators read."""
    from harvest.sources.pages import as_pages

    return as_pages(cut_lineage(site_pages(documents, **options)))
