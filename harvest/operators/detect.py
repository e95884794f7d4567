"""Find selectors for a page by link groups, tag meaning and text density."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvest.functions.page import parse_page, signature, tag_selector

MIN_GROUP = 3
SEMANTIC_ABOVE = 100
DENSITY_FROM = 100

# Fixed values, tried in this order.
TIME_CLASSES = [
    "date", "time", "publish-date", "pub-date", "datetime", "publish_time", "pubdate",
    "publishDate", "published", "created", "updated", "timestamp", "post-time", "post-date",
    "article-date", "news-date", "news-time", "release-time", "create-time", "update-time",
]
# Fixed values, tried in this order.
CONTENT_SELECTORS = [
    "article", ".content", ".article-content", ".post-content", ".article-body", "main",
    ".entry-content", ".post-body", ".news-content", ".article-detail", ".detail-content",
]
# Containers the density fallback looks at.
DENSITY_TAGS = ["div", "article", "section", "main"]


def _first(nodes: Column, test) -> Column:
    return F.get(F.filter(nodes, test), F.lit(0))


def link_signatures(nodes: Column) -> Column:
    """Parent signature of every ``<a href>``, in document order; null for a top-level link."""
    links = F.filter(nodes, lambda n: (n["tag"] == "a") & F.map_contains_key(n["attrs"], "href"))
    return F.transform(links, lambda n: F.when(
        n["parent"] >= 0, signature(F.get(nodes, n["parent"]))))


def title_selector(nodes: Column) -> Column:
    """First ``h1`` if it has text, else first ``h2`` if it has text."""
    def of(tag):
        head = _first(nodes, lambda n: n["tag"] == tag)
        return F.when(head["text_len"] > 0, tag_selector(head))

    return F.coalesce(of("h1"), of("h2"))


def time_selector(nodes: Column) -> Column:
    """``time`` tag, else first element with a ``datetime``, else the first known class present."""
    dated = _first(nodes, lambda n: F.map_contains_key(n["attrs"], "datetime"))
    present = F.array_distinct(F.flatten(F.transform(nodes, lambda n: n["classes"])))
    known = F.filter(
        F.array(*map(F.lit, TIME_CLASSES)), lambda name: F.array_contains(present, name))
    return F.coalesce(
        F.when(F.exists(nodes, lambda n: n["tag"] == "time"), F.lit("time")),
        tag_selector(dated),
        F.concat(F.lit("."), F.get(known, F.lit(0))),
    )


def semantic_content(nodes: Column) -> Column:
    """First selector of the list whose first match holds more than 100 characters of text."""
    tags = F.array(*[F.lit(s) for s in CONTENT_SELECTORS if s[0] != "."])
    names = F.array(*[F.lit(s[1:]) for s in CONTENT_SELECTORS if s[0] == "."])
    likely = F.filter(nodes, lambda n: F.array_contains(tags, n["tag"])
                      | F.arrays_overlap(n["classes"], names))

    def passes(selector):
        return F.when(selector.startswith("."),
                      _first(likely, lambda n: F.array_contains(
                          n["classes"], F.substring(selector, 2, 100))))\
            .otherwise(_first(likely, lambda n: n["tag"] == selector))["text_len"] > SEMANTIC_ABOVE

    return F.get(F.filter(F.array(*map(F.lit, CONTENT_SELECTORS)), passes), F.lit(0))


def dense_content(nodes: Column) -> Column:
    """Container with the most text per serialized character; the earliest of equals."""
    scored = F.transform(
        F.filter(nodes, lambda n: n["tag"].isin(DENSITY_TAGS) & (n["text_len"] >= DENSITY_FROM)),
        lambda n: F.struct(
            (n["text_len"].cast("double") / n["html_len"]).alias("density"),
            (-n["ord"]).alias("early"), tag_selector(n).alias("selector")))
    return F.array_max(scored)["selector"]


def _by_page(pages: DataFrame, *keep: str, **columns) -> DataFrame:
    parsed = pages.select(*keep, F.col("url").alias("page_url"), parse_page("html").alias("page"))
    nodes = F.col("page.nodes")
    return parsed.select(*keep, "page_url", *[make(nodes).alias(name) for name, make in columns.items()])


def detect_title(pages: DataFrame) -> DataFrame:
    return _by_page(pages, title_selector=title_selector)


def detect_time(pages: DataFrame) -> DataFrame:
    return _by_page(pages, time_selector=time_selector)


def detect_content_semantic(pages: DataFrame) -> DataFrame:
    return _by_page(pages, content_selector=semantic_content)


def detect_content_density(pages: DataFrame) -> DataFrame:
    return _by_page(pages, content_selector=dense_content)


def tag_signatures(pages: DataFrame, *keep: str) -> DataFrame:
    """Signature and selector of every element, with the columns ``keep`` of its page."""
    return _by_page(pages, *keep, nodes=lambda nodes: nodes).select(
        *keep, "page_url", F.explode_outer("nodes").alias("n")).filter(F.col("n").isNotNull()).select(
        *keep, "page_url", "n.ord", signature(F.col("n")).alias("signature"),
        tag_selector(F.col("n")).alias("selector"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _groups(signatures: Column) -> Column:
    """Link groups of a page: ``signature, links, first_pos`` for each distinct signature.

    Sorted by signature and place, equal ones lie together: a group ends where the next begins. All of
    it happens inside the row, in the time of one sort.
    """
    placed = F.array_sort(F.transform(signatures, lambda s, i: F.struct(s.alias("signature"), i.alias("pos"))))

    def begins(rows: Column, i: Column) -> Column:
        return (i == 0) | ~F.get(rows, i)["signature"].eqNullSafe(F.get(rows, i - 1)["signature"])

    def cut(rows: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(rows) - 1, F.lit(0))), lambda i: begins(rows, i))
        return _let(starts, lambda at: F.transform(at, lambda first, k: F.struct(
            F.get(rows, first)["signature"].alias("signature"),
            (F.coalesce(F.get(at, k + 1), F.size(rows)) - first).cast("long").alias("links"),
            F.get(rows, first)["pos"].alias("first_pos"))))

    return F.when(F.size(signatures) > 0, _let(placed, cut)).otherwise(
        F.array().cast("array<struct<signature:string,links:bigint,first_pos:int>>"))


def _largest(signatures: Column) -> Column:
    ranked = F.transform(_groups(signatures), lambda g: F.struct(
        g["links"].alias("links"), (-g["first_pos"]).alias("early"), g["signature"].alias("signature")))
    return _let(F.array_max(ranked), lambda best: F.when(
        (best["links"] >= MIN_GROUP) & best["signature"].isNotNull(), F.concat(best["signature"], F.lit(" a[href]"))))


def link_groups(pages: DataFrame) -> DataFrame:
    """Number of ``<a href>`` by signature of the element around them (null: top level)."""
    grouped = _by_page(pages, groups=lambda nodes: _groups(link_signatures(nodes)))
    return grouped.select("page_url", F.inline_outer("groups")).filter("links > 0")


def detect_link_selector(pages: DataFrame) -> DataFrame:
    """Selector of the largest link group of at least three, the earliest of equals.

    Links without an element around them form a group too, but give no selector.
    """
    return _by_page(pages, link_selector=lambda nodes: _largest(link_signatures(nodes)))


_NAME = r"(-?[A-Za-z_\x{a0}-\x{10ffff}]|--)[A-Za-z0-9_\x{a0}-\x{10ffff}-]*"
_USABLE = rf"^(#{_NAME}|({_NAME})?(\.{_NAME})*)( a\[href\])?$"


def selector_error(*selectors: Column) -> Column:
    """Names the first detected selector that cannot be used: class names and ids are put in as
    found, and some, like ``md:flex``, do not make a selector."""
    odd = F.filter(F.array_compact(F.array(*selectors)), lambda s: ~s.rlike(_USABLE))
    return F.concat(F.lit("unsupported selector: "), F.get(odd, F.lit(0)))


def detect_selectors(pages: DataFrame, detector=None) -> DataFrame:
    """All detections of a page from one parse: ``page_url, link_selectors, title_selector,
    time_selector, content_selector, selector_error``.

    ``detector`` replaces the built-in rules: a column function ``html -> struct`` with those four
    fields, for instance a pandas or Arrow function.
    """
    fields = ["link_selectors", "title_selector", "time_selector", "content_selector"]
    if detector is not None:
        return pages.select(F.col("url").alias("page_url"), detector(F.col("html")).alias("d")).select(
            "page_url", *[F.col(f"d.{name}").alias(name) for name in fields])
    seen = _by_page(
        pages, link=lambda nodes: _largest(link_signatures(nodes)), title_selector=title_selector,
        time_selector=time_selector,
        content_selector=lambda nodes: F.coalesce(semantic_content(nodes), dense_content(nodes)))
    rest = fields[1:]
    return seen.select(
        "page_url", F.filter(F.array("link"), lambda s: s.isNotNull()).alias("link_selectors"), *rest,
        selector_error(F.col("link"), *map(F.col, rest)).alias("selector_error"))
