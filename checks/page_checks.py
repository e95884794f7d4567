"""Parsing, links, records and detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from harvest.functions import text as X
from harvest.operators import detect as D
from harvest.operators import extract as E

# an entity cut off at the end of its text counts without its semicolon
_UNESCAPE = (
    "regexp_replace(replace(replace(replace({}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp(;|$)', '&', 'g')")
_H1 = "trim(" + _UNESCAPE.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)") + ")"
_HREFS = "regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)"
_SITE_OF = "regexp_extract(url, '^(https?://[^/]+)', 1)"


@check("read_pages", "SELECT url, 200 AS status_code, 'text/html' AS content_type, md5(html) AS body FROM pages")
def _(t):
    return t.pages.select("url", "status_code", "content_type", F.md5("html").alias("body"))


@check("clean_href", """
SELECT doc_id, count(*) AS words, sum(CASE WHEN k < 2 AND w <> '' THEN 1 ELSE 0 END)::BIGINT AS kept,
       sum(CASE WHEN k < 2 AND w <> '' THEN length(w) ELSE 0 END)::BIGINT AS chars
FROM (SELECT doc_id, w, length(w) % 4 AS k FROM (
      SELECT doc_id, unnest(string_split(replace(replace(text, chr(10), ' '), '#', '+'), ' ')) AS w FROM documents) a) b
GROUP BY doc_id""")
def _(t):
    flat = F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("#"), F.lit("+"))
    words = t.documents.select("doc_id", F.explode(F.split(flat, " ")).alias("w"))
    k = F.length("w") % 4
    href = (F.when(k == 2, F.concat(F.lit("#"), "w")).when(k == 3, F.concat(F.lit(" javascript:"), "w"))
            .when(k == 1, F.concat(F.lit(" 　\t"), "w", F.lit(" \n"))).otherwise(F.col("w")))
    cleaned = words.withColumn("c", X.clean_href(href))
    return cleaned.groupBy("doc_id").agg(
        F.count("*").alias("words"), F.count("c").alias("kept"),
        F.coalesce(F.sum(F.length("c")), F.lit(0)).alias("chars"))


@check("resolve_url", f"""
SELECT page_id, concat({_SITE_OF}, '/a/', CAST(page_id AS VARCHAR), '?x=1#f') AS rooted,
       'https://other.test/p?q#f' AS absolute, concat('https://www.test/', CAST(page_id AS VARCHAR)) AS plain,
       concat(CASE WHEN url LIKE 'https:%' THEN 'https:' ELSE 'http:' END, '//h.test/z') AS same_scheme,
       concat({_SITE_OF}, '/up') AS dotted, 'mailto:a@b.test' AS mail
FROM pages""")
def _(t):
    number, base = F.col("page_id").cast("string"), F.col("url")
    join = lambda ref: X.resolve_url(base, ref)
    return t.pages.select(
        "page_id", join(F.concat(F.lit("/a/"), number, F.lit("?x=1#f"))).alias("rooted"),
        join(F.lit("https://other.test/p?q#f")).alias("absolute"),
        join(F.concat(F.lit("https://www.test/"), number)).alias("plain"),
        join(F.lit("//h.test/z")).alias("same_scheme"), join(F.lit("/x/../up")).alias("dotted"),
        join(F.lit("mailto:a@b.test")).alias("mail"))


@check("url_key", "SELECT page_id, md5(url) AS url_key FROM pages")
def _(t):
    return t.pages.select("page_id", X.url_key(F.col("url")).alias("url_key"))


@check("text_previews", """
SELECT doc_id, substr(text, 1, 60) AS title,
       substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9一-鿿]+', '-', 'g'), '^-|-$', '', 'g'), 1, 64) AS slug,
       substr(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), 1, 30) AS line_slug,
       substr(concat('/doc/', CAST(doc_id AS VARCHAR)), 1, 40) AS path
FROM documents""")
def _(t):
    return t.documents.select(
        "doc_id", X.title_preview(F.col("text")).alias("title"), X.site_slug(F.col("text")).alias("slug"),
        X.line_slug(F.col("source")).alias("line_slug"),
        X.url_preview(F.concat(F.lit("https://x.test/doc/"), F.col("doc_id").cast("string"))).alias("path"))


@check("page_items", """
SELECT url, 'all' AS title, md5(html) AS body, 200 AS status_code, CAST(NULL AS VARCHAR) AS published_at_raw FROM pages""")
def _(t):
    fetched = t.pages.withColumns({
        "line_name": F.lit("all"), "line_id": F.lit("l"), "source_id": F.lit("s")})
    return E.page_items(fetched).select(
        "url", "title", F.md5("content").alias("body"), "status_code", "published_at_raw")


def _fetched(df):
    return df.withColumns({"line_name": F.lit("the line"), "line_id": F.lit("l"), "source_id": F.lit("s")})


@check("data_items", """
SELECT url, concat('Doc ', CAST(doc_id AS VARCHAR)) AS title, lang AS published_at_raw, md5(trim(text)) AS body
FROM x_docs""")
def _(t):
    return E.data_items(_fetched(t.details()), "h1.title", ".date", ".body").select(
        "url", "title", "published_at_raw", F.md5("content").alias("body"))


@check("data_items_fallback", f"""
SELECT url, CASE WHEN {_H1} = '' THEN 'the line' ELSE {_H1} END AS title, md5(html) AS body,
       CAST(NULL AS VARCHAR) AS published_at_raw
FROM pages""")
def _(t):
    return E.data_items(_fetched(t.pages), "h1", ".date", ".nothing").select(
        "url", "title", F.md5("content").alias("body"), "published_at_raw")


@check("item_id", """
SELECT page_id, substr(sha256(concat('run', chr(31), url, chr(31), CAST(page_id AS VARCHAR))), 1, 32) AS item_id
FROM pages""")
def _(t):
    return E.with_item_id(t.pages.withColumn("crawl_id", F.lit("run")), "crawl_id", "url", "page_id").select(
        "page_id", "item_id")


@check("truncate_content", "SELECT id, length(content) AS before, md5(substr(content, 1, 10000)) AS body FROM v_data")
def _(t):
    kept = t.data.withColumn("before", F.length("content").cast("long"))
    return E.truncate_content(kept).select("id", "before", F.md5("content").alias("body"))


def _tag_count(tag):
    return f"(length(html) - length(replace(html, '<{tag}', ''))) // {len(tag) + 1}"


@check("html_nodes", f"""
SELECT url AS page_url, {_tag_count('a ')} AS a, {_tag_count('li>')} AS li, {_tag_count('p>')} AS p,
       {_tag_count('br>')} AS br, {_tag_count('h1>')} AS h1, {_tag_count('div ')} AS div
FROM pages""")
def _(t):
    count = lambda tag: F.count_if(F.col("tag") == tag).alias(tag)
    nodes = E.html_nodes(t.pages, "page_id")        # pages may share an address
    return nodes.groupBy("page_id", "page_url").agg(
        *map(count, ("a", "li", "p", "br", "h1", "div"))).drop("page_id")


@check("select_nodes", f"""
SELECT url AS page_url, CAST(pos - 1 AS INT) AS pos, h AS href
FROM (SELECT url, unnest({_HREFS}) AS h, generate_subscripts({_HREFS}, 1) AS pos FROM pages) q""")
def _(t):
    return E.select_nodes(t.pages, "nav > ul a[href], .none").select("page_url", "pos", "href")


@check("select_text", f"SELECT url AS page_url, {_H1} AS text FROM pages")
def _(t):
    return E.select_text(t.pages, "article > h1")


@check("extract_links", f"""
SELECT page_url, CAST(row_number() OVER (PARTITION BY page_url ORDER BY first_pos) - 1 AS INT) AS pos, target_url
FROM (SELECT url AS page_url, concat({_SITE_OF}, h) AS target_url, min(pos) AS first_pos
      FROM (SELECT url, unnest({_HREFS}) AS h, generate_subscripts({_HREFS}, 1) AS pos FROM pages) q
      GROUP BY url, h) z""")
def _(t):
    return E.extract_links(t.pages)


@check("extract_links_site", """
SELECT l.url AS page_url, CAST((d.r - 1) % 10 AS INT) AS pos, d.url AS target_url
FROM x_listings l JOIN x_docs d ON d.source = l.source AND (d.r + 9) // 10 = l.k""")
def _(t):
    return E.extract_links(t.listings(), ".list a")


@check("next_link", """
SELECT url AS page_url, CASE WHEN k < last THEN concat(site, '/list?page=', CAST(k + 1 AS VARCHAR))
       ELSE concat(site, '/list') END AS next_url
FROM x_listings WHERE k < last OR i % 2 = 1""")
def _(t):
    return E.next_link(t.listings(), "a.next-page")


@check("tag_signature", f"""
SELECT url AS page_url, {_tag_count('div class="ad"')} AS ads, {_tag_count('article>')} AS articles FROM pages""")
def _(t):
    return D.tag_signatures(t.pages, "page_id").groupBy("page_id", "page_url").agg(
        F.count_if(F.col("signature") == "div.ad").alias("ads"),
        F.count_if(F.col("selector") == "article").alias("articles")).drop("page_id")


@check("link_groups", f"SELECT url AS page_url, 'li' AS signature, len({_HREFS}) AS links FROM pages WHERE len({_HREFS}) > 0")
def _(t):
    return D.link_groups(t.pages).select("page_url", "signature", "links")


@check("detect_link_selector", f"""
SELECT url AS page_url, CASE WHEN len({_HREFS}) >= 3 THEN 'li a[href]' END AS link_selector FROM pages""")
def _(t):
    return D.detect_link_selector(t.pages)


@check("detect_title", f"SELECT url AS page_url, CASE WHEN {_H1} <> '' THEN 'h1' END AS title_selector FROM pages")
def _(t):
    return D.detect_title(t.pages)


@check("detect_time", """
SELECT url AS page_url, '.date' AS time_selector FROM x_docs
UNION ALL SELECT url, NULL FROM x_listings""")
def _(t):
    return D.detect_time(t.site())


# text of the article: every piece between tags stripped at its ends, unescaped
_ARTICLE = """list_sum(list_transform(string_split(regexp_replace(
  regexp_extract(html, '<article>(.*)</article>', 1, 's'), '<[^>]*>', chr(1), 'g'), chr(1)),
  lambda x: length(regexp_replace({}, '^\\s+|\\s+$', '', 'g'))))""".format(_UNESCAPE.format("x"))


@check("detect_content_semantic", f"""
SELECT url AS page_url, CASE WHEN {_ARTICLE} > 100 THEN 'article' END AS content_selector FROM pages""")
def _(t):
    return D.detect_content_semantic(t.pages)


@check("detect_content_density", """
SELECT url AS page_url, CASE WHEN length(trim(text)) >= 100 THEN 'div.body' END AS content_selector FROM x_docs
UNION ALL SELECT url, NULL FROM x_listings""")
def _(t):
    return D.detect_content_density(t.site())


@check("detect_selectors", """
SELECT url AS page_url, '' AS links, 'h1.title' AS title_selector, '.date' AS time_selector,
       CASE WHEN length(trim(text)) >= 100 THEN 'div.body' END AS content_selector FROM x_docs
UNION ALL SELECT url, CASE WHEN least(n - (k - 1) * 10, 10) + 1 >= 3 OR k < last OR i % 2 = 1 THEN 'li a[href]' ELSE '' END,
       NULL, NULL, NULL
FROM x_listings JOIN (SELECT source AS s, count(*) AS n FROM documents GROUP BY 1) c ON s = source""")
def _(t):
    return D.detect_selectors(t.site()).select(
        "page_url", F.array_join("link_selectors", ",").alias("links"), "title_selector",
        "time_selector", "content_selector")


def _first_heading(html):
    struct = F.struct(
        F.array(F.lit("a")).alias("link_selectors"), F.regexp_extract(html, "<(h[12])", 1).alias("title_selector"),
        F.lit(None).cast("string").alias("time_selector"), F.lit("body").alias("content_selector"))
    return struct


@check("custom_detector", "SELECT url AS page_url, 'a' AS link, 'h1' AS title_selector, 'body' AS content_selector FROM pages")
def _(t):
    return D.detect_selectors(t.pages, detector=_first_heading).select(
        "page_url", F.col("link_selectors")[0].alias("link"), "title_selector", "content_selector")


def _sentences(row):
    """One record per paragraph opening tag: a user's extractor."""
    parts = (row["html"] or "").split("<p>")[1:]
    return [{"title": f"{row['line_name']} {n}", "content": part} for n, part in enumerate(parts)]


@check("custom_extractor", """
SELECT url, CAST(n - 1 AS INT) AS record_no, concat('the line ', CAST(n - 1 AS VARCHAR)) AS title, md5(part) AS body
FROM (SELECT url, unnest(string_split(html, '<p>')[2:]) AS part,
             generate_subscripts(string_split(html, '<p>')[2:], 1) AS n FROM pages) q""")
def _(t):
    return E.custom_items(_fetched(t.pages), _sentences).select(
        "url", "record_no", "title", F.md5("content").alias("body"))
