"""Work and memory in proportion to the input: walks, whole sites, large batches of pages."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from harvest.functions import page as P
from harvest.operators import frontier as R
from harvest.plans import crawl as C
from harvest.schemas import EXTRACTORS
from harvest.sources.pages import as_pages


def serial(starts, onward, most):
    found = set()
    for start in starts:
        seen, url = [], start
        while url is not None and url not in seen and (most is None or len(seen) < most):
            seen.append(url)
            url = onward.get(url)
        found |= {(start, number, url) for number, url in enumerate(seen)}
    return found


@pytest.mark.parametrize("block, most", [(4, None), (4, 9), (256, None)])
def test_walks_equal_a_serial_loop(spark, monkeypatch, block, most):
    monkeypatch.setattr(R, "BLOCK", block, raising=False)
    dice = random.Random(block)
    nodes = [f"u{n}" for n in range(50)]
    onward = {u: v for u, v in zip(nodes, nodes[1:]) if dice.random() < .85}
    onward |= {u: dice.choice([*nodes, "outside"]) for u in nodes if u not in onward and dice.random() < .6}
    starts = [*dice.sample(nodes, 30), "nowhere"]
    got = R.paginate(spark.createDataFrame([(s,) for s in starts], "start string"),
                     spark.createDataFrame(list(onward.items()), "page_url string, next_url string"), most).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == serial(starts, onward, most)


def test_visits_of_long_walks_are_not_stored(spark, monkeypatch):
    stored, cut = [], R.cut_lineage

    def counting(df):
        kept = cut(df)
        stored.append(kept.count())
        return kept

    monkeypatch.setattr(R, "cut_lineage", counting)
    nodes = [f"u{n}" for n in range(400)]
    got = R.paginate(spark.createDataFrame([(u,) for u in nodes], "start string"),
                     spark.createDataFrame(list(zip(nodes, nodes[1:])), "page_url string, next_url string"))
    assert got.count() == 400 * 401 // 2
    assert sum(stored) < 400 * 40       # links and lists for each of some twenty rounds, not 80,200 visits


def test_a_long_walk_reads_its_site_before_many_passes(spark, monkeypatch):
    asked, facts = [], R.link_facts
    monkeypatch.setattr(R, "link_facts", lambda *a: asked.append(1) or facts(*a))
    monkeypatch.setattr(R, "PAGES_PER_ROUND_AND_CORE", 0)
    pages = [(f"https://a.test/l{n}", f'<a class="i" href="/d{n}">d</a><a class="n" href="/l{n + 1}">n</a>') for n in range(30)]
    pages += [(f"https://a.test/d{n}", "<p>text</p>") for n in range(2_000)]
    starts = spark.createDataFrame(
        [("c", 0, [], "https://a.test/l0", ".i", ".n", None)],
        "crawl_id string, task_ord int, order_key array<int>, url string, link_selector string, next_selector string, max_pages int")
    visits, known = R.walk_listings(starts, as_pages(spark.createDataFrame(pages, "url string, html string")), "empty")
    assert visits.count() == 31 and len(asked) <= 6     # sixteen rounds where all pages count as read
    assert {r.url: len(r.links) for r in known.filter("next_url IS NOT NULL").collect()} == {u: 1 for u, _ in pages[:30]}


def test_listings_that_lie_together_are_parsed_by_many_tasks(spark, monkeypatch):
    tasks, facts = [], R.facts_of

    def spread(pages):
        tasks.append(pages.select(F.spark_partition_id().alias("n")).distinct().count())
        return facts(pages)

    monkeypatch.setattr(R, "facts_of", spread)
    pages = [(f"https://a.test/l{n}", f'<a class="i" href="/d{n}">d</a><a class="n" href="/l{n + 1}">n</a>') for n in range(60)]
    pages += [("https://a.test/text", "<p>text</p>"), ("https://b.test/l0", '<a class="i" href="/d">d</a>')]
    stored = as_pages(spark.createDataFrame(pages, "url string, html string").coalesce(1))
    asked = spark.createDataFrame([("https://a.test", ".i", ".n")], "_site string, link_selector string, next_selector string")
    known = spark.createDataFrame([("https://a.test/l0", ".i", ".n")], "url string, link_selector string, next_selector string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = R.site_facts(asked, known, stored).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks[0] > 3                 # one task where the pages are parsed as they lie
    assert {r.url: r.next_url for r in rows} == {u: f"https://a.test/l{n + 1}" for n, (u, _) in enumerate(pages[:60]) if n}


def test_pages_without_references_keep_their_selector_errors(spark):
    keys = spark.createDataFrame([("https://a.test/x", "a:hover", "")], "url string, link_selector string, next_selector string")
    pages = as_pages(spark.createDataFrame([("https://a.test/x", "<p>text</p>")], "url string, html string"))
    row = R.link_facts(keys, pages).first()
    assert "unsupported selector" in row.error and row.links in ([], None) and row.next_url is None


def test_a_large_batch_of_pages_is_parsed_in_parts():
    pages = pa.array(['<ul class="a b">' + '<li><a href="/x" title="t">word</a></li>' * 200 + "</ul>", None] * 400)
    parse = P._make_parser()
    parse(pages.slice(0, 2))
    tracemalloc.start()
    whole = parse(pages)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20              # several hundred MB as lists of the whole batch
    assert len(whole) == 800 and [len(r["nodes"]) for r in whole.slice(0, 2).to_pylist()] == [401, 0]
    assert whole[798].as_py() == whole[0].as_py()
    match = P._make_matcher()(pages, pa.array([["li a"]] * 800))
    assert [len(r[0]["hrefs"]) for r in match.to_pylist()] == [200, 0] * 400
    assert len(parse(pages.slice(0, 0))) == 0


def listed_run(spark, count, limits, text="<h1>d</h1>"):
    """One run of tasks with ``limits`` on one listing of ``count`` links, and the pages."""
    links = "".join(f'<a class="i" href="/d{n}">d</a>' for n in range(count))
    pages = [("https://a.test/l", links), *[(f"https://a.test/d{n}", text) for n in range(count)]]
    values = {"link_selectors": F.array(F.lit(".i")), "title_selector": F.lit("h1")}
    rules = F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EXTRACTORS.fields])
    tasks = spark.createDataFrame(list(enumerate(limits)), "task_ord int, max_items int").select(
        F.lit("c").alias("crawl_id"), F.lit("s").alias("source_id"), "task_ord",
        *[F.col("task_ord").cast("string").alias(c) for c in ("task_id", "line_id", "line_name")],
        F.lit("https://a.test/l").alias("url"), "max_items", rules.alias("extractors"), F.lit(True).alias("dedup_enabled"))
    return tasks, as_pages(C.cut_lineage(spark.createDataFrame(pages, "url string, html string")))


def test_page_texts_are_not_shuffled_for_a_few_requests(spark):
    noise = random.Random(1)
    tasks, pages = listed_run(spark, 300, [3, 2], f"<h1>d</h1>{noise.randbytes(600).hex()}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64KB")
    try:
        items = C.crawl(tasks, pages).items
        plan = items._jdf.queryExecution().executedPlan().toString()
        assert items.count() == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_requests_beyond_the_limits_of_a_run_meet_no_page(spark, monkeypatch):
    met, state = [], C.with_state
    monkeypatch.setattr(C, "with_state", lambda wanted, *a: met.append(wanted.count()) or state(wanted, *a))
    result = C.crawl(*listed_run(spark, 300, [3, 2, None, 4]))
    assert met == [3 + 5 + 300 + 300]           # 1,200 where limits are looked at last
    assert {r.task_ord: r.item_count for r in result.tasks.collect()} == {0: 3, 1: 2, 2: 295, 3: 0}
    assert {(r.task_ord, r.url) for r in result.items.filter("task_ord < 2").collect()} == {
        (n // 3, f"https://a.test/d{n}") for n in range(5)}


def test_no_pass_for_pages_that_their_site_answers(spark, monkeypatch):
    passes, facts = [], R.link_facts
    monkeypatch.setattr(R, "link_facts", lambda *a: passes.append(1) or facts(*a))
    pages = [(f"https://a.test/l{n}", f'<a class="i" href="/d{n}">d</a><a class="n" href="/l{n + 1}">n</a>') for n in range(20)]
    pages[-1] = ("https://a.test/l19", '<a class="i" href="/d19">d</a>')
    starts = spark.createDataFrame(
        [("c", 0, [], "https://a.test/l0", ".i", ".n", None)],
        "crawl_id string, task_ord int, order_key array<int>, url string, link_selector string, next_selector string, max_pages int")
    visits, known = R.walk_listings(starts, as_pages(spark.createDataFrame(pages, "url string, html string")), "fail", 1)
    assert {(r.page_no, r.url, r.error) for r in visits.collect()} == {(n, f"https://a.test/l{n}", None) for n in range(20)}
    assert known.count() == 20 and len(passes) == 1         # two, the second for the page that the site's reading answers


def test_sites_are_read_alike_from_known_addresses(spark):
    pages = as_pages(spark.createDataFrame(
        [(f"https://{s}.test/{n}", f'<a class="i" HREF="/{n + 1}">d</a>' if n % 2 else "<p>text</p>") for s in "ab" for n in range(9)],
        "url string, html string"))
    asked = spark.createDataFrame(
        [("https://a.test", ".i", ".n"), ("https://a.test", "a", "")], "_site string, link_selector string, next_selector string")
    linked = R.linked_addresses(spark.createDataFrame([("https://a.test",), ("https://b.test",)], "_site string"), pages)
    assert linked.count() == 8
    plain, told = R.site_facts(asked, None, pages), R.site_facts(asked, None, pages, linked)
    assert sorted(map(str, plain.collect())) == sorted(map(str, told.collect())) and plain.count() == 8


def test_few_bytes_of_listings_are_parsed_by_all_cores(spark, monkeypatch):
    parsed, facts = [], R.facts_of
    monkeypatch.setattr(R, "facts_of", lambda pages: parsed.append(pages) or facts(pages))
    pages = as_pages(spark.createDataFrame(
        [(f"https://a.test/l{n}", f'<a class="i" href="/d{n}">d</a>') for n in range(400)], "url string, html string").coalesce(1))
    asked = spark.createDataFrame([("https://a.test", ".i", "")], "_site string, link_selector string, next_selector string")
    assert R.site_facts(asked, None, pages).count() == 400
    tasks = parsed[0].select(F.spark_partition_id().alias("n")).distinct().count()
    assert tasks >= spark.sparkContext.defaultParallelism       # one, as Spark coalesces 400 short rows
