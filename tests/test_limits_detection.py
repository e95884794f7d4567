"""Extraction on demand within limits, and detection inside the row."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from harvest.operators import config as C
from harvest.operators import detect
from harvest.plans.crawl import crawl
from harvest.sources.pages import as_pages


def site(spark, n, lists=("list",)):
    links = "".join(f'<li><a href="/doc/{k}">{k}</a></li>' for k in range(n))
    rows = [(f"https://x.test/{name}", f"<ul>{links}</ul>") for name in lists]
    return as_pages(spark.createDataFrame([*rows, *[(f"https://x.test/doc/{k}", str(k)) for k in range(n)]], "url string, html string"))


def tasks(spark, limits, lists=("list",), dedup=True):
    rows = [("run", "s", k, f"t{k}", f"l{k}", f"line {k}", f"https://x.test/{lists[k % len(lists)]}", limit, dedup, (["li a"], None, None, None, None, None))
            for k, limit in enumerate(limits)]
    return spark.createDataFrame(rows, (
        "crawl_id string, source_id string, task_ord int, task_id string, line_id string, line_name string, url string, max_items int, "
        "dedup_enabled boolean, extractors struct<link_selectors:array<string>,title_selector:string,time_selector:string,"
        "content_selector:string,next_page_selector:string,max_pages:int>"))


def counted(path, rule):
    """An extractor that notes each page it is called for."""
    def extract(row):
        with open(path, "a") as file:
            file.write(f"{row['line_id']}\n")
        return [{"title": f"{row['html']}-{n}"} for n in range(rule(int(row["html"])))]
    return extract


def calls(path):
    return Counter(path.read_text().split())


def test_a_limit_of_five_over_ten_thousand_links(spark, tmp_path):
    path = tmp_path / "calls"
    result = crawl(tasks(spark, [5, 5, 5]), site(spark, 10_000), extractor=counted(str(path), lambda k: 1))
    got = {r.task_id: r.n for r in result.items.groupBy("task_id").agg(F.count("*").alias("n")).collect()}
    assert got == {"t0": 5, "t1": 5, "t2": 5} and max(calls(path).values()) < 50
    assert {r.title for r in result.items.filter("task_id = 't2'").collect()} == {f"{k}-0" for k in range(10, 15)}


def test_pages_without_records_are_asked_for_in_doubling_numbers(spark, tmp_path):
    path = tmp_path / "calls"
    result = crawl(tasks(spark, [3]), site(spark, 2_000), extractor=counted(str(path), lambda k: int(k % 100 == 99)))
    assert [r.title for r in result.items.orderBy("title").collect()] == ["199-0", "299-0", "99-0"]
    assert calls(path)["l0"] < 700


@pytest.mark.parametrize("seed", [1, 2])
def test_demand_gives_the_rows_of_one_task_after_the_other(spark, tmp_path, seed):
    """Against a loop over tasks and pages, with failing pages, empty ones and many records in one."""
    rng = random.Random(seed)
    rule = {k: rng.choice([0, 0, 1, 1, 2, 7]) for k in range(60)}
    broken = set(rng.sample(range(30, 60), 2))
    limits = [rng.choice([1, 4, 9, None]) for _ in range(4)]

    def extract(row):
        if int(row["html"]) in broken:
            raise ValueError("odd page")
        return [{"title": f"{row['html']}-{n}"} for n in range(rule[int(row["html"])])]

    want, status, held = {}, {}, set()
    for k, limit in enumerate(limits):
        records, failed = [], False
        for page in range(60):
            if limit is not None and len(records) >= limit:
                break
            if page in held:
                continue
            held.add(page)
            if page in broken:
                failed = True
                break
            records += [f"{page}-{n}" for n in range(rule[page])]
        status[f"t{k}"] = "failed" if failed else "success"
        want[f"t{k}"] = set() if failed else set(records[:limit])
    result = crawl(tasks(spark, limits), site(spark, 60), extractor=extract)
    got = {f"t{k}": set() for k in range(4)}
    for r in result.items.select("task_id", "title").collect():
        got[r.task_id].add(r.title)
    assert got == want and {r.task_id: r.status for r in result.tasks.collect()} == status


PAGES = {
    "ties": '<div class="a"><a href=1></a></div><div class="b"><a href=2></a><a href=3></a><a href=4></a></div>'
            '<div class="a"><a href=5></a><a href=6></a></div>',
    "top": "<a href=1></a><a href=2></a><a href=3></a><p><a href=4></a></p>", "two": "<p><a href=1></a><a href=2></a></p>", "none": "<p>x</p>", "": "",
    "many": "".join(f'<div class="c{k % 700}"><a href={k}></a></div>' for k in range(2_100)) + '<div class="c699"><a href=z></a></div>',
}


def test_link_groups_equal_a_count_in_order(spark):
    pages = as_pages(spark.createDataFrame([(f"u{k}", h) for k, h in enumerate(PAGES.values())], "url string, html string"))
    groups = {}
    for r in detect.link_groups(pages).collect():
        groups.setdefault(list(PAGES)[int(r.page_url[1:])], {})[r.signature] = (r.links, r.first_pos)
    assert groups["ties"] == {"div.a": (3, 0), "div.b": (3, 1)} and groups["top"] == {None: (3, 0), "p": (1, 3)}
    assert groups["two"] == {"p": (2, 0)} and "none" not in groups and "" not in groups
    assert len(groups["many"]) == 700 and groups["many"]["div.c699"] == (4, 699) and groups["many"]["div.c0"] == (3, 0)
    found = {list(PAGES)[int(r.page_url[1:])]: r.link_selector for r in detect.detect_link_selector(pages).collect()}
    assert found == {"ties": "div.a a[href]", "top": None, "two": None, "none": None, "": None, "many": "div.c699 a[href]"}


@pytest.mark.parametrize("make", [detect.detect_selectors, detect.detect_link_selector, detect.link_groups])
def test_detection_moves_no_rows(spark, make):
    pages = as_pages(spark.createDataFrame([("u", "<p>x</p>")], "url string, html string"))
    plan = make(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_density_takes_the_densest_of_several(spark):
    text = "word " * 30
    thin = f'<div class="thin">{"<b></b>" * 40}{text}</div>'
    rows = [("dense", f'{thin}<section class="dense">{text}</section><div class="later">{text}</div>'),
            ("equal", f'<div class="one">{text}</div><div class="two">{text}</div>'),
            ("inner", f'<div class="outer"><i></i><main id="inner">{text}</main></div>'),
            ("short", f'<div class="short">{"x" * 99}</div>'), ("long", f'<div class="short">{"x" * 99}</div><article>{text}{thin}</article>')]
    pages = as_pages(spark.createDataFrame(rows, "url string, html string"))
    got = {r.page_url: r.content_selector for r in detect.detect_content_density(pages).collect()}
    assert got["equal"] == "div.one" and got["short"] is None and got["inner"] == "main#inner" or got["inner"] == "#inner"
    assert got["dense"] in ("section.dense", "div.later") and got["long"] in ("article", "div.thin")
