"""Whole runs on random link graphs against a plain serial loop."""

import random

import pytest
from pyspark.sql import functions as F

from harvest.operators import ordered
from harvest.plans.crawl import crawl
from harvest.schemas import EXTRACTORS
from harvest.sources.pages import as_pages

BAD = "h1:first-line"
BAD_TEXT = f"unsupported selector: {BAD!r}"


def make_runs(seed, count):
    rnd = random.Random(seed)
    runs, pages = [], {}
    for n in range(count):
        urls = [f"https://r{n}-{j % 2 if n % 3 == 0 else 0}.test/p{j}" for j in range(rnd.randint(2, 9))]
        for url in urls:
            if rnd.random() < 0.1:
                continue            # not fetched
            status = rnd.choice([200] * 12 + [404, 503])
            links = {c: [rnd.choice(urls) for _ in range(rnd.randint(0, 5))] for c in "ab"}
            pages[url] = (status, links, rnd.choice(urls + [None] * 3))
        dedup = rnd.random() < 0.8
        tasks = []
        for order in range(rnd.randint(1, 4)):
            levels = rnd.choice([[], ["a"], ["a"], ["a", "b"]])
            tasks.append({
                "order": order, "url": rnd.choice(urls + urls + [None, ""]), "levels": levels,
                "limit": rnd.choice([None, None, 0, 1, 2, 3, 5]),
                "max_pages": rnd.choice([None, 0, 1, 2, 3, 3]), "follow": rnd.random() < 0.7,
                "title": rnd.choice([None, "h1", "h1", BAD] if rnd.random() < 0.3 else [None, "h1"])})
        runs.append({"id": f"run{n}", "dedup": dedup, "tasks": tasks})
    return runs, pages


class Failed(Exception):
    pass


def serial(runs, pages, missing, size=None, key=lambda url: url):
    def get(url):
        if url not in pages:
            if missing == "fail":
                raise Failed(f"HTTP 404: {url}")
            return {"a": [], "b": []}, None
        status, links, onward = pages[url]
        if status >= 400:
            raise Failed(f"HTTP {status}: {url}")
        return links, onward

    out = {}
    for run in runs:
        seen = set()
        for task in run["tasks"]:
            items = []

            def record(url):
                if run["dedup"] and key(url) in seen:
                    return
                get(url)
                seen.add(key(url))
                if task["title"] == BAD:
                    raise Failed(BAD_TEXT)
                if size is None:
                    items.append(url)
                elif size(url) == 4:
                    raise Failed("cannot read " + url)
                else:
                    items.extend(f"{url} {i}" for i in range(size(url)))

            try:
                if task["url"] and not task["levels"]:
                    record(task["url"])
                    if task["limit"] is not None:
                        items = items[:task["limit"]]
                elif task["url"]:
                    front = [task["url"]]
                    for kind in task["levels"]:
                        found = []
                        for start in front:
                            at, visited = start, []
                            while at is not None and at not in visited:
                                if task["max_pages"] is not None and len(visited) >= task["max_pages"]:
                                    break
                                visited.append(at)
                                links, onward = get(at)
                                found += list(dict.fromkeys(links[kind]))
                                at = onward if task["follow"] else None
                        front = found
                    for url in front:
                        if task["limit"] is not None and len(items) >= task["limit"]:
                            break
                        record(url)
                if task["limit"] is not None:
                    items = items[:task["limit"]]
                out[run["id"], task["order"]] = ("success", None, items)
            except Failed as problem:
                out[run["id"], task["order"]] = ("failed", str(problem), [])
    return out


def test_extractor_with_errors_and_many_records(spark):
    """0 to 3 records a page, some pages raise; limits count records."""
    runs, pages = make_runs(21, 80)
    for run in runs:
        for task in run["tasks"]:
            task["title"] = None

    def size(url):
        return sum(map(ord, url)) % 5

    def extractor(row):
        n = sum(map(ord, row["response_url"])) % 5
        if n == 4:
            raise RuntimeError("cannot read " + row["response_url"])
        return [{"title": f"{row['response_url']} {i}"} for i in range(n)]

    want = serial(runs, pages, "fail", size)
    tasks, stored = frames(spark, runs, pages)
    result = crawl(tasks, stored, extractor=extractor)
    got = {(r.crawl_id, r.task_ord): (r.status, r.error, []) for r in result.tasks.collect()}
    for r in result.items.orderBy("crawl_id", "task_ord", "order_key").collect():
        got[r.crawl_id, r.task_ord][2].append(r.title)
    assert got == want
    assert {r.item_count for r in result.tasks.collect()} >= {0, 1, 2}


def frames(spark, runs, pages):
    def html(url, links, onward):
        parts = [f"<h1>{url}</h1>"]
        for kind, targets in links.items():
            parts.append(f'<div class="{kind}">' + "".join(f'<a href="{u}">x</a>' for u in targets) + "</div>")
        if onward:
            parts.append(f'<p><a class="next" href="{onward}">n</a></p>')
        return "".join(parts)

    page_rows = [(u, s, html(u, links, onward)) for u, (s, links, onward) in pages.items()]
    page_df = as_pages(spark.createDataFrame(page_rows, "url string, status_code int, html string"))
    rows = [
        (r["id"], r["id"], t["order"], f"{r['id']}-{t['order']}", "l", "the line", t["url"], {}, t["limit"],
         ([f".{k} a" for k in t["levels"]], t["title"], None, None, "a.next" if t["follow"] else None,
          t["max_pages"]), r["dedup"])
        for r in runs for t in r["tasks"]]
    tasks = spark.createDataFrame(rows, (
        "crawl_id string, source_id string, task_ord int, task_id string, line_id string, line_name string, "
        "url string, params map<string,string>, max_items int, "
        f"extractors {EXTRACTORS.simpleString()}, dedup_enabled boolean"))
    return tasks, page_df


@pytest.mark.parametrize("missing, spread, page_rounds", [
    ("fail", False, 2), ("empty", True, 0)])
def test_equals_serial_loop(spark, missing, spread, page_rounds):
    # "spread": every group counts as too large for one task
    spark.conf.set(ordered.SETTING, "0" if spread else str(ordered.ROWS_IN_ONE_TASK))
    runs, pages = make_runs(page_rounds + 4, 120)
    want = serial(runs, pages, missing)
    result = crawl(*frames(spark, runs, pages), missing=missing, page_rounds=page_rounds)
    spark.conf.unset(ordered.SETTING)
    got = {(r.crawl_id, r.task_ord): (r.status, r.error, []) for r in result.tasks.collect()}
    items = result.items.orderBy("crawl_id", "task_ord", "order_key").collect()
    for r in items:
        got[r.crawl_id, r.task_ord][2].append(r.url)
    assert got == want
    assert len({r.item_id for r in items}) == len(items)
    totals = {(r.crawl_id): (r.total_items, r.success_count, r.failed_count) for r in result.runs.collect()}
    for run in runs:
        mine = [v for (rid, _), v in want.items() if rid == run["id"]]
        assert totals[run["id"]] == (
            sum(len(v[2]) for v in mine), sum(v[0] == "success" for v in mine),
            sum(v[0] == "failed" for v in mine))
    counted = {(r.crawl_id, r.task_ord): r.item_count for r in result.tasks.collect()}
    assert counted == {k: len(v[2]) for k, v in want.items()}


def test_nothing_in_nothing_out(spark):
    tasks, stored = frames(spark, *make_runs(1, 3))
    result = crawl(tasks.limit(0), stored)
    assert result.items.count() == result.tasks.count() == result.runs.count() == 0
    result = crawl(tasks, stored.limit(0), missing="empty")
    assert result.tasks.filter("status = 'failed' AND error NOT LIKE 'unsupported%'").count() == 0


def test_negative_limit_is_refused_for_its_task_only(spark):
    runs = [{"id": "r", "dedup": True, "tasks": [
        {"order": 0, "url": "https://x.test/1", "levels": [], "limit": -1, "max_pages": None, "follow": False,
         "title": None},
        {"order": 1, "url": "https://x.test/1", "levels": [], "limit": None, "max_pages": None, "follow": False,
         "title": None}]}]
    pages = {"https://x.test/1": (200, {"a": [], "b": []}, None)}
    result = crawl(*frames(spark, runs, pages))
    assert [(r.status, r.item_count) for r in result.tasks.orderBy("task_ord").collect()] == [
        ("failed", 0), ("success", 1)]
    assert result.items.select(F.count("*")).first()[0] == 1


def test_partitioning_does_not_matter(spark):
    runs, pages = make_runs(11, 40)
    want = serial(runs, pages, "fail")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in ("1", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        tasks, stored = frames(spark, runs, pages)
        result = crawl(tasks.repartition(int(partitions)), stored.repartition(3),
                       dedup_key=lambda url: F.concat(F.lit("k"), url))
        got = {(r.crawl_id, r.task_ord): (r.status, r.error, []) for r in result.tasks.collect()}
        for r in result.items.orderBy("crawl_id", "task_ord", "order_key").collect():
            got[r.crawl_id, r.task_ord][2].append(r.url)
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_keys_whose_addresses_differ_in_status(spark):
    """Many addresses share a key; a failing one that a lower task holds is skipped, not reported."""
    runs, pages = make_runs(31, 80)

    def key(url):
        return str(sum(map(ord, url)) % 23)

    want = serial(runs, pages, "fail", key=key)
    tasks, stored = frames(spark, runs, pages)
    result = crawl(tasks, stored, dedup_key=lambda url: F.aggregate(
        F.transform(F.filter(F.split(url, ""), lambda c: c != ""), lambda c: F.ascii(c)), F.lit(0), lambda a, b: a + b) % 23)
    got = {(r.crawl_id, r.task_ord): (r.status, r.error, []) for r in result.tasks.collect()}
    for r in result.items.orderBy("crawl_id", "task_ord", "order_key").collect():
        got[r.crawl_id, r.task_ord][2].append(r.url)
    assert got == want


def test_a_spoilt_task_with_many_addresses_fails_alone(spark):
    """More than 8,192 addresses of a task whose selector is invalid."""
    links = [f"https://x.test/d{i}" for i in range(9_000)]
    runs = [{"id": "r", "dedup": True, "tasks": [
        {"order": k, "url": "https://x.test/", "levels": ["a"], "limit": None, "max_pages": None, "follow": False,
         "title": BAD if k == 0 else None} for k in range(2)]}]
    pages = {"https://x.test/": (200, {"a": links, "b": []}, None)} | {u: (200, {"a": [], "b": []}, None) for u in links}
    result = crawl(*frames(spark, runs, pages))
    assert [(r.status, r.item_count) for r in result.tasks.orderBy("task_ord").collect()] == [("failed", 0), ("success", 8_999)]


@pytest.mark.parametrize("kinds, hosts", [(12, 1), (1, 2)])
def test_long_paginations_take_few_rounds(spark, monkeypatch, kinds, hosts):
    """200 chained pages: many selector pairs on one site, or a chain that changes hosts on its way."""
    from harvest.operators import frontier

    def at(i):
        return f"https://h{i * hosts // 200}.test/p{i}"

    body = "".join(f'<a class="k{k}" href="https://x.test/{k}">x</a>' for k in range(kinds))
    rows = [(at(i), 200, body + (f'<a class="next" href="{at(i + 1)}">n</a>' if i < 199 else "")) for i in range(200)]
    pages = as_pages(spark.createDataFrame(rows, "url string, status_code int, html string"))
    starts = spark.createDataFrame([("r", k, [], at(0), f".k{k}", "a.next", None) for k in range(kinds)], (
        "crawl_id string, task_ord int, order_key array<int>, url string, link_selector string, next_selector string, max_pages int"))
    calls = []
    one = frontier.link_facts
    monkeypatch.setattr(frontier, "link_facts", lambda *a: calls.append(1) or one(*a))
    visits, _ = frontier.walk_listings(starts, pages, "fail", page_rounds=0)
    assert visits.count() == 200 * kinds and visits.agg(F.max("page_no")).first()[0] == 199
    assert len(calls) <= 8 + 6
