"""Settings, attempts, schedules, changes and streams on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from harvest.operators import catalog as K
from harvest.operators import config as C
from harvest.operators import frontier as R
from harvest.operators import outcome as O
from harvest.operators.ordered import OrderedGroups, number_rows
from harvest.plans.job import run_sources
from harvest.schemas import STORED
from harvest.sources.documents import read_run_configs, read_sources
from harvest.sources.pages import as_pages
from harvest.sources.sinks import write_result_json
from harvest.streaming import streams as S


def write_json(folder, name, value):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps(value, ensure_ascii=False))


SOURCE = {
    "id": "s", "name": "站点", "type": "website", "url": "https://s.test/", "meta": {
        "crawler_build_options": {"timeout": 99, "headers": {"X": "meta"}, "nonsense": 1}},
    "lines": [
        {"id": "l1", "source_id": "other", "name": "one", "url": "https://s.test/1", "item_limit": 2,
         "meta": {"extractor_config": {"link_selectors": [".a a", "b"], "max_pages": 4}, "k": [1, 2]}},
        {"id": "l2", "source_id": "s", "name": "two", "enabled": False},
        {"id": "l3", "source_id": "s", "name": "three", "meta": {"extractor_config": {}}}]}


def test_source_documents(spark, tmp_path):
    write_json(tmp_path / "in", "a.json", SOURCE)
    write_json(tmp_path / "in", "b.json", {"id": "bare", "name": "n", "type": "api", "url": "u"})
    write_json(tmp_path / "in", "c.json", {"id": "x", "type": "api"})
    write_json(tmp_path / "in", "d.json", {"id": "x", "name": "x", "type": "ftp"})
    good, bad = read_sources(spark, str(tmp_path / "in"))
    rows = {r.id: r for r in good.collect()}
    assert set(rows) == {"s", "bare"} and bad.count() == 2
    assert [n.source_id for n in rows["s"].lines] == ["s"] * 3
    assert rows["bare"].lines[0].id == "bare-default-line" and rows["bare"].lines[0].url == "u"

    tasks = C.plan_tasks(good.filter("id = 's'")).orderBy("task_ord").collect()
    assert [(t.line_id, t.task_ord, t.max_items) for t in tasks] == [("l1", 0, 2), ("l3", 2, None)]
    assert tasks[0].extractors.link_selectors == [".a a", "b"] and tasks[0].extractors.max_pages == 4
    assert tasks[0].params == {"k": "[1,2]"} and tasks[1].extractors.link_selectors == []

    given = C.with_run_options(good.filter("id = 's'"), {"timeout": None, "headers": {"Y": "o"}},
                               {"rate_limit": None, "headers": {"X": "over"}, "meta": {"m": "1"}})
    run = C.resolve_run_config(given).first()
    assert (run.timeout, run.rate_limit, run.retry_delay, run.run_meta) == (99.0, None, 2.0, {"m": "1"})
    assert run.headers["X"] == "over" and run.headers["Y"] == "o" and "User-Agent" in run.headers


def test_invalid_settings_are_named(spark):
    sources = spark.createDataFrame(
        [("a", "a", "api", '{"retry_max":"x","timeout":"5"}'), ("b", "b", "api", '{"retry_max":2.0,"downloader":"ftp"}'),
         ("c", "c", "api", '{"retry_max":4.0,"dedup_enabled":false}')],
        "id string, name string, type string, overrides string")
    rows = {r.id: r for r in C.resolve_run_config(sources).collect()}
    assert rows["a"].config_error == "invalid setting: overrides.retry_max" and rows["a"].timeout == 5.0
    assert rows["b"].config_error == "invalid setting: overrides.downloader"
    assert (rows["c"].config_error, rows["c"].retry_max, rows["c"].dedup_enabled) == (None, 4, False)


def test_job_with_an_invalid_run(spark, tmp_path):
    from harvest.plans.job import run_job

    sources = spark.createDataFrame([("a", "A", "api", "u"), ("b", "B", "api", "u")],
                                    "id string, name string, type string, url string")
    lines = spark.createDataFrame([("a1", "a", "one", "https://x.test/1", True, 0), ("b1", "b", "one", "https://x.test/2", True, 0)],
                                  "id string, source_id string, name string, url string, enabled boolean, line_ord int")
    triggers = spark.createDataFrame([("t1", "a", "{}"), ("t2", "b", '{"concurrency":"many"}'), ("t3", "z", "{}")],
                                     "trigger_id string, source_id string, overrides string")
    site = as_pages(spark.createDataFrame([("https://x.test/1", "one")], "url string, html string"))
    empty = spark.createDataFrame([], STORED["crawler_tasks"])
    now = F.lit("2024-01-01").cast("timestamp")
    job = run_job(triggers, sources, lines, empty, site, str(tmp_path / "out"), now)
    assert {(r.source_id, r.status, r.total_items, r.error) for r in job.tasks.collect()} == {
        ("a", "success", 1, None), ("b", "failed", 0, "invalid setting: overrides.concurrency")}
    assert {r.code for r in job.answers.collect()} == {201, 404}
    logs = {r.message for r in spark.read.parquet(str(tmp_path / "out" / "crawler_logs")).collect()}
    assert logs == {"Crawl completed: 1 items", "Crawl failed: invalid setting: overrides.concurrency"}


def test_run_documents(spark, tmp_path):
    write_json(tmp_path / "in", "a.json", {"crawler_id": "c", "source_id": "s", "retry_max": 0, "tasks": [
        {"task_id": "t1", "line_id": "l1", "url": "u", "extractors": {"title_selector": "h1"}}]})
    write_json(tmp_path / "in", "b.json", {"crawler_id": "d", "source_id": "s", "tasks": []})
    rows = {r.crawl_id: r for r in read_run_configs(spark, str(tmp_path / "in")).collect()}
    assert (rows["c"].retry_max, rows["c"].timeout, rows["c"].extractors.title_selector) == (0, 30.0, "h1")
    assert rows["d"].task_id is None and rows["d"].retry_max == 3


def test_run_sources_and_json(spark, tmp_path):
    site = as_pages(spark.createDataFrame([
        ("https://s.test/1", '<div class="a"><a href="/x">x</a></div>'),
        ("https://s.test/x", '<b><a href="/y">y</a></b><b>z</b>'), ("https://s.test/y", "Y")],
        "url string, html string"))
    write_json(tmp_path / "in", "a.json", {**SOURCE, "lines": [{
        "id": "l1", "source_id": "s", "name": "one", "url": "https://s.test/1", "meta": {
            "extractor_config": {"link_selectors": [".a a", "b a"]}}}]})
    result = run_sources(read_sources(spark, str(tmp_path / "in"))[0], site)
    assert [(r.url, r.title, r.content) for r in result.items.collect()] == [("https://s.test/y", "one", "Y")]
    write_result_json(result, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "runs")).first().total_items == 1


def test_redirected_record_keeps_the_response_address(spark):
    site = as_pages(spark.createDataFrame(
        [("https://s.test/1", "x", "https://t.test/moved")], "url string, html string, response_url string"))
    sources = C.seeds_to_sources(spark.createDataFrame([("s", "https://s.test/1")], "id string, url string"))
    assert run_sources(sources, site).items.first().url == "https://t.test/moved"


@pytest.mark.parametrize("attempts, retry_max, want", [
    ([500, 200], 2, ("ok", 200, None, 2)),
    ([500, 500, 500, 500], 3, ("failed", 500, "HTTP 500: https://x.test/r", 4)),
    (["refused", 200], 2, ("ok", 200, None, 2)),
    (["timeout", "timeout", 200], 1, ("failed", None, "timeout", 2)),
    ([404, 200], 3, ("failed", 404, "HTTP 404: https://x.test/r", 1)),
    ([503, 200], 0, ("failed", 503, "HTTP 503: https://x.test/r", 1)),
])
def test_attempts(spark, attempts, retry_max, want):
    rows = [("r", "https://x.test/r", n, None if isinstance(a, str) else a, a if isinstance(a, str) else None)
            for n, a in enumerate(attempts)]
    log = spark.createDataFrame(rows, "request_id string, url string, attempt int, status_code int, error string")
    row = O.resolve_attempts(log, retry_max).first()
    assert (row.outcome, row.status_code, row.error, row.attempts) == want


@pytest.mark.parametrize("most", [1, 10, 10_000])
def test_running_values_do_not_depend_on_the_way(spark, most):
    rows = [("hot" if i % 3 else f"g{i}", (i * 7919) % 1000, float(i % 11)) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, o int, v double").repartition(7)
    groups = OrderedGroups(df, ["g"], ["o"], most).running("s", F.col("v")).running("m", F.col("v"), "max")
    total, top, want = {}, {}, set()
    for g, o, v in sorted(rows):
        total[g], top[g] = total.get(g, 0.0) + v, max(top.get(g, v), v)
        want.add((g, o, total[g], top[g]))
    assert {(r.g, r.o, r.s, r.m) for r in groups.frame().collect()} == want
    placed = number_rows(df, ["g"], ["o"], "n", most)
    assert placed.filter("g = 'hot'").agg(F.max("n"), F.countDistinct("n")).first()[:] == (666, 666)


def test_schedule(spark):
    rows = [("a", i, t, 2.0) for i, t in enumerate([0.0, 0.1, 0.2, 5.0])] + [("b", 9, 3.0, None)]
    df = spark.createDataFrame(rows, "run_id string, request_id int, arrival double, rate_limit double")
    for most in (1, 100):
        got = {r.request_id: r.start for r in O.rate_schedule(df, most).collect()}
        assert got == pytest.approx({0: 0.0, 1: 0.5, 2: 1.0, 3: 5.0, 9: 3.0})
    with pytest.raises(ValueError):
        O.rate_schedule(df.withColumn("rate_limit", F.lit(0.0)))


def test_negative_limit_raises(spark):
    df = spark.createDataFrame([("r", 0, [0], "u", -1)],
                               "crawl_id string, task_ord int, order_key array<int>, url string, max_items int")
    with pytest.raises(ValueError):
        R.limit_items(df)


def test_unknown_status_shows_in_the_total_only(spark):
    df = spark.createDataFrame([("success",), ("skipped",)], "status string")
    assert K.task_status_counts(df).first().asDict() == {
        "task_count": 2, "pending": 0, "running": 0, "success": 1, "failed": 0}


def test_stream_dedup_forgets_after_the_delay(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    rows = [("2024-01-01 00:00:00", "u"), ("2024-01-01 00:00:30", "u"), ("2024-01-01 02:00:00", "v"),
            ("2024-01-01 03:00:00", "w"), ("2024-01-01 04:00:00", "u")]
    for n, (ts, url) in enumerate(rows):      # one file per batch, oldest first
        df = spark.createDataFrame([(ts, "run", url)], "ts string, crawl_id string, url string")
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = S.read_stream(spark, str(tmp_path / "in"), files=1)
    S.write_stream(S.stream_dedup(stream, delay="10 minutes"), str(tmp_path / "out")).awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out" / "rows")).collect()) == ["u", "u", "v", "w"]


def test_new_rows_of_one_id_are_folded(spark):
    from harvest.operators import changes as M

    table = spark.createDataFrame([("a", "old")], "id string, name string")
    rows = spark.createDataFrame([("a", "x"), ("b", "2"), ("b", "1"), ("b", "1"), ("c", None)], "id string, name string")
    new, clash = M.insert_new(table, rows)
    assert sorted((r.id, r.name) for r in new.collect()) == [("a", "old"), ("b", "1"), ("c", None)]
    assert sorted((r.id, r.name) for r in clash.collect()) == [("a", "x"), ("b", "1"), ("b", "2")]


def test_a_bad_value_refuses_its_change_only(spark):
    from harvest.operators import changes as M

    table = spark.createDataFrame([("a", 1, None), ("b", 2, None), ("c", 3, None)], "id string, n int, updated_at timestamp")
    rows = spark.createDataFrame([("a", {"n": "x"}), ("b", {"n": "7"}), ("b", {"n": "8"}), ("z", {"n": "1"}), ("c", {"n": None})],
                                 "id string, changes map<string,string>")
    now = F.lit("2024-01-01").cast("timestamp")
    out, missing, refused = M.patch(table, rows, now, ["n"])
    assert sorted((r.id, r.n) for r in out.collect()) == [("a", 1), ("b", 7), ("c", None)]
    assert [r.id for r in missing.collect()] == ["z"] and sorted(r.id for r in refused.collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        M.patch(table, rows, now, ["id"])


def test_an_unknown_type_is_an_error_of_its_source(spark):
    sources = spark.createDataFrame([("s", "website"), ("t", "fax"), ("u", None)], "id string, type string")
    got = {r.id: r.config_error for r in C.resolve_run_config(C.with_run_options(sources)).collect()}
    assert got == {"s": None, "t": "unknown source type: fax", "u": "unknown source type: none"}


def test_scratch_folder_without_the_setting():
    from types import SimpleNamespace as N

    from harvest.session import scratch_dir

    def session(master, app="a", folder=None):
        return N(conf=N(get=lambda *_: folder), sparkContext=N(master=master, applicationId=app))

    assert scratch_dir(session("local[2]", "a")) == scratch_dir(session("local[*]", "a")) != scratch_dir(session("local[2]", "b"))
    assert scratch_dir(session("spark://x", folder="s3://f")) == "s3://f"
    for master in ("spark://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            scratch_dir(session(master))
