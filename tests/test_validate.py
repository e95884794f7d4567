"""Documents and settings are refused with a reason for every fault."""

import json

import pytest
from pyspark.sql import functions as F

from harvest.operators import config as C
from harvest.operators.validate import Field, document_faults, typed
from harvest.sources.documents import read_run_configs, read_sources, refused_run_configs


def put(folder, rows, name="a.json"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(folder)


def reasons(spark, fields, values):
    rows = [(i, v if isinstance(v, str) and v[:1] == "!" else json.dumps(v)) for i, v in enumerate(values)]
    docs = spark.createDataFrame([(i, t.lstrip("!")) for i, t in rows], "i int, t string")
    found = docs.select("i", document_faults(F.try_parse_json("t"), fields).alias("r")).orderBy("i").collect()
    return [r.r for r in found]


@pytest.mark.parametrize("kind, good, bad", [
    ("text", ["", "x"], [1, True, [], {}]),
    ("int", [3, 3.0, "3", " -7 ", "4.0", True], ["x", 2.5, "", "2.5", [], {}, 3_000_000_000]),
    ("float", [1, 2.5, "1e3", ".5", False], ["x", "", [], {}]),
    ("bool", [True, 0, 1, 1.0, "TRUE", "off", "y"], [2, 0.5, "maybe", [], {}]),
    ("time", ["2024-05-01T12:00:00", 1_700_000_000], ["yesterday", [], True]),
    ("any_map", [{}, {"a": [1]}], ["{}", [], 1]),
    ("text_map", [{}, {"a": "b"}], [{"a": 1}, {"a": None}, [], "x"]),
    ("texts", [[], ["a", "b"]], ["a", ["a", 1], [None], {}]),
])
def test_kinds(spark, kind, good, bad):
    fields = (Field("v", kind),)
    assert reasons(spark, fields, [{"v": v} for v in good]) == [None] * len(good)
    assert all(r and r.startswith("v: must be ") for r in reasons(spark, fields, [{"v": v} for v in bad]))


def test_presence_null_nesting_and_broken_json(spark):
    fields = (
        Field("id", required=True), Field("mode", allowed=("a", "b")), Field("n", "int", nullable=True),
        Field("parts", "objects", fields=(Field("key", required=True), Field("inner", "object", fields=(Field("k", "int"),)))))
    assert reasons(spark, fields, [
        {"id": "x"}, {}, {"id": None}, {"id": "x", "mode": "c"}, {"id": "x", "n": None, "other": 5},
        {"id": "x", "parts": [{"key": "a", "inner": {"k": "q"}}, {}, 7]}, {"id": 1, "n": "x"},
        "!{bad", "![1]", '!"text"', {"id": "x", "parts": None},
    ]) == [
        None, "id: is missing", "id: must not be null", "mode: must be one of a, b", None,
        "parts[0].inner.k: must be a whole number; parts[1].key: is missing; parts[2]: must be an object",
        "id: must be a text; n: must be a whole number", "not a JSON object", "not a JSON object", "not a JSON object",
        "parts: must not be null"]


def test_typed_values(spark):
    docs = spark.createDataFrame([(json.dumps({
        "i": "4.0", "t": True, "f": "1e2", "b": "off", "m": {"b": 1, "a": "x", "n": None}, "l": ["p"]}),)], "t string")
    doc = F.try_parse_json("t")
    of = lambda name, kind, to: typed(F.try_variant_get(doc, f"$.{name}", "variant"), Field(name, kind), to)
    from pyspark.sql import types as T

    text_map = T.MapType(T.StringType(), T.StringType())
    row = docs.select(
        of("i", "int", T.IntegerType()).alias("i"), of("t", "int", T.IntegerType()).alias("t"),
        of("f", "float", T.DoubleType()).alias("f"), of("b", "bool", T.BooleanType()).alias("b"),
        of("m", "any_map", text_map).alias("m"), of("m", "any_map", T.StringType()).alias("j"),
        of("l", "texts", T.ArrayType(T.StringType())).alias("l"), of("none", "int", T.IntegerType()).alias("none")).first()
    assert (row.i, row.t, row.f, row.b, row.m, row.l, row.none) == (4, 1, 100.0, False, {"a": "x", "b": "1", "n": None}, ["p"], None)
    assert json.loads(row.j) == {"b": 1, "a": "x", "n": None}


def test_sources_are_refused_with_reasons(spark, tmp_path):
    line = {"id": "l", "source_id": "s", "name": "n"}
    folder = put(tmp_path / "in", [
        {"id": "a", "name": "A", "type": "api", "lines": [dict(line, item_limit="7", meta={"k": {"x": 1}})], "meta": {"z": 1}},
        {"id": "b", "type": "api", "lines": [dict(line, item_limit="many")]},
        {"id": "c", "name": "C", "type": "fax", "enabled": "perhaps"},
        {"id": "d", "name": "D", "type": "file", "lines": {"id": "l"}},
        {"id": "e", "name": "E", "type": "file", "lines": [{"id": "l", "name": "n"}, "x"], "created_at": "soon"},
        '{"id": "f", "name": ', '["id", "name"]',
    ])
    accepted, refused = read_sources(spark, folder, multiline=False)
    row = accepted.collect()
    assert [r.id for r in row] == ["a"] and row[0].lines[0].item_limit == 7 and row[0].lines[0].source_id == "a"
    assert json.loads(row[0].lines[0].meta) == {"k": {"x": 1}} and json.loads(row[0].meta) == {"z": 1}
    assert {(r.id, r.reason) for r in refused.collect()} == {
        ("b", "name: is missing; lines[0].item_limit: must be a whole number"),
        ("c", "type: must be one of website, api, file, stream, external; enabled: must be true or false"),
        ("d", "lines: must be a list"),
        ("e", "lines[0].source_id: is missing; lines[1]: must be an object; created_at: must be a time"),
        (None, "not a JSON object")}
    assert {r.document[:8] for r in refused.filter("id IS NULL").collect()} == {'{"id": "', '["id", "'}


def test_whole_files_and_lists_of_documents(spark, tmp_path):
    folder = put(tmp_path / "in", ['[{"id": "a", "name": "A", "type": "api"},', ' {"id": "b",\n "name": "B", "type": 3}]'])
    accepted, refused = read_sources(spark, folder)
    assert [r.id for r in accepted.collect()] == ["a"] and [r.id for r in refused.collect()] == ["b"]


def test_run_documents_are_refused_with_reasons(spark, tmp_path):
    task = {"task_id": "t", "line_id": "l"}
    folder = put(tmp_path / "in", [
        {"crawler_id": "a", "source_id": "s", "timeout": "5", "tasks": [dict(task, max_items=3.0, params={"n": 1, "t": "x"})]},
        {"crawler_id": "b", "source_id": "s", "tasks": [dict(task, max_items="abc")]},
        {"crawler_id": "c", "downloader": "ftp", "headers": {"h": 1}},
        {"crawler_id": "d", "source_id": "s", "tasks": [dict(task, extractors={"link_selectors": "a", "max_pages": "x"})]},
        {"crawler_id": "e", "source_id": "s", "rate_limit": None, "retry_max": None},
        '{"crawler_id"'])
    rows = read_run_configs(spark, folder, multiline=False).collect()
    assert [(r.crawl_id, r.max_items, r.timeout, r.params) for r in rows] == [("a", 3, 5.0, {"n": "1", "t": "x"})]
    assert {(r.crawler_id, r.reason) for r in refused_run_configs(spark, folder, multiline=False).collect()} == {
        ("b", "tasks[0].max_items: must be a whole number"),
        ("c", "source_id: is missing; downloader: must be one of http, playwright; headers: must be an object of texts"),
        ("d", "tasks[0].extractors.link_selectors: must be a list of texts; tasks[0].extractors.max_pages: must be a whole number"),
        ("e", "retry_max: must not be null"), (None, "not a JSON object")}


META = {
    "fine": {"extractor_config": {"link_selectors": ["a"], "max_pages": "2"}, "lane": "x"},
    "links": {"extractor_config": {"link_selectors": "a"}},
    "pages": {"extractor_config": {"max_pages": "x", "title_selector": 5}},
    "empty": {"extractor_config": {}}, "list": {"extractor_config": ["a"]}, "none": {},
}


def test_lines_with_bad_selectors_start_no_run(spark):
    rows = [(k, [(f"{k}-1", json.dumps(m), True), (f"{k}-2", "{}", True)]) for k, m in META.items()]
    rows += [("off", [("off-1", json.dumps(META["links"]), False), ("off-2", None, True)]), ("text", [("text-1", "{bad", True)])]
    sources = spark.createDataFrame(rows, "id string, lines array<struct<id:string,meta:string,enabled:boolean>>").select("id", F.transform(
        "lines", lambda n: F.struct(n["id"].alias("id"), F.lit("n").alias("name"), F.lit("u").alias("url"), n["enabled"].alias("enabled"),
                                    F.lit(1).alias("item_limit"), n["meta"].alias("meta"))).alias("lines"))
    tasks = {r.line_id: r for r in C.plan_tasks(sources).collect()}
    assert tasks["fine-1"].extractors.max_pages == 2 and tasks["fine-1"].params == {"lane": "x"}
    assert tasks["list-1"].extractors.link_selectors == [] and tasks["off-2"].config_error is None
    bad = {k: r.config_error for k, r in tasks.items() if r.config_error}
    links = "invalid selectors of line links-1: link_selectors: must be a list of texts"
    pages = "invalid selectors of line pages-1: title_selector: must be a text; max_pages: must be a whole number"
    assert bad == {"links-1": links, "links-2": links, "pages-1": pages, "pages-2": pages}
    lines = sources.select(F.col("id").alias("source_id"), F.posexplode("lines").alias("line_ord", "n")).select("source_id", "line_ord", "n.*")
    apart = {r.line_id: r.config_error for r in C.plan_tasks(sources.select("id"), lines).collect() if r.config_error}
    assert apart == bad


def test_a_bad_number_of_pages_never_runs(spark):
    from harvest.plans.job import run_sources
    from harvest.sources.pages import as_pages

    pages = as_pages(spark.createDataFrame([("https://x.test/1", "one")], "url string, html string"))
    meta = [json.dumps({"extractor_config": {"max_pages": "x"}}), "{}"]
    line = "id string, source_id string, name string, url string, description string, enabled boolean, item_limit int, meta string, created_at timestamp, updated_at timestamp"
    rows = [(k, k, "api", "u", "", True, "{}", [(f"{k}l", k, "n", "https://x.test/1", "", True, None, m, None, None)]) for k, m in zip("ab", meta)]
    sources = spark.createDataFrame(rows, f"id string, name string, type string, url string, description string, enabled boolean, meta string, lines array<struct<{line.replace(' string', ':string').replace(' boolean', ':boolean').replace(' int', ':int').replace(' timestamp', ':timestamp')}>>")
    result = run_sources(sources, pages)
    assert [r.source_id for r in result.items.collect()] == ["b"]
    assert {(r.source_id, r.status) for r in result.tasks.collect()} == {("a", "failed"), ("b", "success")}
    assert "max_pages" in result.tasks.filter("status = 'failed'").first().error
