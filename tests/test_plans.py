"""What the physical plans must and must not hold."""

import pytest
from pyspark.sql import functions as F

from checks.tables import Tables
from harvest.operators import catalog as K
from harvest.operators import detect as D
from harvest.operators import extract as E
from harvest.operators import frontier as R
from harvest.sources.pages import as_pages, save_pages_by_url

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def parses(df):
    text = plan(df)
    lines = [line for line in text.splitlines() if "ArrowEvalPython" in line]
    return sum("[parse(" in line or "[match(" in line for line in lines)


def asked(pages):
    return pages.withColumns({"line_name": F.lit("x"), "line_id": F.lit("l"), "source_id": F.lit("s")})


OPERATORS = {
    "html_nodes": lambda p: E.html_nodes(p).filter("tag = 'a'"),
    "select_nodes": lambda p: E.select_nodes(p, "a"),
    "select_text": lambda p: E.select_text(p, "h1"),
    "extract_links": lambda p: E.extract_links(p),
    "next_link": lambda p: E.next_link(p, "a"),
    "link_facts": lambda p: R.link_facts(
        p.select("url").withColumns({"link_selector": F.lit("a"), "next_selector": F.lit("h1")}), p),
    "data_items": lambda p: E.data_items(asked(p), "h1", ".d", "article"),
    "tag_signatures": D.tag_signatures,
    "link_groups": D.link_groups,
    "detect_link_selector": D.detect_link_selector,
    "detect_title": D.detect_title,
    "detect_time": D.detect_time,
    "detect_content_semantic": D.detect_content_semantic,
    "detect_content_density": D.detect_content_density,
    "detect_selectors": D.detect_selectors,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_each_page_is_parsed_once(spark, name):
    df = OPERATORS[name](Tables(spark, FOLDER).pages)
    assert parses(df) == 1
    assert "CartesianProduct" not in plan(df) and "BroadcastNestedLoopJoin" not in plan(df)


def test_page_texts_are_not_read_where_not_needed(spark):
    pages = Tables(spark, FOLDER).pages
    text = plan(E.data_items(asked(pages), "h1").select("url"))
    assert "ArrowEvalPython" not in text and "ReadSchema: struct<url:string>" in text
    states = R.with_state(pages.select("url"), pages, "fail")
    assert "html:string" not in plan(states)


def test_filters_reach_the_scan_below_the_parse(spark):
    pages = as_pages(spark.read.parquet(f"{FOLDER}/pages.parquet"))
    text = plan(E.html_nodes(pages.filter("url = 'x'")))
    assert "EqualTo(url,x)" in text


def test_detection_shuffles_nothing(spark):
    pages = as_pages(spark.read.parquet(f"{FOLDER}/pages.parquet"))
    assert "Exchange" not in plan(D.detect_selectors(pages))


def test_first_pages_are_top_k_and_ranks_are_pruned(spark):
    t = Tables(spark, FOLDER)
    assert "TakeOrderedAndProject" in plan(K.list_tasks(t.tasks, t.sources, offset=100))
    text = plan(K.result_preview(t.data.withColumn("url", F.col("id")), ["id"]))
    assert text.count("WindowGroupLimit") == 2


def test_pages_bucketed_by_address_are_not_shuffled(spark):
    import uuid

    name = f"pages_{uuid.uuid4().hex}"
    save_pages_by_url(as_pages(spark.read.parquet(f"{FOLDER}/pages.parquet")), name, 4)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        pages = as_pages(spark.table(name))
        text = plan(R.link_facts(pages.select("url").withColumns(
            {"link_selector": F.lit("a"), "next_selector": F.lit("")}).repartition(3), pages))
        assert "Bucketed: true" in text and text.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE {name}")
