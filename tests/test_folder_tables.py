"""Tables stored as folders of files, and pages that share an address."""

from pyspark.sql import functions as F

from harvest.operators import detect as D
from harvest.operators import extract as E
from harvest.sources.pages import as_pages
from harvest.streaming import streams as S


def streamed(spark, stream, folder):
    S.write_stream(stream, folder).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def test_a_table_that_is_a_folder_of_files_is_streamed_whole(spark, tmp_path):
    rows = spark.range(100).select(F.concat(F.lit("https://a.test/"), F.col("id").cast("string")).alias("url"),
                                   F.lit('<h1>T</h1><a href="/x">x</a>').alias("html"))
    rows.repartition(3).write.parquet(str(tmp_path / "in" / "pages.parquet"))
    rows.write.parquet(str(tmp_path / "in" / "other.parquet"))
    pages = as_pages(S.read_stream(spark, str(tmp_path / "in"), "pages.parquet", files=1)).withColumns({
        "line_name": F.lit("line"), "line_id": F.lit("l"), "source_id": F.lit("s")})
    records = streamed(spark, S.stream_extract(pages, title="h1"), str(tmp_path / "records"))
    links = streamed(spark, S.stream_extract(pages, mode="links"), str(tmp_path / "links"))
    want = {f"https://a.test/{n}" for n in range(100)}
    assert records.count() == 100 and {r.url for r in records.filter("title = 'T'").collect()} == want
    assert links.count() == 100 and {r.page_url for r in links.collect()} == want


def shared(spark):
    return as_pages(spark.createDataFrame([
        (1, "https://a.test/", "<p>x</p><p>y</p>"), (2, "https://a.test/", '<div class="ad"><p>z</p></div>')],
        "page_id long, url string, html string"))


def counted(rows):
    return sorted((r.page_id, r["count"]) for r in rows.groupBy("page_id", "page_url").count().collect())


def test_nodes_of_pages_that_share_an_address_are_told_apart(spark):
    assert counted(E.html_nodes(shared(spark), "page_id")) == [(1, 2), (2, 2)]
    assert "page_id" not in E.html_nodes(shared(spark)).columns


def test_signatures_of_pages_that_share_an_address_are_told_apart(spark):
    assert counted(D.tag_signatures(shared(spark), "page_id")) == [(1, 2), (2, 2)]


def test_registered_counts_are_those_of_pages_not_of_addresses(spark, tmp_path):
    from checks import QUERIES

    shared(spark).select("page_id", "url", "html").write.parquet(str(tmp_path / "pages.parquet"))
    assert sorted(r.p for r in QUERIES["html_nodes"](spark, str(tmp_path)).collect()) == [1, 2]
    assert sorted(r.ads for r in QUERIES["tag_signature"](spark, str(tmp_path)).collect()) == [0, 1]
