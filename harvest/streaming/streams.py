"""The same work on pages, addresses and task changes as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from harvest.functions.text import url_key
from harvest.operators.extract import data_items, extract_links, page_items


def read_stream(spark: SparkSession, folder: str, name: str = "*.parquet", files: int = 100) -> DataFrame:
    """Parquet files of a folder as they appear; a ``name`` that is itself a folder of files is read as that folder."""
    def named(reader):
        return reader.option("pathGlobFilter", name)

    path = folder
    try:
        one = named(spark.read).parquet(folder)
    except AnalysisException as problem:
        if problem.getCondition() != "UNABLE_TO_INFER_SCHEMA":      # no such file
            raise
        path, named = f"{folder}/{name}", lambda reader: reader
        one = spark.read.parquet(path)
    return named(spark.readStream).schema(one.schema).option("maxFilesPerTrigger", files).parquet(path)


def write_stream(stream: DataFrame, folder: str) -> StreamingQuery:
    """Append to a Parquet folder until all present input is read."""
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{folder}/_progress").option("path", f"{folder}/rows")
        .trigger(availableNow=True).start())


def stream_extract(pages: DataFrame, mode: str = "data", **selectors: str) -> DataFrame:
    """Records (``data``, ``page``) or links (``links``) of pages as they arrive; no state."""
    if mode == "links":
        return extract_links(pages, selectors.get("selector", "a[href]"))
    return page_items(pages) if mode == "page" else data_items(pages, **selectors)


def stream_dedup(
    urls: DataFrame, delay: str | None = None, time: str = "ts",
    key: Callable[[Column], Column] = url_key,
) -> DataFrame:
    """First arrival of each address per run.

    With ``delay`` an address is remembered for that long behind the newest ``time``; one that
    comes again later is passed on again. Without it the memory grows with all addresses.
    """
    keyed = urls.withColumn("url_key", key(F.col("url")))
    if delay is None:
        return keyed.dropDuplicates(["crawl_id", "url_key"])
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["crawl_id", "url_key"])
