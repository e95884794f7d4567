"""Tables of fetched pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvest.schemas import PAGE


def as_pages(df: DataFrame) -> DataFrame:
    """Complete a table with ``url, html`` to the response shape, one row per address expected.

    An absent or null status is 200, an absent content type ``text/html``, an absent
    ``response_url`` the address asked for; ``error`` holds the text of a failed connection.
    """
    defaults = {"status_code": F.lit(200), "html": F.lit(""), "content_type": F.lit("text/html"),
                "response_url": F.col("url")}
    columns = []
    for field in PAGE.fields:
        have = F.col(field.name) if field.name in df.columns else F.lit(None)
        value = have.cast(field.dataType)
        if field.name in defaults:
            value = F.coalesce(value, defaults[field.name])
        columns.append(value.alias(field.name))
    extra = [c for c in df.columns if c not in PAGE.names]
    return df.select(*extra, *columns)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages as a response table.

    Parsing is heavy work per byte. A store of fewer splits than the cluster has cores is dealt
    out to all of them; a larger one is read as it lies, without a shuffle of page texts.
    """
    stored = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if stored.rdd.getNumPartitions() < cores:
        stored = stored.repartition(cores)
    return as_pages(stored)


def save_pages_by_url(pages: DataFrame, table: str, buckets: int) -> None:
    """Store pages bucketed by address, so that fetching joins shuffle the requests only."""
    (pages.write.mode("overwrite").bucketBy(buckets, "url").sortBy("url").format("parquet")
     .saveAsTable(table))
