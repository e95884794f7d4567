"""Source and run documents (JSON) and the stored tables (Parquet)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvest.operators.config import normalise_line_owner, with_default_lines
from harvest.operators.validate import document_faults, kind_of, part, structure, typed
from harvest.schemas import (
    EXTRACTORS, LINE, RUN_CONFIG, RUN_FIELDS, SOURCE, SOURCE_FIELDS, STORED)

STRING = T.StringType()


def _documents(spark: SparkSession, path: str, multiline: bool, fields: tuple) -> DataFrame:
    """(document, doc, reason): JSON documents as text and variant, and what is wrong with each.

    One document a line; with ``multiline`` one a file, or a list of them.
    """
    rows = spark.read.text(path, wholetext=multiline).filter(F.trim("value") != "")
    rows = rows.select(F.col("value").alias("document"), F.try_parse_json("value").alias("doc"))
    if multiline:
        each = F.when(kind_of(F.col("doc")) == "list", F.try_variant_get("doc", "$", "array<variant>")).otherwise(F.array("doc"))
        rows = rows.select("document", F.explode(each).alias("doc")).withColumn(
            "document", F.coalesce(F.to_json("doc"), "document"))
    return rows.withColumn("reason", document_faults(F.col("doc"), fields))


def _refused(docs: DataFrame, fields: tuple, *names: str) -> DataFrame:
    """Refused documents with their reason and those of the fields that can be told."""
    by_name = {f.name: f for f in fields}
    told = [F.when(kind_of(part(F.col("doc"), n)) == "text", typed(part(F.col("doc"), n), by_name[n], STRING)).alias(n) for n in names]
    return docs.filter("reason IS NOT NULL").select(*told, "reason", "document")


def read_sources(spark: SparkSession, path: str, multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """Source documents: (accepted, refused).

    A source needs ``id``, ``name`` and one of the five types, each line ``id``, ``source_id`` and
    ``name``, and every field that is there must be of its type. Accepted sources have their defaults,
    own their lines and hold at least one line. Refused ones (``id, name, type, url, reason,
    document``) name every field that is missing or does not fit.
    """
    docs = _documents(spark, path, multiline, SOURCE_FIELDS)
    empty = {"description": F.lit(""), "enabled": F.lit(True), "meta": F.lit("{}")}

    def complete(line):
        return F.struct(*[
            F.coalesce(line[f.name], empty[f.name]).alias(f.name) if f.name in empty
            else line[f.name].alias(f.name) for f in LINE.fields])

    accepted = docs.filter("reason IS NULL").select(structure(F.col("doc"), SOURCE_FIELDS, SOURCE).alias("s")).select("s.*").withColumns({
        **{name: F.coalesce(name, value) for name, value in empty.items()},
        "lines": F.transform("lines", complete)})
    return (normalise_line_owner(with_default_lines(accepted)),
            _refused(docs, SOURCE_FIELDS, "id", "name", "type", "url"))


def refused_run_configs(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """The run documents that :func:`read_run_configs` leaves out: ``crawler_id, source_id, reason, document``."""
    return _refused(_documents(spark, path, multiline, RUN_FIELDS), RUN_FIELDS, "crawler_id", "source_id")


def read_run_configs(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Stored run documents as task rows with their run's settings; a run without tasks keeps
    one row with null task columns. Absent settings take the run defaults. Documents with a field that
    is missing or of another type give no row, see :func:`refused_run_configs`."""
    docs = _documents(spark, path, multiline, RUN_FIELDS).filter("reason IS NULL")
    raw = docs.select(structure(F.col("doc"), RUN_FIELDS, RUN_CONFIG).alias("r")).select("r.*")
    # Settings of a run document that does not name them.
    defaults = {"source_name": "", "downloader": "http", "timeout": 30.0, "retry_max": 3,
                "retry_delay": 1.0, "concurrency": 5, "dedup_enabled": True}
    rows = raw.withColumns({name: F.coalesce(name, F.lit(value)) for name, value in defaults.items()})
    rows = rows.select("*", F.posexplode_outer("tasks").alias("task_ord", "task")).drop("tasks")
    links = F.coalesce("task.extractors.link_selectors", F.array().cast("array<string>"))
    extractors = F.struct(*[
        (links if f.name == "link_selectors" else F.col(f"task.extractors.{f.name}"))
        .cast(f.dataType).alias(f.name) for f in EXTRACTORS.fields])
    settings = [c for c in rows.columns if c not in ("task", "task_ord", "crawler_id")]
    return rows.select(
        F.col("crawler_id").alias("crawl_id"), *settings, "task_ord",
        F.col("task.task_id").alias("task_id"), F.col("task.line_id").alias("line_id"),
        F.coalesce("task.line_name", F.lit("")).alias("line_name"), F.col("task.url").alias("url"),
        F.coalesce("task.params", F.create_map().cast("map<string,string>")).alias("params"),
        F.col("task.max_items").alias("max_items"), extractors.alias("extractors"))


def read_tables(spark: SparkSession, folder: str, register: bool = True) -> dict[str, DataFrame]:
    """The five stored tables, by name; also as views for SQL."""
    tables = {name: spark.read.schema(schema).parquet(f"{folder}/{name}")
              for name, schema in STORED.items()}
    if register:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
    return tables
