"""Schemas of the input documents and of the stored tables."""

from pyspark.sql import types as T

from harvest.operators.validate import Field

_S, _I, _B, _D, _TS = (
    T.StringType(), T.IntegerType(), T.BooleanType(), T.DoubleType(), T.TimestampType())


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Fixed values.
SOURCE_TYPES = ["website", "api", "file", "stream", "external"]
TASK_STATES = ["pending", "running", "success", "failed"]

LINE = _struct(
    id=_S, source_id=_S, name=_S, url=_S, description=_S, enabled=_B, item_limit=_I, meta=_S,
    created_at=_TS, updated_at=_TS)
SOURCE = _struct(
    id=_S, name=_S, type=_S, url=_S, description=_S, enabled=_B, meta=_S, lines=T.ArrayType(LINE),
    created_at=_TS, updated_at=_TS)
EXTRACTORS = _struct(
    link_selectors=T.ArrayType(_S), title_selector=_S, time_selector=_S, content_selector=_S,
    next_page_selector=_S, max_pages=_I)
TASK = _struct(
    task_id=_S, line_id=_S, line_name=_S, url=_S, params=T.MapType(_S, _S), max_items=_I,
    extractors=EXTRACTORS)
RUN_CONFIG = _struct(
    crawler_id=_S, source_id=_S, source_name=_S, downloader=_S, tasks=T.ArrayType(TASK),
    headers=T.MapType(_S, _S), timeout=_D, retry_max=_I, retry_delay=_D, concurrency=_I,
    rate_limit=_D, dedup_enabled=_B, meta=T.MapType(_S, _S))
PAGE = _struct(
    url=_S, status_code=_I, html=_S, content_type=_S, response_url=_S, error=_S)
STORED = {
    "sources": _struct(
        id=_S, name=_S, type=_S, url=_S, description=_S, enabled=_B, meta=_S, created_at=_TS,
        updated_at=_TS),
    "lines": _struct(
        id=_S, source_id=_S, name=_S, url=_S, description=_S, enabled=_B, meta=_S, created_at=_TS,
        updated_at=_TS),
    "crawler_tasks": _struct(
        id=_S, source_id=_S, status=_S, config=_S, total_items=T.LongType(),
        success_count=T.LongType(), failed_count=T.LongType(), error=_S, started_at=_TS,
        finished_at=_TS, created_at=_TS),
    "collected_data": _struct(
        id=_S, task_id=_S, source_id=_S, line_id=_S, url=_S, title=_S, content=_S, content_type=_S,
        raw=_S, meta=_S, collected_at=_TS),
    "crawler_logs": _struct(
        id=_S, task_id=_S, source_id=_S, level=_S, message=_S, created_at=_TS),
}

# What documents may hold; fields they do not name are passed over.
EXTRACTOR_FIELDS = (
    Field("link_selectors", "texts"), *[Field(f"{n}_selector", nullable=True) for n in ("title", "time", "content", "next_page")],
    Field("max_pages", "int", nullable=True))
LINE_FIELDS = (
    Field("id", required=True), Field("source_id", required=True), Field("name", required=True), Field("url", nullable=True),
    Field("description"), Field("enabled", "bool"), Field("item_limit", "int", nullable=True), Field("meta", "any_map"),
    Field("created_at", "time"), Field("updated_at", "time"))
SOURCE_FIELDS = (
    Field("id", required=True), Field("name", required=True), Field("type", required=True, allowed=tuple(SOURCE_TYPES)),
    Field("url", nullable=True), Field("description"), Field("enabled", "bool"), Field("meta", "any_map"),
    Field("lines", "objects", fields=LINE_FIELDS), Field("created_at", "time"), Field("updated_at", "time"))
TASK_FIELDS = (
    Field("task_id", required=True), Field("line_id", required=True), Field("line_name"), Field("url", nullable=True),
    Field("params", "any_map"), Field("max_items", "int", nullable=True), Field("extractors", "object", fields=EXTRACTOR_FIELDS))
RUN_FIELDS = (
    Field("crawler_id", required=True), Field("source_id", required=True), Field("source_name"),
    Field("downloader", allowed=("http", "playwright")), Field("tasks", "objects", fields=TASK_FIELDS),
    Field("headers", "text_map"), Field("timeout", "float"), Field("retry_max", "int"), Field("retry_delay", "float"),
    Field("concurrency", "int"), Field("rate_limit", "float", nullable=True), Field("dedup_enabled", "bool"), Field("meta", "any_map"))
