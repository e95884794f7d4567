"""From sources and lines to runs and tasks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvest.functions.text import merge_maps, or_else, record_id
from harvest.operators.validate import faults, kind_of, part, structure
from harvest.schemas import EXTRACTOR_FIELDS, EXTRACTORS, LINE

_MAP = T.MapType(T.StringType(), T.StringType())
BUILD_OPTIONS = "crawler_build_options"
EXTRACTOR_CONFIG = "extractor_config"

# Request defaults by source type.
_AGENT = ("Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) "
          "Chrome/131.0.0.0 Safari/537.36")
_PRESETS = [
    # type, headers, timeout, retry_max, retry_delay, concurrency, rate_limit, description
    ("website", {"User-Agent": _AGENT,
                 "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8",
                 "Accept-Language": "zh-CN,zh;q=0.9,en;q=0.8"},
     30.0, 3, 2.0, 3, 2.0, "pages and documents of public sites"),
    ("api", {"Accept": "application/json", "Content-Type": "application/json"},
     30.0, 3, 1.0, 10, None, "programming interfaces and feeds"),
    ("file", {}, 120.0, 2, 5.0, 3, None, "files in any kind of storage"),
    ("stream", {}, 0.0, 5, 3.0, 1, None, "queues and streams of messages"),
    ("external", {}, 60.0, 3, 2.0, 5, None, "databases and systems of others"),
]
_DOWNLOADERS = ["http", "playwright"]
_OPTION_TYPES = {
    "downloader": "string", "timeout": "double", "retry_max": "int", "retry_delay": "double",
    "concurrency": "int", "rate_limit": "double", "dedup_enabled": "boolean",
}


def presets(spark: SparkSession) -> DataFrame:
    """Five rows of request defaults, one per source type."""
    rows = [(kind, "http", headers, timeout, tries, delay, lanes, rate, True, text)
            for kind, headers, timeout, tries, delay, lanes, rate, text in _PRESETS]
    return spark.createDataFrame(rows, (
        "source_type string, downloader string, headers map<string,string>, timeout double, "
        "retry_max int, retry_delay double, concurrency int, rate_limit double, "
        "dedup_enabled boolean, description string"))


def with_preset(sources: DataFrame) -> DataFrame:
    """Each source with the defaults of its type in a struct ``preset``; null for an unknown type.

    The five preset rows are a constant, so they are sent to every task whatever the data size.
    """
    table = presets(sources.sparkSession)
    packed = table.select(
        F.col("source_type").alias("type"),
        F.struct(*[c for c in table.columns if c != "source_type"]).alias("preset"))
    return sources.join(F.broadcast(packed), "type", "left")


def with_default_lines(sources: DataFrame) -> DataFrame:
    """A source without lines gets one on its own address."""
    values = {
        "id": F.concat("id", F.lit("-default-line")), "source_id": F.col("id"),
        "name": F.lit("default"), "url": F.col("url"), "description": F.lit(""),
        "enabled": F.lit(True), "meta": F.lit("{}"),
    }
    line = F.struct(*[
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in LINE.fields])
    return sources.withColumn("lines", F.when(
        F.coalesce(F.size("lines"), F.lit(0)) <= 0, F.array(line)).otherwise(F.col("lines")))


def normalise_line_owner(sources: DataFrame) -> DataFrame:
    """Every line belongs to the source it sits in."""
    return sources.withColumn("lines", F.transform(
        "lines", lambda line: line.withField("source_id", F.col("id"))))


def _json_map(text: Column) -> Column:
    """Top-level fields of a JSON object as texts; anything else is an empty map."""
    return F.coalesce(F.from_json(text, _MAP), F.create_map().cast(_MAP))


def _extractor_config(meta: Column) -> Column:
    """The ``extractor_config`` of a line's meta as a variant; null unless it is an object with fields."""
    config = part(F.try_parse_json(meta), EXTRACTOR_CONFIG)
    return F.when((kind_of(config) == "object") & (F.size(F.try_variant_get(config, "$", "map<string,variant>")) > 0), config)


def line_error(line: Column) -> Column:
    """What is wrong with the extractor config of an enabled line; null if nothing is."""
    found = faults(_extractor_config(line["meta"]), EXTRACTOR_FIELDS)
    return F.when(F.coalesce(line["enabled"], F.lit(True)) & _extractor_config(line["meta"]).isNotNull() & (F.size(found) > 0), F.concat(
        F.lit("invalid selectors of line "), line["id"], F.lit(": "), F.array_join(found, "; ")))


def plan_tasks(sources: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """One task per enabled line, in line order; the source's own flag does not matter.

    ``lines`` (table form, with ``source_id`` and ``line_ord``) replaces the lines inside the
    sources. An ``extractor_config`` object in a line's meta becomes ``extractors``; the other
    meta fields become ``params``. ``crawl_id`` defaults to one run per source. A run with an enabled
    line whose config has a field of another type is not to be started: all its tasks carry the first
    such line's faults in ``config_error``.
    """
    run = [F.col(c) for c in ("crawl_id", "dedup_enabled") if c in sources.columns]
    given = F.col("config_error") if "config_error" in sources.columns else F.lit(None).cast("string")
    if "crawl_id" not in sources.columns:
        run.append(F.concat(F.lit("run-"), "id").alias("crawl_id"))
    if "dedup_enabled" not in sources.columns:
        run.append(F.lit(True).alias("dedup_enabled"))
    if lines is None:
        first = F.get(F.array_compact(F.transform("lines", line_error)), F.lit(0))
        rows = sources.select(
            *run, F.coalesce(given, first).alias("config_error"), F.col("id").alias("source_id"),
            F.posexplode("lines").alias("task_ord", "line"))
    else:
        packed = lines.select(
            "source_id", F.col("line_ord").alias("task_ord"), F.struct(*[
                (F.col(f.name) if f.name in lines.columns else F.lit(None)).cast(f.dataType)
                .alias(f.name) for f in LINE.fields]).alias("line"))
        wrong = packed.withColumn("_wrong", line_error(F.col("line"))).filter("_wrong IS NOT NULL").groupBy("source_id").agg(
            F.min(F.struct("task_ord", "_wrong"))["_wrong"].alias("_wrong"))
        rows = sources.select(*run, given.alias("config_error"), F.col("id").alias("source_id")).join(packed, "source_id")
        rows = rows.join(wrong, "source_id", "left").withColumn("config_error", F.coalesce("config_error", "_wrong")).drop("_wrong")
    meta = _json_map(F.col("line.meta"))
    extractors = structure(_extractor_config(F.col("line.meta")), EXTRACTOR_FIELDS, EXTRACTORS)
    extractors = extractors.withField("link_selectors", F.coalesce(
        extractors["link_selectors"], F.array().cast("array<string>")))
    return rows.filter(F.coalesce("line.enabled", F.lit(True))).select(
        "crawl_id", "source_id", F.col("task_ord").cast("int").alias("task_ord"),
        F.concat(F.lit("task-"), record_id(F.col("crawl_id"), F.col("task_ord"), F.col("line.id")))
        .alias("task_id"),
        F.col("line.id").alias("line_id"), F.coalesce("line.name", F.lit("")).alias("line_name"),
        F.col("line.url").alias("url"),
        F.map_filter(meta, lambda k, v: k != EXTRACTOR_CONFIG).alias("params"),
        F.col("line.item_limit").alias("max_items"), extractors.alias("extractors"),
        F.coalesce("dedup_enabled", F.lit(True)).alias("dedup_enabled"), "config_error")


def extract_mode(tasks: DataFrame) -> DataFrame:
    """How each task reads its address: ``none, links, data`` or ``page``."""
    x = F.col("extractors")
    chosen = [F.coalesce(x[f"{name}_selector"], F.lit("")) != "" for name in ("title", "time", "content")]
    return tasks.withColumn("mode", (
        F.when(F.coalesce("url", F.lit("")) == "", "none")
        .when(F.coalesce(F.size(x["link_selectors"]), F.lit(0)) > 0, "links")
        .when(chosen[0] | chosen[1] | chosen[2], "data").otherwise("page")))


def merge_headers(sources: DataFrame) -> DataFrame:
    """Request headers key by key: preset, then meta, then options, then overrides; last wins."""
    layer = _layers(sources)
    of = {name: _json_map(F.element_at(column, "headers")) for name, column in layer.items()}
    return with_preset(sources).withColumn("headers", merge_maps(
        F.col("preset.headers"), of["meta"], of["options"], of["overrides"]))


def _layers(sources: DataFrame) -> dict[str, Column]:
    def text(name):
        return F.col(name) if name in sources.columns else F.lit(None).cast("string")

    return {
        "meta": _json_map(F.get_json_object(text("meta"), f"$.{BUILD_OPTIONS}")),
        "options": _json_map(text("options")),
        "overrides": _json_map(text("overrides")),
    }


def with_run_options(
    sources: DataFrame, options: dict | None = None, overrides: dict | None = None,
) -> DataFrame:
    """Attach the same options and overrides (as JSON text) to every source."""
    return sources.withColumns({
        "options": F.lit(json.dumps(options or {}, ensure_ascii=False)),
        "overrides": F.lit(json.dumps(overrides or {}, ensure_ascii=False)),
    })


def resolve_run_config(sources: DataFrame) -> DataFrame:
    """Run settings of each source, field by field: overrides, options, meta, preset.

    A key present in ``overrides`` wins also when it is null; a null in ``options`` or in the
    source's meta means "not set". Unknown keys are ignored; ``meta`` comes from overrides alone.
    ``config_error`` names settings whose value does not fit; such a run is not to be started.
    """
    layer = _layers(sources)
    merged = merge_headers(sources)
    wrong = []

    def value(name, where):
        text = F.element_at(layer[where], name)
        made = _typed(text, _OPTION_TYPES[name])
        if name == "downloader":
            made = F.when(text.isin(_DOWNLOADERS), text)
        wrong.append(F.when(text.isNotNull() & made.isNull(), F.lit(f"{where}.{name}")))
        return made

    def pick(name):
        over, option, meta = (value(name, where) for where in ("overrides", "options", "meta"))
        return F.when(F.map_contains_key(layer["overrides"], name), over).otherwise(
            F.coalesce(option, meta, F.col(f"preset.{name}"))).alias(name)

    run = F.col("crawl_id") if "crawl_id" in sources.columns else F.concat(F.lit("run-"), "id")
    kept = [c for c in ("id", "name", "url", "lines") if c in sources.columns]
    settings = [pick(name) for name in _OPTION_TYPES]
    problems = F.array_join(F.array_compact(F.array(*wrong)), ", ")
    unknown = F.when(F.col("preset").isNull(), F.concat(F.lit("unknown source type: "), F.coalesce("type", F.lit("none"))))
    return merged.select(
        run.alias("crawl_id"), *kept, "type", "headers", *settings,
        _json_map(F.element_at(layer["overrides"], "meta")).alias("run_meta"),
        F.coalesce(unknown, F.when(problems != "", F.concat(F.lit("invalid setting: "), problems))).alias("config_error"))


def _typed(text: Column, kind: str) -> Column:
    """The value of a setting, null where the text does not give one."""
    if kind == "int":
        number = text.try_cast("double")
        return F.when(number == F.floor(number), number.try_cast("int"))
    return text.try_cast(kind)


def apply_detected(sources: DataFrame, detected: DataFrame) -> DataFrame:
    """Write detected selectors into the lines that have no extractor config of their own.

    ``detected``: one row per source, ``source_id`` and the detection columns. A source without
    any detection stays as it is; selectors not found are left out.
    """
    names = ["title_selector", "time_selector", "content_selector"]
    found = detected.select(
        F.col("source_id").alias("_source"),
        F.to_json(F.struct(
            F.when(F.size("link_selectors") > 0, F.col("link_selectors")).alias("link_selectors"),
            *names)).alias("_config"))
    existing = lambda line: F.coalesce(
        F.get_json_object(line["meta"], f"$.{EXTRACTOR_CONFIG}"), F.lit("{}"))

    def filled(line):
        rest = or_else(line["meta"], F.lit("{}"))
        body = F.regexp_replace(F.regexp_replace(rest, r"^\s*\{\s*", ""), r"\s*\}\s*$", "")
        own = F.concat(F.lit(f'{{"{EXTRACTOR_CONFIG}":'), F.col("_config"))
        return F.when(body == "", F.concat(own, F.lit("}"))).otherwise(
            F.concat(own, F.lit(","), body, F.lit("}")))

    lines = F.transform("lines", lambda line: F.when(
        existing(line).isin("{}", "null", ""), line.withField("meta", filled(line))).otherwise(line))
    joined = sources.join(found, F.col("id") == F.col("_source"), "left")
    usable = F.coalesce(F.col("_config"), F.lit("{}")) != "{}"
    return joined.withColumn("lines", F.when(usable, lines).otherwise(F.col("lines"))).drop(
        "_source", "_config")


def seeds_to_sources(seeds: DataFrame) -> DataFrame:
    """A table of addresses with settings to sources with one line each.

    ``seeds``: ``id, url`` and, where wanted, ``type, name, downloader, concurrency, timeout,
    rate_limit, max_items, link_selectors, title_selector, time_selector, content_selector``.
    Only settings that are given are written; empty selectors count as not given.
    """
    def given(name, kind="string"):
        return (F.col(name) if name in seeds.columns else F.lit(None)).cast(kind)

    name = or_else(given("name"), F.col("url"))
    options = F.to_json(F.struct(
        F.nullif(given("downloader"), F.lit("")).alias("downloader"),
        given("concurrency", "int").alias("concurrency"),
        given("timeout", "double").alias("timeout"),
        given("rate_limit", "double").alias("rate_limit")))
    links = given("link_selectors", "array<string>")
    config = F.to_json(F.struct(
        F.when(F.size(links) > 0, links).alias("link_selectors"),
        *[F.nullif(given(f"{n}_selector"), F.lit("")).alias(f"{n}_selector")
          for n in ("title", "time", "content")]))

    def meta(key, value):
        return F.when(value == "{}", "{}").otherwise(F.concat(F.lit(f'{{"{key}":'), value, F.lit("}")))

    values = {
        "id": F.concat("id", F.lit("-line")), "source_id": F.col("id"), "name": name,
        "url": F.col("url"), "description": F.lit(""), "enabled": F.lit(True),
        "item_limit": given("max_items", "int"), "meta": meta(EXTRACTOR_CONFIG, config),
    }
    line = F.struct(*[
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in LINE.fields])
    return seeds.select(
        "id", name.alias("name"), or_else(given("type"), F.lit("website")).alias("type"), "url",
        F.lit("").alias("description"), F.lit(True).alias("enabled"),
        meta(BUILD_OPTIONS, options).alias("meta"), F.array(line).alias("lines"))
