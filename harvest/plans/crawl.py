"""The whole collection run as one chain of DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvest.functions.page import match_page
from harvest.functions.text import url_key
from harvest.operators.extract import custom_items, selected_items, with_item_id
from harvest.operators.frontier import (
    TASK, claim_requests, fetch_known, union_frontiers, walk_listings, with_state)
from harvest.operators.ordered import OrderedGroups
from harvest.operators.outcome import run_summary, task_outcome
from harvest.plans.results import CrawlResult
from harvest.session import cut_lineage


_AFTER_LISTINGS = 1_000_000     # stage number behind all link levels
# First requests that Spark keeps per task before it shuffles (its windowGroupLimitThreshold).
_REACH = 1_000


def _prepared(tasks: DataFrame) -> DataFrame:
    """Task rows with flat extractor columns and what can be told before any fetch."""
    if "config_error" not in tasks.columns:
        tasks = tasks.withColumn("config_error", F.lit(None).cast("string"))
    x = F.col("extractors")
    data_selectors = F.array(x["title_selector"], x["time_selector"], x["content_selector"])
    problems = F.transform(match_page(F.lit(""), data_selectors), lambda m: m["error"])
    return tasks.select(
        "crawl_id", "task_ord", "task_id", "source_id", "line_id", "line_name", "url", "max_items",
        "dedup_enabled",
        F.coalesce(x["link_selectors"], F.array().cast("array<string>")).alias("link_selectors"),
        x["title_selector"].alias("title_selector"), x["time_selector"].alias("time_selector"),
        x["content_selector"].alias("content_selector"),
        x["next_page_selector"].alias("next_selector"), x["max_pages"].alias("max_pages"),
        F.get(F.filter(problems, lambda e: e.isNotNull()), F.lit(0)).alias("selector_error"),
        F.coalesce("config_error", F.when(
            F.col("max_items") < 0, F.lit("max_items must not be negative"))).alias("config_error"),
        (F.coalesce("url", F.lit("")) != "").alias("has_url"),
    ).withColumn("levels", F.size("link_selectors"))


def _first_of_each(rows: DataFrame, key: str) -> DataFrame:
    """Where repeats are dropped, each ``key`` of a task once, at its first place.

    Done at every level: a page met again has the same links as before, all of them behind their
    first places. Otherwise repeats would multiply from level to level.
    """
    rest = [c for c in rows.columns if c not in (*TASK, key, "order_key")]
    once = rows.filter("dedup_enabled").groupBy(*TASK, key).agg(
        F.min(F.struct("order_key", *rest)).alias("first")).select(*TASK, key, "first.*")
    return once.unionByName(rows.filter("NOT dedup_enabled"))


def _candidates(
    tasks: DataFrame, pages: DataFrame, missing: str, page_rounds: int | None,
) -> tuple[DataFrame, DataFrame]:
    """Addresses each task would fetch for records, and the failures of listing pages."""
    usable = tasks.filter("has_url AND config_error IS NULL")
    depth = tasks.agg(F.max("levels")).first()[0] or 0
    no_order = F.array().cast("array<int>").alias("order_key")
    front = usable.filter("levels > 0").select(*TASK, no_order, "url")
    ready = [usable.filter("levels = 0").select(*TASK, no_order, "url")]
    failures = []
    for level in range(depth):
        needs = tasks.select(
            *TASK, F.get("link_selectors", F.lit(level)).alias("link_selector"),
            "next_selector", "max_pages")
        visits, facts = walk_listings(front.join(needs, TASK), pages, missing, page_rounds)
        failed = visits.filter("error IS NOT NULL").select(
            *TASK, F.lit(level).alias("stage"),
            F.concat("order_key", F.array("page_no")).alias("at"), "error")
        failures.append(failed)
        links = facts.filter("error IS NULL").select(
            F.col("url").alias("page_url"), "link_selector", "next_selector",
            F.posexplode("links").alias("pos", "target_url"))
        reached = visits.filter("error IS NULL").withColumn(
            "page_url", F.col("url")).join(links, ["page_url", "link_selector", "next_selector"])
        reached = reached.select(
            *TASK, F.concat("order_key", F.array("page_no", F.col("pos").cast("int"))).alias("order_key"),
            F.col("target_url").alias("url")).join(tasks.select(*TASK, "levels", "dedup_enabled"), TASK)
        reached = cut_lineage(_first_of_each(reached, "url").drop("dedup_enabled").join(failed.select(*TASK), TASK, "left_anti"))
        ready.append(reached.filter(F.col("levels") == level + 1).drop("levels"))
        front = reached.filter(F.col("levels") > level + 1).drop("levels")
    ready = union_frontiers(*ready)
    if not failures:
        none = tasks.limit(0).select(
            *TASK, F.lit(0).alias("stage"), F.array().cast("array<int>").alias("at"),
            F.lit("").alias("error"))
        return ready, none
    failures = cut_lineage(union_frontiers(*failures))
    return ready.join(failures.select(*TASK), TASK, "left_anti"), failures


def _within_reach(wanted: DataFrame, tasks: DataFrame) -> DataFrame:
    """Requests the tasks may come to make, where each is one record; all of a task without such a bound.

    A task holds at most as many keys as its limit allows records. So those below a task take at most the
    sum of their limits from it, and it ends within its own limit behind them: the requests at places
    beyond that sum are met by no task, whichever of the others fail.
    """
    most = F.when(F.col("levels") == 0, F.lit(1)).otherwise(F.col("max_items")).cast("long")
    limits = OrderedGroups(tasks.select(*TASK, most.alias("_most")), ["crawl_id"], ["task_ord"], written=True)
    limits = limits.running("_reach", F.coalesce("_most", F.lit(0).cast("long"))).running(
        "_free", F.col("_most").isNull().cast("long")).frame()
    reach = cut_lineage(limits.filter(f"_free = 0 AND _reach BETWEEN 0 AND {_REACH}").select(*TASK, "_reach"))
    if reach.isEmpty():
        return wanted
    place = F.row_number().over(Window.partitionBy(*TASK).orderBy("order_key"))
    near = wanted.join(F.broadcast(reach), TASK).withColumn("_place", place).filter(
        f"_place <= {_REACH} AND _place <= _reach")
    # stored, so that their number is known where they meet the pages
    return cut_lineage(near.select(wanted.columns).unionByName(
        wanted.join(F.broadcast(reach), TASK, "left_anti").select(wanted.columns)))


def _fetched(requests: DataFrame, tasks: DataFrame, pages: DataFrame, missing: str) -> DataFrame:
    """Pages of the chosen requests, with what extraction needs from their tasks.

    The requests are stored first: by its estimate alone a join is large, and all page texts would be
    shuffled to meet a few requests.
    """
    asked = cut_lineage(requests.select(*TASK, "order_key", "url", "found").join(tasks.select(
        *TASK, "task_id", "source_id", "line_id", "line_name",
        "title_selector", "time_selector", "content_selector"), TASK))
    return fetch_known(
        asked.filter("found").drop("found"), asked.filter("NOT found").drop("found"), pages, missing)


def _claimed(wanted: DataFrame, scale: int = 1) -> DataFrame:
    """Requests the tasks make out of those ``wanted``, a stored table; ``weight`` counts ``scale`` for a record.

    A direct request is made whatever its limit. An address that fails, or whose extraction fails, ends
    its task unless a lower task holds its key; one that can't be fetched holds no key itself.
    """
    limit = F.when(F.col("levels") > 0, F.col("max_items").cast("long") * scale)
    requests = wanted.withColumns({
        "fetch_limit": limit, "weight": F.when(F.col("fetch_error").isNull(), F.col("weight")).otherwise(0),
        "ends": F.col("fetch_error").isNotNull() | F.col("spoilt").isNotNull(), "holds": F.col("fetch_error").isNull()})
    return cut_lineage(claim_requests(requests))


def _claimed_by_demand(
    wanted: DataFrame, tasks: DataFrame, pages: DataFrame, missing: str, extractor: Callable,
) -> tuple[DataFrame, DataFrame]:
    """The requests the tasks make and the records of a custom extractor, which only chosen pages meet.

    How many records an address gives is known once the extractor has run. Tasks choose their requests
    with what is known; an address not asked yet counts as one record in the first round, and as half of
    what it did before in each later one, so that tasks whose pages give little ask for twice as many.
    What they choose is extracted, until they choose known addresses only. Behind a task's last choice
    no address matters, and before it all are known, so the choice is the one that full knowledge gives.
    """
    at = [*TASK, "order_key"]
    known, records, scale = None, [], 1
    while True:
        if known is None:
            guess = wanted.withColumns({"told": F.lit(False), "spoilt": F.lit(None).cast("string"), "weight": F.lit(1).cast("long")})
        else:
            guess = wanted.drop("weight", "spoilt").join(known, at, "left").withColumns({
                "told": F.col("records").isNotNull(), "weight": F.coalesce(F.col("records") * scale, F.lit(1).cast("long"))}).drop("records")
        claims = _claimed(cut_lineage(guess), scale)
        asked = cut_lineage(claims.filter("fetch_error IS NULL AND NOT told").select(*at, "url", "found"))
        if records and asked.isEmpty():
            return claims.drop("told"), union_frontiers(*records)
        made = _fetched(asked, tasks, pages, missing).withColumn("request_url", F.col("url"))
        every = cut_lineage(custom_items(made, extractor, keep_errors=True))
        counts = every.groupBy(*at).agg(F.count("*").alias("records"), F.max("extract_error").alias("spoilt"))
        new = cut_lineage(asked.select(at).join(counts, at, "left").fillna(0, ["records"]))
        known = new if known is None else known.unionByName(new)
        records.append(every.filter("extract_error IS NULL").drop("extract_error"))
        scale = min(2 * scale, 1 << 20)


def crawl(
    tasks: DataFrame, pages: DataFrame, missing: str = "fail",
    extractor: Callable | None = None, dedup_key: Callable[[Column], Column] = url_key,
    page_rounds: int | None = None,
) -> CrawlResult:
    """Run all tasks of all runs at once against a table of fetched pages (one row per ``url``).

    ``tasks`` as :func:`harvest.operators.config.plan_tasks` gives them. ``extractor`` replaces
    the selector rules (see :func:`custom_items`), ``dedup_key`` the identity of an address.
    ``page_rounds``: see :func:`harvest.operators.frontier.walk_listings`.
    """
    tasks = cut_lineage(_prepared(tasks))
    ready, listing_failures = _candidates(tasks, pages, missing, page_rounds)

    wanted = ready.join(tasks.select(
        *TASK, "dedup_enabled", "levels", "max_items", F.col("selector_error").alias("spoilt")),
        TASK).withColumn("key", dedup_key(F.col("url")))
    if dedup_key is not url_key:        # addresses are unique within a task already
        wanted = _first_of_each(wanted, "key")
    if extractor is None:
        wanted = _within_reach(wanted, tasks)
    # success or failure of every address, without reading page texts
    wanted = cut_lineage(with_state(wanted, pages, missing).withColumn("weight", F.lit(1).cast("long")))

    if extractor is None:
        claims = _claimed(wanted)
    else:
        claims, records = _claimed_by_demand(wanted, tasks, pages, missing, extractor)

    failures = claims.filter("ends").select(
        *TASK, F.lit(_AFTER_LISTINGS).alias("stage"), F.col("order_key").alias("at"),
        F.coalesce("fetch_error", "spoilt").alias("error"))
    refused = tasks.filter("config_error IS NOT NULL").select(
        *TASK, F.lit(-1).alias("stage"), F.array().cast("array<int>").alias("at"),
        F.col("config_error").alias("error"))
    failures = cut_lineage(union_frontiers(listing_failures, failures, refused))

    good = claims.join(failures.select(*TASK), TASK, "left_anti")
    if extractor is None:
        good = cut_lineage(good.filter("levels > 0 OR max_items IS NULL OR max_items > 0"))
        made = good.groupBy(*TASK).agg(F.count("*").alias("item_count"))
        items = selected_items(_fetched(good, tasks, pages, missing))
        items = with_item_id(items, "crawl_id", "task_id", "order_key")
    else:
        records = records.join(good.select(*TASK, "order_key"), [*TASK, "order_key"], "left_semi")
        records = records.withColumn("order_key", F.concat("order_key", F.array("record_no")))
        placed = OrderedGroups(records, TASK, ["order_key"]).running(
            "_place", F.lit(1).cast("long")).frame()
        limits = tasks.select(*TASK, "max_items")
        items = cut_lineage(placed.join(limits, TASK).filter(
            "max_items IS NULL OR _place <= max_items"))
        made = items.groupBy(*TASK).agg(F.count("*").alias("item_count"))
        items = with_item_id(items, "crawl_id", "task_id", "order_key").select(
            "line_id", "source_id", "url", "title", "content", "content_type", "status_code",
            "published_at_raw", "crawl_id", "task_id", "task_ord", "order_key", "item_id")

    outcome = task_outcome(tasks.select(
        "crawl_id", "source_id", "task_ord", "task_id", "line_id"), failures, made)
    return CrawlResult(items, outcome, run_summary(outcome))
