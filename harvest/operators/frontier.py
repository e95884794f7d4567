"""Fetching by join, link levels, pagination, first-wins de-duplication and limits.

Visit order is data: ``order_key`` is an array holding (page number, position) for each level,
so "first" and "at most n" mean the same in every run, however the rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvest.functions.page import match_page
from harvest.functions.text import url_key
from harvest.operators.extract import page_links, page_next
from harvest.operators.ordered import OrderedGroups, number_rows
from harvest.session import cut_lineage

TASK = ["crawl_id", "task_ord"]
LINK_KEY = ["url", "link_selector", "next_selector"]
_UNIONS_BEFORE_REWRITE = 16
# Parsing a page costs about as much as this many passes that only look at it.
PASSES_PER_PARSE = 16
# Pages a core parses in the time a round takes anyway.
PAGES_PER_ROUND_AND_CORE = 2_000
# Pairs of selectors asked of one parse; a site that uses more is parsed once for each such part.
SELECTORS_PER_PARSE = 64
# Pages that one row lists of a walk.
BLOCK = 256
# Pairs of selectors, of all sites together, that are sent to the pages instead of shuffling them.
PAIRS_SENT = 100_000
# Addresses that are sent to the pages instead of searching all texts once more.
ADDRESSES_SENT = 500_000


def http_error(status: Column, url: Column) -> Column:
    return F.format_string("HTTP %d: %s", status, url)


def response_error(url: Column) -> Column:
    """Why a response is no success: its own error text, or a status of 400 and more."""
    return F.coalesce(
        F.col("error"), F.when(F.col("status_code") >= 400, http_error(F.col("status_code"), url)))


def _misses(requests: DataFrame, missing: str) -> DataFrame:
    """Response columns for requests that no page answers."""
    if missing not in ("empty", "fail"):
        raise ValueError("missing must be 'empty' or 'fail'")
    fail = missing == "fail"
    return requests.withColumns({
        "status_code": F.lit(404 if fail else 200),
        "html": F.lit(""),
        "content_type": F.lit("text/html"),
        "response_url": F.col("url"),
        "error": http_error(F.lit(404), F.col("url")) if fail else F.lit(None).cast("string"),
    })


def _hits(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """An inner join, so that a small set of requests can be sent to the pages instead of
    shuffling the pages; which way it goes is decided by the measured size of the requests."""
    return pages.join(requests, "url").withColumn("error", response_error(F.col("url")))


def fetch(requests: DataFrame, pages: DataFrame, missing: str = "fail") -> DataFrame:
    """Answer each request from the table of fetched pages (one row per ``url``).

    Adds ``status_code, html, content_type, response_url, error``. A request without a page is a
    404 (``fail``) or an empty page with status 200 (``empty``).
    """
    return fetch_known(
        requests, requests.join(pages.select("url"), "url", "left_anti"), pages, missing)


def fetch_known(requests: DataFrame, absent: DataFrame, pages: DataFrame, missing: str) -> DataFrame:
    """As :func:`fetch`, where the requests without a page are known already."""
    columns = [*requests.columns, "status_code", "html", "content_type", "response_url", "error"]
    return _hits(requests, pages).select(columns).unionByName(
        _misses(absent, missing).select(columns))


def with_state(requests: DataFrame, pages: DataFrame, missing: str) -> DataFrame:
    """Tell for each request whether a page exists (``found``) and what fails it
    (``fetch_error``), without reading page texts. Only the distinct addresses meet the pages."""
    addresses = requests.select("url").distinct()
    states = pages.select("url", "status_code", "error").join(addresses, "url").select(
        "url", response_error(F.col("url")).alias("fetch_error"), F.lit(True).alias("found"))
    joined = requests.join(states, "url", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    if missing == "fail":
        joined = joined.withColumn("fetch_error", F.when(
            F.col("found"), F.col("fetch_error")).otherwise(http_error(F.lit(404), F.col("url"))))
    return joined


def expand_level(frontier: DataFrame, links: DataFrame) -> DataFrame:
    """One link level: each frontier address is replaced by its links, in order.

    ``frontier``: task columns, ``order_key``, ``page_no``, ``url``; ``links``: ``page_url, pos,
    target_url``. Repeats across pages stay; only de-duplication of records removes them.
    """
    return (
        frontier.join(links, F.col("url") == F.col("page_url"))
        .withColumn("order_key", F.concat("order_key", F.array(
            F.col("page_no").cast("int"), F.col("pos").cast("int"))))
        .withColumn("url", F.col("target_url"))
        .drop("page_no", "page_url", "pos", "target_url")
    )


def paginate(starts: DataFrame, next_links: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Pages visited from each start: ``start, page_no, url``.

    ``starts``: ``start``; ``next_links``: ``page_url, next_url``, at most one per page. A walk
    ends where no next link is, at a page it has visited, or after ``max_pages``.

    The visits of all starts may be many more than the links, so only links and heads of blocks go
    through shuffles: the length of every walk comes first, then each page lists the pages reached
    from it by 0, 1, ... steps of a block's size, for sizes falling to one. The visits are unfolded
    from those lists where they are read; nothing of their number is stored or shuffled.
    """
    begun = starts.select("start").distinct()
    if max_pages is not None and max_pages <= BLOCK:
        return _paginate_few(begun, next_links, max_pages)
    begun = cut_lineage(begun)
    links = cut_lineage(next_links.filter("next_url IS NOT NULL").select(
        F.col("page_url").alias("at"), F.col("next_url").alias("to")))
    sizes = begun.join(_walk_sizes(links).withColumnRenamed("at", "start"), "start", "left")
    size = F.coalesce("size", F.lit(1).cast("long"))
    sizes = cut_lineage(sizes.withColumn("size", size if max_pages is None else F.least(size, F.lit(max_pages))))
    longest = sizes.agg(F.max("size")).first()[0] or 0
    ends = links.select(F.col("to").alias("at")).distinct().join(links, "at", "left_anti")
    state = links.unionByName(ends.withColumn("to", F.lit(None).cast("string")))
    levels, unit = [], 1
    while unit < longest:
        state = state.select("at", F.array("at").alias("list"), "to")
        length = 1
        while length < BLOCK and unit * length < longest:
            onward = state.select(F.col("at").alias("to"), F.col("list").alias("more"), F.col("to").alias("then"))
            state = cut_lineage(state.join(onward, "to", "left").select(
                "at", F.concat("list", F.coalesce("more", F.array().cast("array<string>"))).alias("list"), F.col("then").alias("to")))
            length *= 2
        levels.append((unit, state))
        unit *= length
    walked = sizes.select("start", "size", F.lit(0).cast("long").alias("page_no"), F.col("start").alias("url"))
    for unit, state in reversed(levels):
        steps = F.posexplode(F.coalesce("list", F.array("url"))).alias("pos", "reached")
        walked = walked.join(state.select(F.col("at").alias("url"), "list"), "url", "left").select(
            "start", "size", "page_no", steps).select(
            "start", "size", (F.col("page_no") + F.col("pos") * unit).alias("page_no"), F.col("reached").alias("url")).filter("page_no < size")
    return walked.select("start", F.col("page_no").cast("int").alias("page_no"), "url")


def _jumped(links: DataFrame) -> DataFrame:
    """``at, to, steps, open`` of links ``at, to``: where each walk ends and after how many steps.

    Jumps double each round. A walk of as many steps as there are links is in a loop: it stays ``open``
    and ``to`` is a page of the loop; every page of the loop is the ``to`` of such a walk.
    """
    state = links.select("at", "to", F.lit(1).cast("long").alias("steps"), F.lit(True).alias("open"))
    reach, total = 1, links.count()
    while True:
        onward = state.select(F.col("at").alias("to"), F.col("to").alias("then"), F.col("steps").alias("more"))
        joined = state.join(onward, "to", "left")
        if reach >= total:
            return cut_lineage(joined.select("at", "to", "steps", F.col("then").isNotNull().alias("open")))
        state = cut_lineage(joined.select(
            "at", F.coalesce("then", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
            F.col("then").isNotNull().alias("open")))
        if state.filter("open").isEmpty():
            return state
        reach *= 2


def _walk_sizes(links: DataFrame) -> DataFrame:
    """``at, size``: number of different pages on the walk from each page with a link."""
    walks = _jumped(links)
    ended = walks.filter("NOT open").select("at", (F.col("steps") + 1).alias("size"))
    looping = walks.filter("open")
    if looping.isEmpty():
        return ended
    loops = cut_lineage(looping.select(F.col("to").alias("at")).distinct())
    ring = cut_lineage(links.join(loops, "at", "left_semi").withColumn("low", F.col("at")))
    reach, total = 1, ring.count()
    while reach < total:        # the smallest address of a loop names it
        onward = ring.select(F.col("at").alias("to"), F.col("to").alias("then"), F.col("low").alias("lower"))
        ring = cut_lineage(ring.join(onward, "to").select("at", F.col("then").alias("to"), F.least("low", "lower").alias("low")))
        reach *= 2
    ring = cut_lineage(ring.join(ring.groupBy("low").agg(F.count("*").alias("size")), "low").select("at", "size"))
    ways = links.join(looping.select("at"), "at", "left_semi").join(loops, "at", "left_anti")
    tails = _jumped(cut_lineage(ways)).select("at", "to", "steps").join(
        ring.withColumnRenamed("at", "to"), "to").select("at", (F.col("steps") + F.col("size")).alias("size"))
    return ended.unionByName(ring).unionByName(tails)


def _paginate_few(starts: DataFrame, next_links: DataFrame, max_pages: int) -> DataFrame:
    """The same for few pages a walk. Jumps double each round; a walk in a next-link table can only
    repeat its first pages in order, so keeping the smallest number per page removes loops."""
    walked = cut_lineage(
        starts.withColumns({"page_no": F.lit(0), "url": F.col("start")})
        .filter(F.lit(max_pages > 0)))
    jumps = next_links.select(F.col("page_url").alias("at"), F.col("next_url").alias("to"))
    reach, size = 1, walked.count()
    while size:
        further = (
            walked.join(jumps, F.col("url") == F.col("at"))
            .select("start", (F.col("page_no") + reach).alias("page_no"), F.col("to").alias("url")))
        further = further.filter(F.col("page_no") < max_pages)
        walked = cut_lineage(
            walked.unionByName(further).groupBy("start", "url").agg(F.min("page_no").alias("page_no"))
            .select("start", "page_no", "url"))
        grown = walked.count()
        if grown == size:
            break
        size, reach = grown, reach * 2
        onward = jumps.select(F.col("at").alias("to"), F.col("to").alias("then"))
        jumps = cut_lineage(jumps.join(onward, "to").select("at", F.col("then").alias("to")))
    return walked


def link_facts(keys: DataFrame, pages: DataFrame) -> DataFrame:
    """Facts of the asked (page, selectors); keys without a page give no row."""
    pair = F.struct("link_selector", "next_selector")
    return facts_of(pages.join(keys, "url").withColumn("pairs", F.array(pair)))


def has_reference(html: Column) -> Column:
    """Whether a page may hold an ``href`` at all; attribute names are written out in every page."""
    return F.coalesce(F.lower(html).contains("href"), F.lit(False))


def facts_of(pages: DataFrame) -> DataFrame:
    """What listing pages hold: ``url, link_selector, next_selector, links, next_url, error``.

    ``pairs`` lists the selectors asked of each page; all are answered from one parse, whatever
    number of tasks asks. A page without any reference has no links and is not parsed, its selectors
    are checked only. The page text ends here: later steps join these narrow rows.
    """
    wanted = F.flatten(F.transform("pairs", lambda p: F.array(p["link_selector"], p["next_selector"])))
    answers = F.transform("pairs", lambda p, i: F.struct(
        p["link_selector"].alias("link_selector"), p["next_selector"].alias("next_selector"),
        F.get("m", 2 * i).alias("links"), F.get("m", 2 * i + 1).alias("onward")))
    found = (
        pages.withColumn("error", response_error(F.col("url")))
        .withColumn("m", match_page(F.when(has_reference(F.col("html")), F.col("html")), wanted))
        .select("url", "error", F.explode(answers).alias("a")))
    told = found.select(
        "url", "a.link_selector", "a.next_selector",
        page_links(F.col("url"), F.col("a.links.hrefs")).alias("links"),
        page_next(F.col("url"), F.col("a.onward")).alias("next_url"),
        F.coalesce("error", "a.links.error", "a.onward.error").alias("error"))
    unusable = F.exists("links", lambda link: link.isNull())
    return told.withColumn("error", F.coalesce(
        "error", F.when(unusable, F.lit("unusable link address"))))


class _Pieces:
    """Rows collected over rounds, rewritten as one table before the union grows long."""

    def __init__(self):
        self.parts: list[DataFrame] = []

    def add(self, part: DataFrame) -> DataFrame:
        self.parts.append(part)
        if len(self.parts) > _UNIONS_BEFORE_REWRITE:
            self.parts = [cut_lineage(self.all())]
        return self.all()

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)


def site_of(url: Column) -> Column:
    """Scheme, host and port of an address; empty for anything else."""
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+", 0)


def linked_addresses(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """``url, _site`` of the pages on ``sites`` (``_site``) that hold a reference."""
    linked = pages.filter(has_reference(F.col("html"))).select("url", site_of(F.col("url")).alias("_site"))
    return linked.join(sites, "_site", "left_semi")


def site_facts(asked: DataFrame, known: DataFrame | None, pages: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """Facts of the pages on sites that hold a reference: ``asked`` holds ``_site`` and pairs of selectors.

    The sites are sent to the pages, which are searched where they lie; those with a reference are then
    dealt evenly by ``url``, as listings often lie together and their parse would fall to few tasks.
    ``linked`` (a stored table of :func:`linked_addresses` of these sites), if it is small, is sent instead
    of searching the texts. Where the sites are too many to be sent, addresses meet them without their texts.
    """
    pair = F.struct("link_selector", "next_selector")
    parts = F.greatest(F.ceil(F.count("*") / SELECTORS_PER_PARSE), F.lit(1)).alias("_parts")
    numbered = asked.join(asked.groupBy("_site").agg(parts), "_site")
    grouped = cut_lineage(
        numbered.groupBy("_site", F.pmod(F.xxhash64(pair), F.col("_parts")).alias("_part"))
        .agg(F.collect_list(pair).alias("pairs")).drop("_part"))
    searched = pages.filter(has_reference(F.col("html")))
    # a number of its own: by their few bytes Spark would put the pages together for fewer tasks than cores
    spark = pages.sparkSession
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    if asked.count() <= PAIRS_SENT:
        if linked is not None and linked.count() <= ADDRESSES_SENT:
            here = linked.join(grouped, "_site", "left_semi").select("url")
            dealt = pages.join(F.broadcast(here), "url", "left_semi").withColumn("_site", site_of(F.col("url"))).repartition(slots, "url")
        else:
            dealt = searched.withColumn("_site", site_of(F.col("url"))).join(
                F.broadcast(grouped.select("_site").distinct()), "_site", "left_semi").repartition(slots, "url")
        wanted = dealt.join(F.broadcast(grouped), "_site").drop("_site")
    else:
        addresses = pages.select("url", site_of(F.col("url")).alias("_site")).join(grouped, "_site").drop("_site")
        wanted = searched.join(addresses, "url")
    facts = facts_of(wanted)
    return facts if known is None else facts.join(known, LINK_KEY, "left_anti")


def walk_known(front: DataFrame, known: DataFrame) -> DataFrame:
    """All pages the walks reach over known facts, the standing pages included.

    The same doubling as in :func:`paginate`, with a limit per walk.
    """
    start = [*TASK, "order_key"]
    pair = ["link_selector", "next_selector"]
    jumps = known.filter("error IS NULL AND next_url IS NOT NULL").select(
        *pair, F.col("url").alias("at"), F.col("next_url").alias("to"))
    walked, size, reach = front, front.count(), 1
    while True:
        step = [walked[c] == jumps[c] for c in pair] + [walked["url"] == jumps["at"]]
        further = walked.join(jumps, step).select(
            *[walked[c] for c in (*start, *pair, "max_pages")],
            (F.col("page_no") + reach).alias("page_no"), F.col("to").alias("url"),
        ).filter("max_pages IS NULL OR page_no < max_pages")
        walked = cut_lineage(
            walked.unionByName(further).groupBy(*start, "url").agg(
                F.min("page_no").alias("page_no"), *[F.first(c).alias(c) for c in (*pair, "max_pages")]))
        grown = walked.count()
        if grown == size:
            return walked
        size, reach = grown, reach * 2
        onward = jumps.select(*pair, F.col("at").alias("to"), F.col("to").alias("then"))
        jumps = cut_lineage(jumps.join(onward, [*pair, "to"]).select(*pair, "at", F.col("then").alias("to")))


def walk_listings(
    starts: DataFrame, pages: DataFrame, missing: str, page_rounds: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Follow next-page links from every start.

    ``starts``: task columns, ``order_key, url, link_selector, next_selector, max_pages``.
    Returns the visits (start columns, ``page_no, url, error``) and the facts of the pages.

    Each round answers the pages the walks stand on, which costs a pass over the stored pages.
    Most walks end within a few rounds. For those that do not, one pass reads the facts of their
    whole sites, and the walks run over those by doubling jumps. That happens after
    ``page_rounds``; by default once the rounds have cost as much as that pass will, so that the
    whole costs at most about twice the better way. Walks that leave their site stop at the
    first unknown page; every site newly reached is then read whole as well, once.
    """
    start = [*TASK, "order_key"]
    shape = [*start, "url", "link_selector", "next_selector", "max_pages", "page_no"]
    front = cut_lineage(
        starts.withColumn("page_no", F.lit(0))
        .withColumn("next_selector", F.coalesce("next_selector", F.lit("")))
        .filter("max_pages IS NULL OR max_pages > 0").select(shape))
    facts, visits, sites, rounds = _Pieces(), _Pieces(), _Pieces(), 0
    jumping = page_rounds == 0
    round_cost = site_cost = weighed = linked = None
    while True:
        ahead = jumping
        if ahead:
            asked = front.select(
                site_of(F.col("url")).alias("_site"), "link_selector", "next_selector").distinct().filter("_site <> ''")
            if sites.parts:
                asked = asked.join(sites.all(), ["_site", "link_selector", "next_selector"], "left_anti")
            asked = cut_lineage(asked)
            if not asked.isEmpty():
                told = weighed is not None and asked.join(weighed, "_site", "left_anti").isEmpty()
                facts.add(cut_lineage(site_facts(asked, facts.all() if facts.parts else None, pages, linked if told else None)))
                sites.add(asked)
        keys = front.select(*LINK_KEY).distinct()
        if facts.parts:
            keys = keys.join(facts.all(), LINK_KEY, "left_anti")
        if ahead:       # reading the sites has mostly answered the standing pages too: no pass for none
            keys = cut_lineage(keys)
        known = facts.all() if ahead and facts.parts and keys.isEmpty() else facts.add(cut_lineage(link_facts(keys, pages)))
        walked = front
        if ahead:
            walked = walk_known(front, known)
        told = known.drop("links").withColumn("found", F.lit(True))
        here = walked.join(told, LINK_KEY, "left")
        if missing == "fail":
            here = here.withColumn("error", F.when(
                F.col("found").isNull(), http_error(F.lit(404), F.col("url")))
                .otherwise(F.col("error")))
        if ahead:
            # behind the standing pages, a page without facts is unknown, not absent
            standing = front.select(*start, "url", F.lit(True).alias("asked"))
            if visits.parts:
                here = here.join(visits.all().select(*start, "url"), [*start, "url"], "left_anti")
            here = cut_lineage(here.join(standing, [*start, "url"], "left"))
            settled = here.filter("found OR asked").drop("found", "asked")
            front = cut_lineage(here.filter("found IS NULL AND asked IS NULL").select(shape))
            visits.add(settled)
        else:
            here = cut_lineage(here.drop("found"))
            seen = visits.add(here)
            onward = (
                here.filter("error IS NULL AND next_url IS NOT NULL "
                            "AND (max_pages IS NULL OR page_no + 1 < max_pages)")
                .withColumn("url", F.col("next_url")).withColumn("page_no", F.col("page_no") + 1))
            front = cut_lineage(onward.select(shape).join(
                seen.select(*start, "url"), [*start, "url"], "left_anti"))
        if front.isEmpty():
            return visits.all(), facts.all()
        rounds += 1
        if page_rounds is not None:
            jumping = rounds >= page_rounds
        elif not jumping:
            if round_cost is None:
                weighed = cut_lineage(front.select(site_of(F.col("url")).alias("_site")).distinct())
                linked = cut_lineage(linked_addresses(weighed, pages))
                round_cost, site_cost = _costs(linked, pages)
            jumping = rounds * round_cost >= site_cost


def _costs(linked: DataFrame, pages: DataFrame) -> tuple[float, float]:
    """Cost of one more round and of reading the walks' whole sites, both in parsed pages.

    Either is a pass over all pages; of the sites, the pages that hold a reference (``linked``) are parsed.
    """
    cores = linked.sparkSession.sparkContext.defaultParallelism
    one_pass = pages.count() / PASSES_PER_PARSE
    return (one_pass + PAGES_PER_ROUND_AND_CORE * cores, one_pass + linked.count())


def dedup_urls(requests: DataFrame, key: Callable[[Column], Column] = url_key) -> DataFrame:
    """First request of each address per run, by ``task_ord`` and ``order_key``.

    A minimum per (run, address) folds before the shuffle, so an address that a third of all
    links point to costs one row per partition. Runs with ``dedup_enabled = false`` keep all.
    """
    flag = "dedup_enabled" if "dedup_enabled" in requests.columns else None
    taken = {"crawl_id", "task_ord", "order_key"}
    rest = [c for c in requests.columns if c not in taken]
    first = (
        (requests.filter(flag) if flag else requests)
        .groupBy("crawl_id", key(F.col("url")).alias("_key"))
        .agg(F.min(F.struct("task_ord", "order_key", *rest)).alias("first"))
        .select("crawl_id", "first.*"))
    if not flag:
        return first.select(requests.columns)
    return first.select(requests.columns).unionByName(requests.filter(~F.col(flag)))


def limit_items(
    items: DataFrame, weight: str | None = None, rows_in_one_task: int | None = None,
) -> DataFrame:
    """Requests a task makes before ``max_items`` records are reached, in visit order.

    Every request counts one record, or ``weight`` records: a request is made while the records
    of those before it are fewer than the limit. A null limit keeps all; a negative one is refused.
    """
    if not items.filter("max_items < 0").isEmpty():
        raise ValueError("max_items must not be negative")
    free = items.filter("max_items IS NULL")
    bound = items.filter("max_items IS NOT NULL")
    size = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    counted = OrderedGroups(bound, TASK, ["order_key"], rows_in_one_task).running(
        "_until", size).frame()
    return free.unionByName(counted.filter(F.col("_until") - size < F.col("max_items")).drop("_until"))


def drop_seen(requests: DataFrame, seen: DataFrame,
              key: Callable[[Column], Column] = url_key) -> DataFrame:
    """Requests whose address is not in ``seen`` (column ``url_key``)."""
    return (
        requests.withColumn("_key", key(F.col("url")))
        .join(seen.select(F.col("url_key").alias("_key")), "_key", "left_anti").drop("_key"))


def union_frontiers(*frontiers: DataFrame) -> DataFrame:
    """All link lists together, nothing removed; ``order_key`` keeps the order."""
    return reduce(DataFrame.unionByName, frontiers)


def collect_items(*items: DataFrame) -> DataFrame:
    """All records together, nothing removed."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), items)


def claim_requests(requests: DataFrame) -> DataFrame:
    """Which task fetches which address, as if tasks ran one after the other by ``task_ord``.

    ``requests`` (a stored table): task columns, ``order_key, key, fetch_limit, weight,
    dedup_enabled``, each key once per task where de-duplication is on; ``ends`` marks requests
    behind which a task makes no other, ``holds`` those that keep their key from higher tasks.

    In rounds: every task proposes its first requests within its limit; a key belongs to the
    lowest task proposing it; every request of a higher task for such a key is rejected, whether
    proposed or not. The first task is never rejected, and no task gives a key back, so this
    ends with the serial result. Without limits the first round is already final.
    """
    cut_short = requests.filter("ends").select(*TASK).distinct().withColumn("_cut", F.lit(True))
    requests = requests.join(cut_short, TASK, "left").withColumn(
        "bounded", F.col("fetch_limit").isNotNull() | F.col("_cut").isNotNull()).drop("_cut")
    live = cut_lineage(requests)
    counts = live.agg(F.count_if(F.col("bounded")).alias("b"), F.count_if(F.col("bounded") & F.col("dedup_enabled")).alias("c")).first()
    bounded, contested = counts["b"] > 0, counts["c"] > 0

    def proposals(live: DataFrame) -> DataFrame:
        if not bounded:
            return live
        counted = OrderedGroups(live.filter("bounded"), TASK, ["order_key"], written=True)
        counted = counted.running("_until", F.col("weight").cast("long")).running(
            "_ends", F.col("ends").cast("long")).frame()
        within = (
            (F.col("fetch_limit").isNull() | (F.col("_until") - F.col("weight") < F.col("fetch_limit")))
            & (F.col("_ends") - F.col("ends").cast("long") == 0))
        return cut_lineage(live.filter("NOT bounded").unionByName(counted.filter(within).drop("_until", "_ends")))

    def not_rejected(rows: DataFrame, holders: DataFrame) -> DataFrame:
        return (
            rows.join(holders, ["crawl_id", "key"], "left")
            .filter("holder IS NULL OR NOT dedup_enabled OR task_ord <= holder").drop("holder"))

    settled = _Pieces()
    while True:
        proposed = proposals(live)
        holders = (
            proposed.filter("dedup_enabled AND holds").groupBy("crawl_id", "key")
            .agg(F.min("task_ord").alias("holder")))
        if not contested:
            return not_rejected(proposed, holders).drop("bounded")
        left = cut_lineage(not_rejected(live, holders))
        # runs without a rejection are final: they leave the rounds
        lost = live.groupBy("crawl_id").count().join(
            left.groupBy("crawl_id").agg(F.count("*").alias("left")), "crawl_id", "left").filter(
            "coalesce(left, 0) < count").select("crawl_id")
        lost = cut_lineage(lost)
        settled.add(cut_lineage(proposed.join(lost, "crawl_id", "left_anti")))
        if lost.isEmpty():
            return settled.all().drop("bounded")
        live = cut_lineage(left.join(lost, "crawl_id", "left_semi"))


__all__ = [
    "claim_requests", "collect_items", "dedup_urls", "drop_seen", "expand_level", "fetch",
    "limit_items", "link_facts", "number_rows", "paginate", "union_frontiers", "walk_listings",
]
