"""All matches of a pattern with their places, by built-in column functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,match:string,before:string,after:string>"
SPANS = f"array<{SPAN}>"
CONTEXT = 32        # characters kept from before a match, back to the match before it at most
_BLOCK = 256        # matches that are folded together: folds copy what they append to


def matches(text: Column, pattern: Column | str, size: Callable[[Column], Column] = F.length) -> Column:
    """Leftmost non-overlapping matches as ``SPANS``; places are sums of ``size`` of what is before.

    What lies between the matches comes from splitting by the same pattern, so both lists fit together.
    Places are added up inside blocks first, then over the blocks, so that many matches stay cheap.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    hits, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    every = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), F.slice(gaps, 2, F.size(gaps)).alias("next"))
    pairs = F.filter(every, lambda p: p["hit"].isNotNull())

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + size(pair["gap"])
        end = start + size(pair["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("match"),
                       F.substring(pair["gap"], -CONTEXT, CONTEXT).alias("before"), F.substring(pair["next"], 1, 1).alias("after"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    def block(number: Column, pairs: Column) -> Column:
        part = F.slice(pairs, number * _BLOCK + 1, F.lit(_BLOCK))
        return F.aggregate(part, F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out")), add)

    def blocks(pairs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _BLOCK).cast("int")), lambda b: block(b, pairs))

    def shift(state: Column, part: Column) -> Column:
        moved = F.transform(part["out"], lambda s: s.withField("start", s["start"] + state["at"]).withField("end", s["end"] + state["at"]))
        return F.struct((state["at"] + part["at"]).alias("at"), F.concat(state["out"], F.array(moved)).alias("out"))

    none = F.array().cast(SPANS)
    one_by_one = F.transform(F.array(pairs), lambda p: F.when(F.size(p) == 0, none).otherwise(F.aggregate(
        blocks(p), F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out")), shift, lambda s: F.flatten(s["out"]))))
    return F.get(one_by_one, F.lit(0))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def furthest(values: Column, least: bool = False) -> Column:
    """For each whole number of an array the largest (smallest) before it, null for the first.

    Blocks are looked at one by one behind the extremes of the blocks before them, so that nothing is
    copied along and 100,000 values stay cheap.
    """
    extreme, widest = (F.array_min, F.least) if least else (F.array_max, F.greatest)

    def inside(values: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")),
                            lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))
        return bound(parts, lambda p: bound(F.transform(p, extreme), lambda tops: F.flatten(F.transform(
            p, lambda part, b: bound(extreme(F.slice(tops, F.lit(1), b)), lambda carry: F.transform(
                part, lambda _, i: widest(carry, extreme(F.slice(part, F.lit(1), i)))))))))

    return bound(values, lambda v: F.when(F.size(v) > 0, inside(v)).otherwise(F.array().cast("array<int>")))


def uncontested(spans: Column, priorities: Iterable[int], contained: bool = False) -> Column:
    """The spans that no span of a stricter (smaller) ``priority`` overlaps, in their order.

    They hold ``start``, ``back`` (minus the end) and a ``priority`` among ``priorities`` and come sorted by start. With ``contained`` a span also goes if an earlier one of its own priority reaches its end.
    Takes time in proportion to the spans.
    """
    levels = sorted(priorities)

    def ends(k: int) -> Column:
        return bound(spans, lambda s: furthest(F.transform(s, lambda x: F.when(x["priority"] <= k, -x["back"]).otherwise(-1))))

    def starts(k: int) -> Column:
        return bound(spans, lambda s: F.reverse(furthest(F.reverse(F.transform(
            s, lambda x: F.when(x["priority"] <= k, x["start"]).otherwise(2**31 - 1))), least=True)))

    def fine(z: Column) -> Column:
        x, kept = z["span"], F.lit(True)
        for k in levels:
            stricter = (x["priority"] <= k) | ((F.coalesce(z[f"end{k}"], F.lit(-1)) <= x["start"])
                                               & (F.coalesce(z[f"start{k}"], F.lit(2**31 - 1)) >= -x["back"]))
            kept = kept & stricter
            if contained:
                kept = kept & ((x["priority"] != k) | (F.coalesce(z[f"end{k}"], F.lit(-1)) < -x["back"]))
        return kept

    every = F.arrays_zip(spans.alias("span"), *[ends(k).alias(f"end{k}") for k in levels],
                         *[starts(k).alias(f"start{k}") for k in levels])
    return F.transform(F.filter(every, fine), lambda z: z["span"])


def replaced(text: Column, spans: Column, word: Callable[[Column], Column]) -> Column:
    """``text`` with each span (``start``, ``end``; sorted) replaced by ``word`` of it; one that begins inside another by nothing.

    Pieces are cut from the part of the text that a block of spans lies in, so that many spans stay cheap.
    """
    def block(text: Column, part: Column) -> Column:
        first = F.get(part, F.lit(0))["at"]
        stretch = F.substring(text, first + 1, F.greatest(F.lit(0), F.array_max(F.transform(part, lambda z: z["span"]["start"])) - first))
        return bound(stretch, lambda t: F.array_join(F.transform(part, lambda z: F.when(z["span"]["start"] >= z["at"], F.concat(
            F.substring(t, z["at"] - first + 1, z["span"]["start"] - z["at"]), word(z["span"]))).otherwise(F.lit(""))), ""))

    def whole(text: Column, every: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / _BLOCK).cast("int")),
                             lambda b: bound(F.slice(every, b * _BLOCK + 1, F.lit(_BLOCK)), lambda part: block(text, part)))
        last = F.array_max(F.transform(every, lambda z: z["span"]["end"]))
        return F.concat(F.array_join(blocks, ""), F.substring(text, last + 1, F.length(text)))

    def placed(spans: Column) -> Column:
        at = furthest(F.transform(spans, lambda s: s["end"]))
        return F.transform(F.arrays_zip(spans.alias("span"), at.alias("at")),
                           lambda z: F.struct(z["span"].alias("span"), F.coalesce(z["at"], F.lit(0)).alias("at")))

    return bound(spans, lambda s: F.when(F.size(s) == 0, text).otherwise(bound(placed(s), lambda every: whole(text, every))))
