"""Small column functions on texts, addresses and maps."""

from __future__ import annotations

from functools import reduce
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
# References that resolve by plain concatenation or not at all; everything else is joined by rule.
_PLAIN_ABSOLUTE = r"^https?://[A-Za-z0-9.-]+(:[0-9]+)?(/[^\s;?#\p{Cntrl}]*)?(\?[^\s;#\p{Cntrl}]+)?(#[^\s\p{Cntrl}]+)?$"
_PLAIN_ROOTED = r"^/([^/\s;?#\p{Cntrl}][^\s;?#\p{Cntrl}]*)?(\?[^\s;#\p{Cntrl}]+)?(#[^\s\p{Cntrl}]+)?$"
_SITE = r"^(https?://[A-Za-z0-9.-]+(:[0-9]+)?)([/?#]|$)"


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends (``trim`` knows the blank only)."""
    return F.regexp_replace(text, _EDGE_SPACE, "")


def or_else(text: Column, fallback: Column) -> Column:
    """``text`` unless it is null or empty."""
    return F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(fallback)


def clean_href(href: Column) -> Column:
    """Stripped reference, or null for blank, ``#…`` and ``javascript:…`` ones."""
    bare = strip(href)
    return F.when(
        (bare != "") & ~bare.startswith("#") & ~bare.startswith("javascript:"), bare)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _join_by_rule(base: pa.Array, refs: pa.Array) -> pa.Array:
    def one(start, ref):
        try:
            return urljoin(start, ref)
        except ValueError:
            return None

    return pa.array(
        [None if r.as_py() is None else [one(b.as_py() or "", ref) for ref in r.as_py()]
         for b, r in zip(base, refs)],
        pa.list_(pa.string()),
    )


def _is_plain(base: Column, ref: Column) -> Column:
    rooted = (
        ref.rlike(_PLAIN_ROOTED) & ~ref.contains("/.") & (F.regexp_extract(base, _SITE, 1) != ""))
    return ref.rlike(_PLAIN_ABSOLUTE) | F.coalesce(rooted, F.lit(False))


def _join_plain(base: Column, ref: Column) -> Column:
    return F.when(ref.startswith("/"), F.concat(F.regexp_extract(base, _SITE, 1), ref)).otherwise(ref)


def resolve_urls(base: Column, refs: Column) -> Column:
    """RFC 3986 join of an array of references; an unusable reference becomes null.

    Absolute and rooted references are joined by expressions. Only arrays that hold some other
    kind of reference reach Python; the rest hand it a null.
    """
    plain = F.forall(refs, lambda ref: _is_plain(base, ref))
    return F.when(plain, F.transform(refs, lambda ref: _join_plain(base, ref))).otherwise(
        _join_by_rule(base, F.when(~plain, refs)))


def resolve_url(base: Column, ref: Column) -> Column:
    """RFC 3986 join of one reference; an empty or null base leaves it as it is."""
    return F.get(resolve_urls(base, F.array(ref)), F.lit(0))


def url_key(url: Column) -> Column:
    """Identity of an address: md5 of its raw text, nothing normalised."""
    return F.md5(url)


def record_id(*parts: Column) -> Column:
    """Deterministic 128-bit record id from what makes the record unique."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256), 1, 32)


def merge_maps(*maps: Column) -> Column:
    """Key-wise merge, later maps win; null maps count as empty."""
    def overlaid(first: Column, later: Column) -> Column:
        # the filter keeps the result independent of the session's duplicate-key policy
        kept = F.map_filter(first, lambda key, value: ~F.map_contains_key(later, key))
        return F.map_concat(kept, later)

    empty = F.create_map().cast("map<string,string>")
    return reduce(overlaid, [F.coalesce(one, empty) for one in maps])


def site_slug(name: Column) -> Column:
    """Lower-case slug: runs outside ``[a-z0-9\\u4e00-\\u9fff]`` become one dash, 64 characters."""
    dashed = F.regexp_replace(F.lower(name), "[^a-z0-9一-鿿]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-|-$", ""), 1, 64)


def line_slug(name: Column) -> Column:
    """Shorter slug used for line ids: ``[a-z0-9]`` only, edge dashes kept, 30 characters."""
    return F.substring(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), 1, 30)


def title_preview(title: Column) -> Column:
    """First 60 characters, or a placeholder."""
    return F.substring(or_else(title, F.lit("(no title)")), 1, 60)


def url_preview(url: Column) -> Column:
    """First 40 characters of the path; of the whole text where it is no address."""
    path = F.try_parse_url(url, F.lit("PATH"))
    return F.substring(F.when(path.isNull(), url).otherwise(or_else(path, F.lit("/"))), 1, 40)
