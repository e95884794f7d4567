"""The two Arrow functions that read HTML. Everything after them is column expressions."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvest.functions import markup


_INT, _TEXT = T.IntegerType(), T.StringType()
NODE = T.StructType([
    T.StructField("ord", _INT), T.StructField("last", _INT), T.StructField("parent", _INT),
    T.StructField("depth", _INT), T.StructField("tag", _TEXT), T.StructField("id", _TEXT),
    T.StructField("classes", T.ArrayType(_TEXT)),
    T.StructField("attrs", T.MapType(_TEXT, _TEXT)),
    T.StructField("str_from", _INT), T.StructField("str_len", _INT),
    T.StructField("text_len", _INT), T.StructField("html_len", _INT),
])
PARSED = T.StructType([
    T.StructField("nodes", T.ArrayType(NODE)), T.StructField("strings", T.ArrayType(_TEXT))])
MATCH = T.StructType([
    T.StructField("selector", _TEXT), T.StructField("error", _TEXT),
    T.StructField("ords", T.ArrayType(_INT)), T.StructField("hrefs", T.ArrayType(_TEXT)),
    T.StructField("text", _TEXT),
])


def _lists(sizes: list[int], values: pa.Array) -> pa.ListArray:
    offsets = [0]
    for size in sizes:
        offsets.append(offsets[-1] + size)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


# Text characters of pages that lie in Python as lists at once; a batch of many pages is read in such parts.
PART_CHARS = 1 << 20


def _parts(html: pa.Array, limit: int) -> list[tuple[int, int]]:
    """First and last place (exclusive) of parts of the pages, of about ``limit`` characters or one page."""
    cuts, held = [0], 0
    for at, size in enumerate(pc.utf8_length(html).to_pylist()):
        if held and held + (size or 0) > limit:
            cuts.append(at)
            held = 0
        held += (size or 0) + 1
    return list(zip(cuts, [*cuts[1:], len(html)]))


def _make_parser():
    tree_of, lists, parts_of, limit = markup.PageTree, _lists, _parts, PART_CHARS

    def parse(html: pa.Array) -> pa.Array:
        return pa.concat_arrays([part(html.slice(a, b - a)) for a, b in parts_of(html, limit)])

    def part(html: pa.Array) -> pa.Array:
        columns = {name: [] for name in (
            "ord", "last", "parent", "depth", "tag", "id", "str_from", "str_len",
            "text_len", "html_len")}
        classes, class_sizes, keys, values, key_sizes = [], [], [], [], []
        strings, string_sizes, node_sizes = [], [], []
        for text in html:
            tree = tree_of(text.as_py() or "")
            strings.extend(tree.strings)
            string_sizes.append(len(tree.strings))
            node_sizes.append(len(tree.elements))
            for number, e in enumerate(tree.elements):
                columns["ord"].append(number)
                columns["last"].append(e.last)
                columns["parent"].append(e.parent)
                columns["depth"].append(e.depth)
                columns["tag"].append(e.tag)
                columns["id"].append(e.attrs.get("id"))
                columns["str_from"].append(e.str_from)
                columns["str_len"].append(e.str_to - e.str_from)
                columns["text_len"].append(e.text_len)
                columns["html_len"].append(e.html_len)
                classes.extend(e.classes)
                class_sizes.append(len(e.classes))
                keys.extend(e.attrs)
                values.extend(e.attrs.values())
                key_sizes.append(len(e.attrs))
        text_type, number_type = pa.string(), pa.int32()
        arrays = {name: pa.array(column, text_type if name in ("tag", "id") else number_type)
                  for name, column in columns.items()}
        arrays["classes"] = lists(class_sizes, pa.array(classes, text_type))
        attr_offsets = lists(key_sizes, pa.array(keys, text_type)).offsets
        arrays["attrs"] = pa.MapArray.from_arrays(
            attr_offsets, pa.array(keys, text_type), pa.array(values, text_type))
        names = ["ord", "last", "parent", "depth", "tag", "id", "classes", "attrs",
                 "str_from", "str_len", "text_len", "html_len"]
        nodes = pa.StructArray.from_arrays([arrays[n] for n in names], names)
        return pa.StructArray.from_arrays(
            [lists(node_sizes, nodes), lists(string_sizes, pa.array(strings, text_type))],
            ["nodes", "strings"])

    return parse


def _make_matcher():
    tree_of, compiled_of, ordinals_of, parts_of, limit = (
        markup.PageTree, markup.compile_selector, markup.match_selector, _parts, PART_CHARS)
    known: dict = {}            # per Python worker; cleared when it grows

    def compiled(selector):
        if selector not in known:
            if len(known) > 10_000:
                known.clear()
            try:
                known[selector] = compiled_of(selector), None
            except ValueError as problem:
                known[selector] = None, str(problem)
        return known[selector]

    def one_page(html, selectors):
        tree = None
        found = []
        for selector in selectors:
            steps, error = compiled(selector) if selector else (None, None)
            row = {"selector": selector, "error": error, "ords": [], "hrefs": [], "text": None}
            if steps:
                tree = tree or tree_of(html or "")
                row["ords"] = ordinals_of(tree.elements, steps)
                row["hrefs"] = [tree.elements[i].attrs.get("href") for i in row["ords"]]
                if row["ords"]:
                    row["text"] = tree.text(row["ords"][0])
            found.append(row)
        return found

    def match(html: pa.Array, selectors: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([
            ("selector", pa.string()), ("error", pa.string()), ("ords", pa.list_(pa.int32())),
            ("hrefs", pa.list_(pa.string())), ("text", pa.string())]))
        return pa.concat_arrays([
            pa.array([one_page(h.as_py(), s.as_py() or []) for h, s in zip(html.slice(a, b - a), selectors.slice(a, b - a))], kind)
            for a, b in parts_of(html, limit)])

    return match


_parse_page = F.arrow_udf(_make_parser(), PARSED)
_match_page = F.arrow_udf(_make_matcher(), T.ArrayType(MATCH))


def parse_page(html: Column) -> Column:
    """``struct<nodes, strings>`` of one page, parsed once."""
    return _parse_page(html)


def match_page(html: Column, selectors: Column) -> Column:
    """One result per selector of the ``selectors`` array, all from a single parse.

    ``ords``/``hrefs`` list every match in document order (``href`` null where absent), ``text``
    is the text of the first match. A null or empty selector gives an empty result; one outside
    the supported subset gives its message in ``error``.
    """
    return _match_page(html, selectors)


def check_selector(selector: str) -> str:
    """Refuse an unsupported selector while the plan is built."""
    markup.compile_selector(selector)
    return selector


def node_text(strings: Column, node: Column) -> Column:
    """Text of one element: its slice of the page's strings, joined without separator."""
    return F.array_join(F.slice(strings, node["str_from"] + 1, node["str_len"]), "")


def signature(node: Column) -> Column:
    """``tag.class1.class2`` in class order, or the bare tag."""
    return F.concat_ws(".", node["tag"], node["classes"])


def tag_selector(node: Column) -> Column:
    """Selector of one element: by classes, else by id, else by tag."""
    return (
        F.when(F.size(node["classes"]) > 0, signature(node))
        .when(F.coalesce(node["id"], F.lit("")) != "", F.concat(F.lit("#"), node["id"]))
        .otherwise(node["tag"])
    )
