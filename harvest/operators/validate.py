"""Presence and type checks of JSON documents: every fault with its place and reason.

A document is a ``variant`` column, so that a missing field, a null, a text and a number stay what
they are in the JSON. ``Field`` lists say what a document may hold; :func:`faults` names what does
not fit, :func:`structure` gives the values of documents that do. Both are plain column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that stand for a truth value.
_TRUE = ["true", "t", "yes", "y", "on", "1"]
_FALSE = ["false", "f", "no", "n", "off", "0"]
_KINDS = {"VOID": "null", "STRING": "text", "BOOLEAN": "bool", "BIGINT": "int", "DECIMAL": "float", "DOUBLE": "float",
          "FLOAT": "float", "OBJECT": "object", "ARRAY": "list"}
_WHOLE = r"^\s*[+-]?[0-9]+(\.0+)?\s*$"
_NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


@dataclass(frozen=True)
class Field:
    """A field of a document.

    ``kind``: ``text, bool, int, float, time, any_map, text_map, texts, object`` or ``objects``.
    ``required``: must be there; ``nullable``: may be null; ``allowed``: the only texts; ``fields``:
    what an object, or each of a list of objects, holds.
    """

    name: str
    kind: str = "text"
    required: bool = False
    nullable: bool = False
    allowed: tuple[str, ...] = ()
    fields: tuple["Field", ...] = ()


def part(doc: Column, name: str) -> Column:
    """A field of a document as it is; null where it is missing."""
    return F.try_variant_get(doc, f"$.{name}", "variant")


def kind_of(value: Column) -> Column:
    """``null, text, bool, int, float, object`` or ``list``; null where there is no value."""
    kinds = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    return F.try_element_at(kinds, F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0))


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _objects(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _number(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def _integral(value: Column, kind: Column) -> Column:
    """Whole numbers, also as 3.0, "3" or a truth value, within 32 bits."""
    whole = F.when(kind == "text", _text(value).rlike(_WHOLE)).when(
        kind.isin("int", "float"), _number(value) == F.floor(_number(value))).when(kind == "bool", True)
    return F.coalesce(whole, F.lit(False)) & F.coalesce(_as_int(value, kind).isNotNull(), F.lit(False))


def _as_int(value: Column, kind: Column) -> Column:
    number = F.when(kind == "text", F.trim(_text(value)).try_cast("double")).when(
        kind == "bool", _text(value).try_cast("boolean").cast("int").cast("double")).otherwise(_number(value))
    return number.try_cast("int")


def _as_bool(value: Column, kind: Column) -> Column:
    said = F.lower(F.when(kind.isin("int", "float"), _number(value).try_cast("int").cast("string")).otherwise(_text(value)))
    return F.when(said.isin(_TRUE), True).when(said.isin(_FALSE), False)


def _as_time(value: Column, kind: Column) -> Column:
    return F.when(kind.isin("int", "float"), F.timestamp_seconds(_number(value))).otherwise(_text(value).try_cast("timestamp"))


def _unfit(field: Field, value: Column, kind: Column) -> Column:
    """Why a value that is there, and isn't null, does not fit; null if it does."""
    def unless(fits: Column, wanted: str) -> Column:
        return F.when(~F.coalesce(fits, F.lit(False)), F.lit(f"must be {wanted}"))

    if field.allowed:
        return unless((kind == "text") & _text(value).isin(*field.allowed), f"one of {', '.join(field.allowed)}")
    if field.kind == "text":
        return unless(kind == "text", "a text")
    if field.kind == "bool":
        fits = _as_bool(value, kind).isNotNull() & ((kind != "float") | (_number(value) == F.floor(_number(value))))
        return unless(kind.isin("bool", "text", "int", "float") & fits, "true or false")
    if field.kind == "int":
        return unless(_integral(value, kind), "a whole number")
    if field.kind == "float":
        return unless(kind.isin("int", "float", "bool") | ((kind == "text") & _text(value).rlike(_NUMBER)), "a number")
    if field.kind == "time":
        return unless(kind.isin("int", "float") | ((kind == "text") & _as_time(value, kind).isNotNull()), "a time")
    if field.kind in ("any_map", "object"):
        return unless(kind == "object", "an object")
    if field.kind == "text_map":
        members = F.map_values(F.try_variant_get(value, "$", "map<string,variant>"))
        return unless((kind == "object") & F.forall(members, lambda m: F.schema_of_variant(m) == "STRING"), "an object of texts")
    if field.kind == "texts":
        return unless((kind == "list") & F.forall(_objects(value), lambda m: F.schema_of_variant(m) == "STRING"), "a list of texts")
    return unless(kind == "list", "a list")


def faults(doc: Column, fields: tuple[Field, ...], path: Column | str = "") -> Column:
    """Faults of a document (``array<string>``, in field order), each as ``path.field: reason``."""
    path = F.lit(path) if isinstance(path, str) else path
    none = F.array().cast("array<string>")
    found = []
    for field in fields:
        value = part(doc, field.name)
        kind = kind_of(value)
        place = F.concat(path, F.lit(field.name))
        reason = (
            F.when(value.isNull(), F.lit("is missing") if field.required else F.lit(None).cast("string"))
            .when(kind == "null", F.lit(None).cast("string") if field.nullable else F.lit("must not be null"))
            .otherwise(_unfit(field, value, kind)))
        found.append(F.array_compact(F.array(F.concat(place, F.lit(": "), reason))))
        if field.kind == "object":
            found.append(F.when(kind == "object", faults(value, field.fields, F.concat(place, F.lit(".")))).otherwise(none))
        if field.kind == "objects":
            found.append(F.when(kind == "list", F.flatten(F.transform(_objects(value), lambda e, i: _element(
                e, field, F.concat(place, F.lit("["), i.cast("string"), F.lit("]")))))).otherwise(none))
    return F.concat(*found)


def _element(element: Column, field: Field, place: Column) -> Column:
    return F.when(kind_of(element) == "object", faults(element, field.fields, F.concat(place, F.lit(".")))).otherwise(
        F.array(F.concat(place, F.lit(": must be an object"))))


def document_faults(doc: Column, fields: tuple[Field, ...]) -> Column:
    """Faults of a whole document joined to one text; null if there are none, and ``not a JSON object`` otherwise."""
    found = faults(doc, fields)
    return F.when(F.coalesce(kind_of(doc), F.lit("none")) != "object", F.lit("not a JSON object")).when(
        F.size(found) > 0, F.array_join(found, "; "))


def typed(value: Column, field: Field, kind: T.DataType) -> Column:
    """The value of a field that fits; null where it is missing or null."""
    is_ = kind_of(value)
    if field.kind == "int":
        made = _as_int(value, is_)
    elif field.kind == "bool":
        made = _as_bool(value, is_)
    elif field.kind == "float":
        made = F.when(is_ == "bool", _as_int(value, is_).cast("double")).otherwise(F.trim(_text(value)).try_cast("double"))
    elif field.kind == "time":
        made = _as_time(value, is_)
    elif field.kind == "texts":
        made = F.try_variant_get(value, "$", "array<string>")
    elif field.kind == "text_map":
        made = F.try_variant_get(value, "$", "map<string,string>")
    elif field.kind == "any_map":
        made = F.when(is_ == "object", members(value) if isinstance(kind, T.MapType) else F.to_json(value))
    elif field.kind == "object":
        made = F.when(is_ == "object", structure(value, field.fields, kind))
    elif field.kind == "objects":
        made = F.when(is_ == "list", F.transform(_objects(value), lambda e: structure(e, field.fields, kind.elementType)))
    else:
        made = _text(value)
    return F.when(F.coalesce(is_, F.lit("null")) != "null", made).cast(kind)


def members(value: Column) -> Column:
    """Fields of an object as texts: texts as they are, anything else as JSON."""
    every = F.try_variant_get(value, "$", "map<string,variant>")
    return F.transform_values(every, lambda _, m: F.when(F.schema_of_variant(m) == "STRING", _text(m)).when(
        F.schema_of_variant(m) != "VOID", F.to_json(m)))


def structure(doc: Column, fields: tuple[Field, ...], kind: T.StructType) -> Column:
    """A struct of the type's fields; those the list does not name are null."""
    by_name = {f.name: f for f in fields}
    return F.struct(*[
        (typed(part(doc, f.name), by_name[f.name], f.dataType) if f.name in by_name else F.lit(None).cast(f.dataType))
        .alias(f.name) for f in kind.fields])
