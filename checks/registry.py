"""Registered queries, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
_KEPT: dict = {}


def check(name: str, sql: str | None = None):
    """Register ``function(tables)`` as query ``name``; ``sql`` may use the views below."""
    def register(function):
        from checks.tables import Tables

        QUERIES[name] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
        if sql is not None:
            from checks.tables import with_views

            SQL[name] = with_views(sql)
        return function
    return register


def kept(tables, name: str, make: Callable):
    """Share one stored result between the queries of a session."""
    key = (tables.spark.sparkContext.applicationId, tables.folder, name)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]
