"""Coarse column types from names, schema and mean text length."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.text import name_tokens
from ..sources.table import Table

# The coarse types, in display order.
COLUMN_TYPES = ["numeric", "categorical", "datetime", "text", "id"]
TEXT_MEAN_CHARS = 50


def is_id_name(name: str) -> bool:
    words = name_tokens(name)
    return "id" in (words[0], words[-1])


def is_date_name(name: str) -> bool:
    return not is_id_name(name) and any(word in name.lower() for word in ("date", "time"))


def column_types(table: Table) -> dict[str, str]:
    return table.once("types", lambda: {c: _column_type(table, c) for c in table.columns})


def _column_type(table, c):
    if is_id_name(c):
        return "id"
    if table.is_number(c) or table.is_boolean(c):
        return "numeric"
    if table.is_temporal(c):
        return "datetime"
    if table.is_nested(c):
        return "nested"
    if is_date_name(c):
        return "datetime"
    return "text" if table.mean_chars(c) > TEXT_MEAN_CHARS else "categorical"


def date_layout_requests(table: Table) -> dict:
    """First dates of the text columns that are typed as datetime, which their names alone decide."""
    return table.layout_requests([c for c in table.string_columns if is_date_name(c)])


def of_type(table: Table, kind: str) -> list[str]:
    return [c for c, t in column_types(table).items() if t == kind]


def type_frame(table: Table) -> DataFrame:
    rows = [(i, c, t) for i, (c, t) in enumerate(column_types(table).items())]
    return table.frame(rows, "position bigint, column string, col_type string")


def type_count_rows(table: Table):
    kinds = list(column_types(table).values())
    return [(t, kinds.count(t)) for t in COLUMN_TYPES]


def type_counts(table: Table) -> DataFrame:
    return table.frame(type_count_rows(table), "col_type string, columns bigint")
