"""Helpers on VARIANT values whose type changes from row to row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LIST, MAP = "array<variant>", "map<string,variant>"


def strict_json(text: Column) -> Column:
    """The VARIANT of a text that is one whole JSON value, else null.

    The parser stops after the first value; in brackets a rest makes the text invalid, or a second entry.
    """
    wrapped = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", LIST)
    return F.when(F.size(wrapped) == 1, F.get(wrapped, 0))


def as_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def is_text(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def once(v: Column, f: Callable[[Column], Column]) -> Column:
    """``f(v)`` with ``v`` evaluated a single time, however often ``f`` names it."""
    return F.get(F.transform(F.array(v), f), 0)


def decoded(v: Column) -> Column:
    """``v``, or what it says where it is a string holding a JSON object or list."""
    return once(v, lambda x: F.coalesce(F.when(is_text(x) & as_text(x).rlike(r"^\s*[\[{]"), strict_json(as_text(x))), x))


def field(v: Column, name: str) -> Column:
    """A field of an object by its name; null for another type or a missing field."""
    return F.try_variant_get(v, f'$["{name}"]', "variant")


def entries(v: Column) -> Column:
    """A list's entries; a lone value counts as a list of one, null as none."""
    return once(v, lambda x: F.coalesce(F.try_variant_get(x, "$", LIST), F.when(x.isNotNull() & ~F.is_variant_null(x), F.array(x))))


def whole_number(v: Column) -> Column:
    """A number, or text that is one, as a bigint if it is whole."""

    def read(x: Column) -> Column:
        text = F.trim(as_text(x))
        d = F.try_variant_get(x, "$", "double")
        exact = F.when(F.schema_of_variant(x).isin("DOUBLE", "FLOAT") & (F.floor(d).cast("double") == d) & (F.abs(d) < 9e15), d.cast("bigint"))
        return F.coalesce(F.when(text.rlike(r"^[+-]?\d{1,30}(\.0*)?$"), F.regexp_replace(text, r"\.0*$", "").try_cast("bigint")), exact)

    return once(v, read)
