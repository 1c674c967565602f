"""JSON values of unknown shape as variants: kinds, truth, fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def kind(v: Column) -> Column:
    """'null' (also for no value), 'list', 'object', 'string', 'boolean' or 'number'."""

    def of(t: Column) -> Column:  # the schema's text, null for no value
        return F.when(t.isNull() | (t == "VOID"), "null").when(t.startswith("ARRAY"), "list").when(t.startswith("OBJECT"), "object").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").otherwise("number")

    return let(F.schema_of_variant(v), of)


def field(v: Column, name: str) -> Column:
    """The value at a key of an object, as a variant; null where there is none."""
    return F.try_variant_get(v, f"$['{name}']", "variant")


def elements(v: Column) -> Column:
    """The elements of a list, null for any other value."""
    return let(v, lambda x: F.when(F.schema_of_variant(x).startswith("ARRAY"), F.try_variant_get(x, "$", "array<variant>")))


def entries(v: Column) -> Column:
    """An object as a map of variants, null for any other value."""
    return let(v, lambda x: F.when(F.schema_of_variant(x).startswith("OBJECT"), F.try_variant_get(x, "$", "map<string,variant>")))


def has(v: Column, *names: str) -> Column:
    """Whether an object has one of the keys, whatever the value."""
    return F.coalesce(F.arrays_overlap(F.map_keys(entries(v)), F.array(*map(F.lit, names))), F.lit(False))


def truthy(v: Column) -> Column:
    """Neither null, nor empty, zero or false."""

    def full(x: Column, k: Column) -> Column:
        out = F.when(k == "string", F.try_variant_get(x, "$", "string") != "").when(k == "boolean", F.try_variant_get(x, "$", "boolean")).when(k == "number", F.try_variant_get(x, "$", "double") != 0)
        return F.coalesce(out.when(k == "list", F.size(elements(x)) > 0).when(k == "object", F.size(entries(x)) > 0), F.lit(False))

    return let(v, lambda x: let(kind(x), lambda k: full(x, k)))


def text(v: Column) -> Column:
    """A value as text: '' for null, lists and objects as JSON."""
    said = lambda x, k: F.when(k == "null", "").when(k.isin("list", "object"), F.to_json(x)).otherwise(F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("")))
    return let(v, lambda x: let(kind(x), lambda k: said(x, k)))


def first_truthy(*values: Column) -> Column:
    """The first value that is truthy, null if none is."""
    return F.coalesce(*[let(v, lambda x: F.when(truthy(x), x)) for v in values])
