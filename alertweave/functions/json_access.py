"""Case-insensitive access to JSON text, parsed once per object.

``from_json`` to ``map<string,string>`` keeps document order and marks a JSON
null as an entry with a null value, which is what the lookups below rely on:
a missing name gives null, a JSON null gives an empty string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAP_TYPE = "map<string,string>"


def names_of(m: Column) -> Column:
    """Lower-cased property names of a parsed object, in document order (empty for null)."""
    return F.coalesce(F.transform(F.map_keys(m), F.lower), F.array().cast("array<string>"))


def values_of(m: Column) -> Column:
    """Values in the same order; JSON null becomes an empty string."""
    return F.coalesce(
        F.transform(F.map_values(m), lambda v: F.coalesce(v, F.lit(""))),
        F.array().cast("array<string>"),
    )


def at_name(names: Column, values: Column, name: Column | str) -> Column:
    """Value at the first place ``name`` occurs, null when it does not."""
    return F.get(values, (F.array_position(names, name) - 1).cast("int"))


def first_of_each(names: Column, values: Column, candidates: Column) -> Column:
    """For every candidate list, the value of the first candidate that is present.

    Written with array lambdas so that dozens of lookups stay a small expression.
    """
    return F.transform(
        candidates,
        lambda listed: F.get(
            F.filter(
                F.transform(listed, lambda c: at_name(names, values, c)),
                lambda v: v.isNotNull(),
            ),
            0,
        ),
    )


def wrapped_values(text: Column) -> Column:
    """The values of ``[text]``: exactly one when the text is one JSON value."""
    return F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")


def single_value(text: Column) -> Column:
    """The text's one JSON value (objects and arrays as compact JSON), null if it is not
    exactly one.

    ``from_json`` stops after the first value and ignores what follows; inside an array
    anything left over makes the parse fail.
    """
    wrapped = wrapped_values(text)
    return F.when(F.size(wrapped) == 1, F.get(wrapped, F.lit(0)))


def object_text(text: Column) -> Column:
    """:func:`single_value` limited to objects."""
    value = single_value(text)
    return F.when(F.ltrim(text).startswith("{") & value.startswith("{"), value)


def spaced(json_text: Column) -> Column:
    """Put a blank after each comma and colon outside strings of compact JSON."""
    return F.regexp_replace(
        json_text, r'\G((?:"(?:[^"\\]|\\.)*+"|[^:,"])*+)([:,])', "$1$2 "
    )
