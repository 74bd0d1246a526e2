"""Helpers over the action struct and its parameter map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as K
from .text import non_blank

ACTION_DDL = (
    "struct<action_id:string,type:string,risk:int,impact:int,reversible:boolean,"
    "duration_seconds:int,params:map<string,string>,rationale:string>"
)
PARAMS_DDL = "map<string,string>"


def empty_params() -> Column:
    return F.create_map().cast(PARAMS_DDL)


def signature(action_type: Column, params: Column) -> Column:
    pairs = F.transform(
        F.sort_array(F.map_entries(params)),
        lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))),
    )
    return F.concat(action_type, F.lit(":"), F.array_join(pairs, "|"))


def action_id(action_type: Column, params: Column) -> Column:
    return hashed(signature(action_type, params))


def hashed(signature_: Column) -> Column:
    return F.substring(F.sha2(signature_, 256), 1, 16)


def action(
    action_type: Column,
    params: Column,
    rationale: Column,
    risk: Column | None = None,
    impact: Column | None = None,
    reversible: Column | None = None,
    duration: Column | None = None,
    id_: Column | None = None,
) -> Column:
    return F.struct(
        (action_id(action_type, params) if id_ is None else id_).alias("action_id"),
        action_type.alias("type"),
        (F.lit(0) if risk is None else risk).cast("int").alias("risk"),
        (F.lit(0) if impact is None else impact).cast("int").alias("impact"),
        (F.lit(False) if reversible is None else reversible).alias("reversible"),
        (F.lit(None) if duration is None else duration).cast("int").alias("duration_seconds"),
        params.alias("params"),
        rationale.alias("rationale"),
    )


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once. Lambdas are interpreted and share nothing, so
    what a lambda names twice is computed twice."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def has_key(params: Column, keys: Column) -> Column:
    """Whether one of the keys has a non-blank value."""
    return F.exists(keys, lambda k: non_blank(F.try_element_at(params, k)))


def _sql(value) -> str:
    """A Python constant as a SQL literal, so that a whole table is one expression."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(_sql(v) for v in value) + ")"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def constant(value) -> Column:
    return F.expr(_sql(value))


def by_type(action_type: Column, values: dict, default=None) -> Column:
    """Value per action type from a literal map; it never has more than eleven entries."""
    if not values:
        return F.lit(default)
    table = F.expr("map(" + ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in values.items()) + ")")
    found = F.try_element_at(table, action_type)
    return found if default is None else F.coalesce(found, F.lit(default))


def one_of(action_type: Column, names) -> Column:
    return F.array_contains(constant(list(names)), action_type) if names else F.lit(False)


def key_groups(catalog: dict) -> dict:
    """Per type the groups of keys of which each needs one non-blank value."""
    out = {}
    for name, (_, _, _, _, required) in catalog.items():
        if not required:
            continue
        if name in K.PARAMETER_GROUPS:
            out[name] = K.PARAMETER_GROUPS[name]
        elif list(required) in K.EITHER_KEY_LISTS:
            out[name] = [list(required)]
        else:
            out[name] = [[key] for key in required]
    return out


def parameters_ok(action_type: Column, params: Column, catalog: dict) -> Column:
    """Whether the catalog's required parameters are there and non-blank."""
    groups = by_type(action_type, key_groups(catalog))
    if not key_groups(catalog):
        return F.lit(True)
    return F.coalesce(F.forall(groups, lambda keys: has_key(params, keys)), F.lit(True))


def known(action_type: Column, catalog: dict) -> Column:
    return one_of(action_type, catalog)


def catalog_field(action_type: Column, catalog: dict, position: int, default=None) -> Column:
    return by_type(action_type, {k: v[position] for k, v in catalog.items()}, default)
