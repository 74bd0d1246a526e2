"""Evaluate costly columns once.

Catalyst moves a filter below the projection that computes its column by copying the
expression into the filter; exploding an array column adds such a filter by itself. For a column built from parsed JSON that multiplies the
parsing. A one-row generator keeps the computed columns as plain attributes.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pin(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add (or replace) ``columns`` behind a one-row generator; no shuffle.

    The columns are computed in a projection below it: Spark compiles that, while a generator
    with a lambda anywhere inside is interpreted as a whole.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    made = {f"_pin_{name}": value.alias(f"_pin_{name}") for name, value in columns.items()}
    named = F.struct(*[F.col(f"`_pin_{name}`").alias(name) for name in columns])
    return df.select(*kept, *made.values()).select(*kept, F.inline(F.array(named)))


def ship(module: str) -> None:
    """Send the helpers of ``module`` to Python workers by value.

    Workers then need no installed copy of this package.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module])
