"""All-string dataset rows: projection, append, dedupe (P-21, J-6, A-11, A-8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_access import MAP_TYPE, spaced


def _is_json_bool(document: Column, field: str) -> Column:
    kind = F.schema_of_variant(
        F.try_variant_get(F.try_parse_json(document), f'$["{field}"]', "variant")
    )
    return F.coalesce(kind == "BOOLEAN", F.lit(False))


def project_rows(
    logs: DataFrame, fields: list[str], document: str = "document", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Pick top-level names of each JSON object as text columns.

    Names are case-sensitive and dots are plain characters. Missing and null become an
    empty string, nested values stay JSON text, booleans print as ``True``/``False``.
    """
    parsed = logs.withColumn("_m", F.from_json(document, MAP_TYPE))
    columns = []
    for field in fields:
        text = F.try_element_at(F.col("_m"), F.lit(field))
        value = (
            F.when(
                text.isin("true", "false") & _is_json_bool(F.col(document), field),
                F.initcap(text),
            )
            .when(text.startswith("{") | text.startswith("["), spaced(text))
            .otherwise(text)
        )
        columns.append(F.coalesce(value, F.lit("")).alias(field))
    return parsed.select(*keep, *columns)


def named(column: str) -> Column:
    """Column by its exact name; dots in dataset names are plain characters."""
    return F.col(f"`{column}`")


def signature(df: DataFrame, unique_fields: list[str]) -> Column:
    """Digest of the unique fields; a field that is not a column counts as empty."""
    parts = [
        F.coalesce(named(f).cast("string"), F.lit("")) if f in df.columns else F.lit("")
        for f in unique_fields
    ]
    return F.sha2(F.to_json(F.array(*parts)), 256)


def deduplicate(
    rows: DataFrame, unique_fields: list[str], order_by: list[str]
) -> DataFrame:
    """First row per signature in ``order_by`` order.

    A minimum per signature combines before the shuffle, so a signature shared by a
    third of the rows still costs one row per map task.
    """
    columns = rows.columns
    rest = [c for c in columns if c not in order_by]
    return (
        rows.withColumn("_sig", signature(rows, unique_fields))
        .groupBy("_sig")
        .agg(F.min(F.struct(*[named(c) for c in (*order_by, *rest)])).alias("_first"))
        .select(*[F.col("_first")[c].alias(c) for c in columns])
    )


def new_rows(
    stored: DataFrame, incoming: DataFrame, unique_fields: list[str], order_by: list[str]
) -> DataFrame:
    """Incoming rows whose signature is neither stored nor earlier in the input."""
    fresh = deduplicate(incoming, unique_fields, order_by)
    seen = stored.select(signature(stored, unique_fields).alias("_sig")).distinct()
    return (
        fresh.withColumn("_sig", signature(fresh, unique_fields))
        .join(seen, "_sig", "left_anti")
        .drop("_sig")
    )


def duplicate_count(rows: DataFrame, unique_fields: list[str]) -> DataFrame:
    """One row: rows a dedupe would remove."""
    return (
        rows.select(signature(rows, unique_fields).alias("_sig"))
        .groupBy("_sig")
        .agg(F.count("*").alias("_n"))
        .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates_removed"))
    )
