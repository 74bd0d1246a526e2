"""Raw alerts to one schema, with a reject path (P-1 .. P-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions.json_access import MAP_TYPE, at_name, first_of_each, names_of, values_of
from ..functions.staging import pin
from ..functions.text import clamp, non_blank

RAW_COLUMNS = [
    "alert_id",
    "siem_name",
    "ts",
    "rule_name",
    "alert_type",
    "original_severity",
    "payload",
]


def scale_level(level: Column) -> Column:
    """Rule level to 0-100: 1..15 are stretched, anything above is only capped."""
    return (
        F.when(level.isNull(), F.lit(None).cast("int"))
        .when(level <= 0, F.lit(0))
        .when(level <= 15, F.round(level * F.lit(100.0 / 15.0)).cast("int"))
        .otherwise(clamp(level, 0, 100))
    )


PARENTS = ["data", "agent", "manager", "rule"]


def _candidates(lists: list[list[str]]) -> Column:
    return F.array(*[F.array(*[F.lit(c.lower()) for c in names]) for names in lists])


def map_alerts(raw: DataFrame) -> DataFrame:
    """Pick the profile by source name and pull entities and severity out of the payload.

    Every JSON object is parsed once per row into name and value arrays; the nested
    profile appends its sub-objects under ``parent.name``. The flat profile reads the
    arrays from the end, because there the last of equal names counts. Rows without a
    profile get null entities.
    """
    nested = F.coalesce(F.lower("siem_name") == K.NESTED_SIEM, F.lit(False))
    flat = F.coalesce(F.col("siem_name") == K.FLAT_SIEM, F.lit(False))
    no_text = F.array().cast("array<string>")

    root = F.from_json("payload", MAP_TYPE)
    kid_maps = F.transform(
        F.array(*[F.lit(p) for p in PARENTS]),
        lambda p: F.from_json(at_name(F.col("_rn"), F.col("_rv"), p), MAP_TYPE),
    )
    kid_names = F.flatten(
        F.transform(
            "_kids",
            lambda m, i: F.transform(
                names_of(m),
                lambda n: F.concat(
                    F.get(F.array(*[F.lit(p + ".") for p in PARENTS]), i), n
                ),
            ),
        )
    )
    kid_values = F.flatten(F.transform("_kids", values_of))
    parsed = (
        raw.withColumn("_root", root)
        .withColumn("_rn", names_of(F.col("_root")))
        .withColumn("_rv", values_of(F.col("_root")))
        .withColumn("_kids", F.when(nested, kid_maps))
        .withColumn(
            "_names",
            F.when(nested, F.concat("_rn", kid_names))
            .when(flat, F.reverse("_rn"))
            .otherwise(no_text),
        )
        .withColumn(
            "_values",
            F.when(nested, F.concat("_rv", kid_values))
            .when(flat, F.reverse("_rv"))
            .otherwise(no_text),
        )
    )
    names, values = F.col("_names"), F.col("_values")
    level = F.coalesce(
        F.col("original_severity"), at_name(names, values, "rule.level").try_cast("int")
    )
    severity = (
        F.when(nested, F.coalesce(scale_level(level), F.lit(K.DEFAULT_SEVERITY)))
        .when(flat, F.coalesce("original_severity", F.lit(K.DEFAULT_SEVERITY)))
        .cast("int")
    )
    found = first_of_each(
        names,
        values,
        F.when(nested, _candidates([K.NESTED_CANDIDATES[f] for f in K.ENTITY_FIELDS])).when(
            flat, _candidates([[f] for f in K.ENTITY_FIELDS])
        ),
    )
    located = parsed.withColumn("_found", found)
    entities = F.when(
        nested | flat,
        F.struct(*[F.get("_found", F.lit(i)).alias(f) for i, f in enumerate(K.ENTITY_FIELDS)]),
    )
    return pin(
        located, {"severity": severity, "entities": entities, "mapped": nested | flat}
    ).drop("_root", "_rn", "_rv", "_kids", "_names", "_values", "_found")


def with_errors(mapped: DataFrame) -> DataFrame:
    """Add ``errors``: an empty array for valid alerts, else one text per broken rule."""
    e = F.col("entities")
    has_entity = F.lit(False)
    for field in ("hostname", "host_id", "username", "user_id", "src_ip", "dst_ip"):
        has_entity = has_entity | non_blank(e[field])
    errors = F.array_compact(
        F.array(
            F.when(~non_blank("alert_id"), F.lit(K.ERR_ALERT_ID)),
            F.when(~non_blank("siem_name"), F.lit(K.ERR_SIEM)),
            F.when(~has_entity, F.lit(K.ERR_ENTITY)),
        )
    )
    return mapped.withColumn("errors", errors)


def normalize(raw: DataFrame) -> DataFrame:
    """All alerts with ``reject_reason`` (null when the alert is usable)."""
    checked = with_errors(map_alerts(raw))
    reason = F.when(~F.col("mapped"), F.lit(K.NO_MAPPER)).when(
        F.size("errors") > 0,
        F.concat(F.lit(K.INVALID_PREFIX), F.array_join("errors", "; ")),
    )
    return checked.withColumn("reject_reason", reason).drop("errors", "mapped")


def valid(normalized: DataFrame) -> DataFrame:
    return normalized.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejects(normalized: DataFrame) -> DataFrame:
    return normalized.filter(F.col("reject_reason").isNotNull()).select(
        "alert_id", "siem_name", "ts", "alert_type", "rule_name", "original_severity",
        "payload", "reject_reason",
    )
