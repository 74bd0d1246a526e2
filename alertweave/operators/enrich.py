"""Asset, identity and threat-intel lookups and the enrichment merge (J-1 .. J-4).

Each lookup is "the earliest dimension row that matches on any of several keys".
It runs as one equi-join per key against a table of the earliest position of each
key value; the lowest position among the hits wins and one join fetches its record.
Only numbers are aggregated, and records move once. No hint forces a broadcast:
Spark broadcasts a lookup only while its size stays under
``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles both sides, where
adaptive execution splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, bool_text

TAGS = "map<string,string>"


SPREAD = 4096


def _spread(alerts: DataFrame, key: Column) -> Column:
    """``key``, where it is null one of a few values that no key has.

    Alerts without a key, or without a match, spread over the tasks of a shuffle; as nulls all
    of them would meet in one task.
    """
    if "alert_id" not in alerts.columns:
        return key
    other = F.pmod(F.xxhash64("alert_id"), F.lit(SPREAD)).cast("string")
    return F.coalesce(key, F.concat(F.lit("\x00"), other))


def first_match(
    alerts: DataFrame,
    dimension: DataFrame,
    keys: list[tuple[str, Column]],
    out: str,
) -> DataFrame:
    """Add struct ``out``: the earliest ``dimension`` row matching on any key.

    ``keys`` pairs a dimension column with the alert expression it is compared to,
    ignoring case; blank values on either side never match. ``dimension`` carries
    ``pos``, the row's place in the source, which is unique.
    """
    joined = alerts
    places = []
    for i, (dim_column, alert_value) in enumerate(keys):
        lookup = (
            dimension.select(F.lower(blank_to_null(dim_column)).alias(f"_k{i}"), "pos")
            .filter(F.col(f"_k{i}").isNotNull())
            .groupBy(f"_k{i}")
            .agg(F.min("pos").alias(f"_p{i}"))
        )
        key = _spread(alerts, F.lower(blank_to_null(alert_value)))
        joined = joined.join(lookup, key == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        places.append(f"_p{i}")
    record = F.struct("pos", *[c for c in dimension.columns if c != "pos"])
    records = dimension.select(F.col("pos").cast("string").alias("_pos"), record.alias(out))
    best = (F.col(places[0]) if len(places) == 1 else F.least(*places)).cast("string")
    return joined.withColumn("_best", _spread(alerts, best)).drop(*places).join(
        records, F.col("_best") == F.col("_pos"), "left"
    ).drop("_best", "_pos")


def _note(provider: str, summary: str, now: Column, when: Column) -> Column:
    return F.when(
        when,
        F.struct(
            F.lit(provider).alias("provider"), now.alias("ts"), F.lit(summary).alias("summary")
        ),
    )


def asset_patch(alerts: DataFrame, assets: DataFrame, now: Column) -> DataFrame:
    """Add ``p_asset`` (struct asset, tags, note), fields null when nothing matched."""
    e = F.col("entities")
    m = F.col("_m")
    hit = m.isNotNull()
    joined = first_match(
        alerts,
        assets.select("pos", "host_id", "hostname", "ip", "criticality", "environment", "owner",
                      "team"),
        [("host_id", e["host_id"]), ("hostname", e["hostname"]), ("ip", e["src_ip"])],
        "_m",
    )
    patch = F.struct(
        F.when(
            hit,
            F.struct(
                F.coalesce(m["host_id"], m["hostname"], F.lit("unknown")).alias("asset_id"),
                F.coalesce(m["criticality"], F.lit(0)).alias("criticality"),
                m["environment"].alias("environment"),
                F.array_compact(
                    F.array(blank_to_null(m["owner"]), blank_to_null(m["team"]))
                ).alias("roles"),
            ),
        ).alias("context"),
        F.when(
            hit,
            F.create_map(
                F.lit("asset_owner"), F.coalesce(m["owner"], F.lit("")),
                F.lit("asset_team"), F.coalesce(m["team"], F.lit("")),
            ),
        ).alias("tags"),
        _note("AssetInventory", "Asset matched.", now, hit).alias("note"),
    )
    return joined.withColumn("p_asset", patch).drop("_m")


def identity_patch(alerts: DataFrame, identities: DataFrame, now: Column) -> DataFrame:
    e = F.col("entities")
    m = F.col("_m")
    hit = m.isNotNull()
    joined = first_match(
        alerts,
        identities.select("pos", "user_id", "username", "privileged", "department",
                          "is_service_account"),
        [("user_id", e["user_id"]), ("username", e["username"])],
        "_m",
    )
    service = F.coalesce(m["is_service_account"], F.lit(False))
    patch = F.struct(
        F.when(
            hit,
            F.struct(
                F.coalesce(m["user_id"], m["username"]).alias("user_id"),
                F.coalesce(m["privileged"], F.lit(False)).alias("privileged"),
                m["department"].alias("department"),
                F.when(service, F.array(F.lit("service_account"))).alias("groups"),
            ),
        ).alias("context"),
        F.when(
            hit,
            F.create_map(
                F.lit("department"), F.coalesce(m["department"], F.lit("")),
                F.lit("is_service_account"), bool_text(service),
            ),
        ).alias("tags"),
        _note("Identity", "Identity matched.", now, hit).alias("note"),
    )
    return joined.withColumn("p_identity", patch).drop("_m")


def intel_patch(alerts: DataFrame, intel: DataFrame, now: Column) -> DataFrame:
    e = F.col("entities")
    m = F.col("_m")
    hit = m.isNotNull()
    joined = first_match(
        alerts,
        intel.select("pos", "src_ip", "file_hash", "reputation", "source", "tags"),
        [("src_ip", e["src_ip"]), ("file_hash", e["file_hash"])],
        "_m",
    )
    patch = F.struct(
        F.when(
            hit,
            F.struct(
                F.coalesce(m["reputation"], F.lit(0)).alias("reputation"),
                m["tags"].alias("matches"),
            ),
        ).alias("context"),
        F.when(
            hit, F.create_map(F.lit("ti_source"), F.coalesce(m["source"], F.lit("")))
        ).alias("tags"),
        _note("ThreatIntel", "Threat intel matched.", now, hit).alias("note"),
    )
    return joined.withColumn("p_intel", patch).drop("_m")


def merge_tags(left: Column, right: Column) -> Column:
    """Union of two tag maps; on a shared key the right value wins; null maps count as absent."""
    both = F.map_zip_with(left, right, lambda _, a, b: F.coalesce(b, a))
    return F.coalesce(F.when(left.isNull(), right).when(right.isNull(), left), both)


def enrich(
    alerts: DataFrame,
    now: Column,
    assets: DataFrame | None = None,
    identities: DataFrame | None = None,
    intel: DataFrame | None = None,
    failed: dict[str, str] | None = None,
) -> DataFrame:
    """Run the lookups that are given and fold their patches in provider order.

    ``failed`` maps a provider whose source could not be read to its error text;
    it leaves a note instead of a context. A caller that wants strict behaviour
    lets the reader raise instead.
    """
    out = alerts
    patches = []
    if assets is not None:
        out = asset_patch(out, assets, now)
        patches.append("p_asset")
    if identities is not None:
        out = identity_patch(out, identities, now)
        patches.append("p_identity")
    if intel is not None:
        out = intel_patch(out, intel, now)
        patches.append("p_intel")

    asset_type = "struct<asset_id:string,criticality:int,environment:string,roles:array<string>>"
    identity_type = (
        "struct<user_id:string,privileged:boolean,department:string,groups:array<string>>"
    )
    intel_type = "struct<reputation:int,matches:array<string>>"

    def part(name: str, ddl: str) -> Column:
        return (F.col(name)["context"] if name in patches else F.lit(None)).cast(ddl)

    tags = F.create_map().cast(TAGS)
    for p in patches:
        tags = merge_tags(tags, F.col(p)["tags"])
    notes = [F.col(p)["note"] for p in patches]
    for provider, error in (failed or {}).items():
        notes.append(_note(provider, f"Enrichment failed: {error}", now, F.lit(True)))
    note_type = "array<struct<provider:string,ts:timestamp,summary:string>>"
    provenance = F.array_compact(F.array(*notes)) if notes else F.array()
    return (
        out.withColumn("asset", part("p_asset", asset_type))
        .withColumn("identity", part("p_identity", identity_type))
        .withColumn("threat_intel", part("p_intel", intel_type))
        .withColumn("tags", tags)
        .withColumn("provenance", provenance.cast(note_type))
        .drop(*patches)
    )


def add_tags(enriched: DataFrame, extra: Column) -> DataFrame:
    """Merge another tag map (for example scenario labels) over the alert's tags."""
    return enriched.withColumn("tags", merge_tags(F.col("tags"), extra))


def criticality() -> Column:
    return F.coalesce(F.col("asset")["criticality"], F.lit(0))


def privileged() -> Column:
    return F.coalesce(F.col("identity")["privileged"], F.lit(False))
