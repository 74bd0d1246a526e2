"""Cycle and scenario reports (A-2, A-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .execute import count_result
from .policy import count_status


def _per_alert(executed: DataFrame, *keep: str) -> DataFrame:
    unknown = F.size(
        F.filter(
            "decisions",
            lambda d: (d["status"] == "Denied")
            & F.exists(
                d["reasons"],
                lambda r: F.lower(r).contains("unknown or unsupported action type."),
            ),
        )
    )
    pending_ids = F.transform(
        F.filter("decisions", lambda d: d["status"] == "PendingApproval"),
        lambda d: d["action_id"],
    )
    return executed.select(
        *keep,
        count_status("Approved").alias("approved"),
        count_status("PendingApproval").alias("pending"),
        count_status("Denied").alias("denied"),
        unknown.alias("unknown_actions"),
        count_result("Succeeded").alias("succeeded"),
        count_result("Failed").alias("failed"),
        count_result("Skipped").alias("skipped"),
        count_result("DryRun").alias("dry_run"),
        pending_ids.alias("_pending_ids"),
    )


def _by_pending(rows: DataFrame) -> DataFrame:
    """One row per pending id (at least one per alert); counters only on the first."""
    return rows.select("*", F.posexplode_outer("_pending_ids").alias("_i", "action_id"))


def _once(name: str) -> Column:
    head = F.coalesce(F.col("_i"), F.lit(0)) == 0
    return F.coalesce(F.sum(F.when(head, F.col(name))), F.lit(0)).cast("bigint").alias(name)


def _head_count() -> Column:
    return F.count_if(F.coalesce(F.col("_i"), F.lit(0)) == 0)


def cycle_report(
    executed: DataFrame,
    rejected: DataFrame,
    next_cursor: str | None = None,
    planning_failed: DataFrame | None = None,
    policy_failed: DataFrame | None = None,
) -> DataFrame:
    """One row with the counters of a cycle.

    Approvals created is the number of distinct ids waiting for approval; it comes out
    of the same scan as the sums, as the only distinct aggregate. Failed stages add
    small partial rows that are summed at the end.
    """
    counters = ["succeeded", "failed", "skipped", "dry_run"]
    done = _by_pending(_per_alert(executed)).agg(
        _head_count().alias("processed"),
        *[_once(c) for c in counters],
        F.countDistinct("action_id").alias("approvals_created"),
    )
    parts = [done]
    for name, df in (
        ("normalization_failed", rejected),
        ("planning_failed", planning_failed),
        ("policy_failed", policy_failed),
    ):
        if df is not None:
            parts.append(df.agg(F.count("*").alias(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    names = ["normalization_failed", "planning_failed", "policy_failed"]

    def total(name: str) -> Column:
        present = name in out.columns
        value = F.coalesce(F.sum(name), F.lit(0)) if present else F.lit(0)
        return value.cast("bigint")

    return out.agg(
        sum((total(n) for n in names), total("processed")).alias("pulled"),
        total("processed").alias("processed"),
        *[total(n).alias(n) for n in names],
        total("failed").alias("execution_failed"),
        total("succeeded").alias("execution_succeeded"),
        total("skipped").alias("execution_skipped"),
        total("dry_run").alias("execution_dry_run"),
        total("approvals_created").alias("approvals_created"),
        F.lit(next_cursor).cast("string").alias("next_cursor"),
    )


def scenario_report(executed: DataFrame) -> DataFrame:
    """Outcome counts per scenario and, with a null scenario, over all of them."""
    sums = ["approved", "pending", "denied", "unknown_actions", "succeeded", "failed",
            "skipped", "dry_run"]
    rows = _by_pending(_per_alert(executed, "scenario"))
    return (
        rows.rollup("scenario")
        .agg(
            F.grouping("scenario").alias("is_total"),
            _head_count().alias("plans"),
            *[_once(c) for c in sums],
            F.countDistinct("action_id").alias("approvals_created"),
        )
    )
