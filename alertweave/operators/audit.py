"""Audit events and reports (U-3, P-20, A-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions.text import bool_text, iso_micros, non_blank, stable_id
from .execute import ExecutionContext, correlation_id, count_result
from .policy import count_status

ENTRY_COLUMNS = [
    "entry_id", "ts", "correlation_id", "component", "event_type", "message", "data",
]


def _map(*pairs: tuple[str, Column]) -> Column:
    """String map of the pairs whose value is not null."""
    entries = F.array_compact(
        F.array(
            *[
                F.when(
                    value.isNotNull(),
                    F.struct(F.lit(name).alias("key"), value.cast("string").alias("value")),
                )
                for name, value in pairs
            ]
        )
    )
    return F.map_from_entries(entries)


def _event(component: str, kind: str, message: Column, data: Column) -> Column:
    return F.struct(
        F.lit(component).alias("component"),
        F.lit(kind).alias("event_type"),
        message.alias("message"),
        data.alias("data"),
    )


def alert_data(*extra: tuple[str, Column]) -> Column:
    def keep(name: str) -> Column:
        return F.when(non_blank(name), F.col(name))

    return _map(
        ("alertId", F.col("alert_id")),
        ("siem", F.col("siem_name")),
        ("timestampUtc", iso_micros(F.col("ts"))),
        ("alertType", keep("alert_type")),
        ("ruleName", keep("rule_name")),
        ("originalSeverity", F.col("original_severity")),
        *extra,
    )


def _finish(df: DataFrame, now: Column) -> DataFrame:
    return df.select(
        stable_id(F.lit("audit"), "correlation_id", F.col("seq").cast("string")).alias("entry_id"),
        now.alias("ts"),
        "correlation_id",
        "event.*",
    ).select(*ENTRY_COLUMNS)


def execution_events(executed: DataFrame, ctx: ExecutionContext, now: Column) -> DataFrame:
    """All audit entries of processed alerts.

    The entries of one alert are built as one array and exploded, so the alert chain
    runs once, not once per kind of event. Actions skipped by policy leave no entry.
    """
    plan_id = F.col("plan")["plan_id"]
    base = [
        ("planId", plan_id),
        ("environment", F.lit(ctx.environment)),
        ("dryRun", bool_text(F.lit(ctx.dry_run))),
    ]
    start = _event("Execution", "ExecutionStart", F.lit("Execution started."), _map(*base))
    stamp = iso_micros(now)
    acted = F.filter(
        F.concat("results", "rollback_results"),
        lambda r: r["is_rollback"]
        | ~((r["status"] == "Skipped") & (r["executor"] == K.PIPELINE_NAME)),
    )
    actions = F.transform(
        acted,
        lambda r: _event(
            "Execution",
            "ActionResult",
            r["message"],
            _map(
                ("planId", plan_id),
                ("actionId", r["action_id"]),
                ("actionType", r["type"]),
                ("status", r["status"]),
                ("executor", r["executor"]),
                ("startedAtUtc", stamp),
                ("finishedAtUtc", stamp),
                ("message", r["message"]),
                ("externalReference", r["reference"]),
                ("isRollback", F.when(r["is_rollback"], F.lit("true"))),
                ("originalActionId", r["original_action_id"]),
            ),
        ),
    )
    end = _event(
        "Execution",
        "ExecutionEnd",
        F.lit("Execution finished."),
        _map(
            *base,
            ("total", F.size("results")),
            ("succeeded", count_result("Succeeded")),
            ("failed", count_result("Failed")),
            ("skipped", count_result("Skipped")),
            ("dryRunCount", count_result("DryRun")),
        ),
    )
    processed = _event(
        "Orchestrator",
        "AlertProcessed",
        F.concat(F.lit("Alert "), F.col("alert_id"), F.lit(" processed.")),
        alert_data(
            ("planId", plan_id),
            ("approved", count_status("Approved")),
            ("pending", count_status("PendingApproval")),
            ("denied", count_status("Denied")),
        ),
    )
    events = F.concat(F.array(start), actions, F.array(end, processed))
    return _finish(
        executed.select(
            correlation_id(plan_id).alias("correlation_id"),
            F.posexplode(events).alias("seq", "event"),
        ),
        now,
    )


def failure_events(
    failed: DataFrame, now: Column, stage: str = "Normalization", reason: str = "reject_reason"
) -> DataFrame:
    """One entry per alert a stage gave up on (normalization, planning or policy)."""
    text = {
        "Normalization": "Normalization failed: ",
        "Planning": "Planning failed: ",
        "Policy": "Policy evaluation failed: ",
    }[stage]
    event = _event(
        "Orchestrator",
        f"{stage}Failed",
        F.concat(F.lit(text), F.lit("InvalidOperationException: "), F.col(reason)),
        alert_data(),
    )
    return _finish(
        failed.select(
            stable_id(F.lit(stage), "siem_name", "alert_id").alias("correlation_id"),
            F.lit(0).alias("seq"),
            event.alias("event"),
        ),
        now,
    )


def pull_failures(pulls: DataFrame, now: Column) -> DataFrame:
    """Entries for failed pulls; ``pulls`` has ``cursor``, ``since`` and ``error``."""
    event = _event(
        "Orchestrator",
        "PullFailed",
        F.concat(F.lit("Failed to pull alerts: "), F.col("error")),
        _map(
            ("cursor", F.coalesce("cursor", F.lit(""))),
            ("sinceUtc", F.coalesce(iso_micros(F.col("since")), F.lit(""))),
        ),
    )
    return _finish(
        pulls.select(
            stable_id(F.lit("pull"), F.coalesce("cursor", F.lit("")),
                      F.coalesce(F.col("since").cast("string"), F.lit(""))).alias("correlation_id"),
            F.lit(0).alias("seq"),
            event.alias("event"),
        ),
        now,
    )


def matching(
    entries: DataFrame,
    correlation: str | None = None,
    from_ts: Column | None = None,
    to_ts: Column | None = None,
) -> DataFrame:
    """Entries of one correlation id and an inclusive time range; unset parts do not filter."""
    out = entries
    if correlation is not None and correlation.strip():
        out = out.filter(F.col("correlation_id") == correlation)
    if from_ts is not None:
        out = out.filter(F.col("ts") >= from_ts)
    if to_ts is not None:
        out = out.filter(F.col("ts") <= to_ts)
    return out


def summary(entries: DataFrame) -> DataFrame:
    """One row: events, action executions, failures, and the three summary lines."""
    is_action = F.lower("event_type") == "actionresult"
    failed = is_action & (
        F.lower(F.try_element_at(F.col("data"), F.lit("status"))) == "failed"
    )
    counted = entries.agg(
        F.count("*").alias("total_events"),
        F.count_if(is_action).alias("action_executions"),
        F.count_if(failed).alias("failures"),
    )
    return counted.withColumn(
        "summary",
        F.array(
            F.concat(F.lit("Total events: "), F.col("total_events").cast("string")),
            F.concat(F.lit("Action executions: "), F.col("action_executions").cast("string")),
            F.concat(F.lit("Failures: "), F.col("failures").cast("string")),
        ),
    )


def report(
    entries: DataFrame,
    correlation: str | None = None,
    from_ts: Column | None = None,
    to_ts: Column | None = None,
) -> DataFrame:
    return summary(matching(entries, correlation, from_ts, to_ts))
