"""The alert chain as one lazy plan: normalize, enrich, score, plan, gate, execute.

Every step is a narrow expression over the alert's own row, except the dimension
joins. The same functions serve batch tables and streaming micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import audit, enrich, execute, normalize, plan, policy, replies, report, score


@dataclass
class Triage:
    """Settings of a run. Dimensions are optional; without them alerts stay unenriched."""

    planning: plan.PlanningContext = field(default_factory=plan.PlanningContext)
    execution: execute.ExecutionContext = field(default_factory=execute.ExecutionContext)
    policy: policy.PolicyConfig = field(default_factory=policy.PolicyConfig)
    policy_catalog: dict | None = None
    assets: DataFrame | None = None
    identities: DataFrame | None = None
    intel: DataFrame | None = None
    scorer: Callable[[DataFrame], DataFrame] = score.scenario_score
    plan_replies: DataFrame | None = None
    outcomes: Column | None = None

    def normalized(self, raw: DataFrame) -> DataFrame:
        return normalize.normalize(raw)

    def enriched(self, valid: DataFrame, now: Column) -> DataFrame:
        return enrich.enrich(valid, now, self.assets, self.identities, self.intel)

    def planned(self, valid: DataFrame, now: Column) -> DataFrame:
        if self.plan_replies is not None:
            valid = replies.with_reply_texts(valid, self.plan_replies)
        scored = self.enriched(valid, now).transform(self.scorer)
        planned = plan.plan(scored, self.planning)
        return planned if self.plan_replies is None else replies.with_plan_replies(planned)

    def decided(self, valid: DataFrame, now: Column) -> DataFrame:
        return policy.evaluate(
            self.planned(valid, now), self.planning.environment, self.policy, self.policy_catalog
        )

    def executed(self, valid: DataFrame, now: Column) -> DataFrame:
        return execute.execute(
            self.decided(valid, now), self.execution, outcomes=self.outcomes
        )

    def events(self, executed: DataFrame, rejected: DataFrame, now: Column) -> DataFrame:
        return audit.execution_events(executed, self.execution, now).unionByName(
            audit.failure_events(rejected, now)
        )

    def cycle(self, raw: DataFrame, now: Column, next_cursor: str | None = None) -> DataFrame:
        normalized = self.normalized(raw)
        return report.cycle_report(
            self.executed(normalize.valid(normalized), now),
            normalize.rejects(normalized),
            next_cursor,
        )


def ranking(planned_header: DataFrame) -> DataFrame:
    """One row per alert: what to do and how urgent it is."""
    return planned_header.select(
        "alert_id", "siem_name", "alert_type", "severity",
        F.col("assessment")["confidence"].alias("confidence"),
        "strategy", "priority", F.col("plan_summary").alias("summary"),
    )
