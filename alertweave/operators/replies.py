"""Request tables for offline inference and the parsing of replies (P-28..P-30, J-15)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import actions as A
from ..functions import fixed as K
from ..functions.json_access import object_text
from ..functions.staging import pin
from ..functions.text import iso_micros, non_blank, py_strip, stable_id
from .enrich import criticality, privileged
from .plan import PlanningContext

# --- requests -------------------------------------------------------------------


def scorer_alert() -> Column:
    """Alert part of a score request; rule name and severity are included."""
    e = F.col("entities")
    return F.struct(
        F.col("siem_name").alias("sourceSiem"),
        F.col("alert_id").alias("alertId"),
        F.col("alert_type").alias("type"),
        F.col("rule_name").alias("ruleName"),
        F.col("severity").alias("severity"),
        iso_micros(F.col("ts")).alias("timestampUtc"),
        F.struct(
            e["host_id"].alias("hostId"),
            e["username"].alias("username"),
            e["src_ip"].alias("srcIp"),
            e["file_hash"].alias("fileHash"),
        ).alias("entities"),
        F.struct(
            F.coalesce(F.col("asset")["environment"], F.lit("unknown")).alias("environment"),
            criticality().alias("assetCriticality"),
            privileged().alias("privileged"),
        ).alias("context"),
    )


def score_requests(enriched: DataFrame) -> DataFrame:
    """``alert_id, request, prompt``: JSON payload and model prompt per alert."""
    correlation = F.try_element_at(F.col("tags"), F.lit("correlation_id"))
    payload = F.to_json(
        F.struct(
            F.when(non_blank(correlation), correlation)
            .otherwise(F.col("alert_id"))
            .alias("correlationId"),
            scorer_alert().alias("alert"),
        )
    )
    prompt = F.concat(
        F.lit(K.SCORER_REQUEST_INTRO + "\n\nAlert:\n"), F.to_json(scorer_alert()), F.lit("\n")
    )
    return enriched.select("alert_id", payload.alias("request"), prompt.alias("prompt"))


def plan_requests(
    scored: DataFrame, now: Column, ctx: PlanningContext | None = None
) -> DataFrame:
    """``alert_id, request, prompt`` of the planner."""
    ctx = ctx or PlanningContext()
    e = F.col("entities")
    a = F.col("assessment")
    alert = F.struct(
        F.col("siem_name").alias("sourceSiem"),
        F.col("alert_id").alias("alertId"),
        F.col("alert_type").alias("type"),
        F.col("rule_name").alias("ruleName"),
        iso_micros(F.col("ts")).alias("timestampUtc"),
        F.col("severity"),
        F.struct(
            e["hostname"].alias("hostname"), e["host_id"].alias("hostId"),
            e["username"].alias("username"), e["user_id"].alias("userId"),
            e["src_ip"].alias("srcIp"), e["dst_ip"].alias("dstIp"),
            e["domain"].alias("domain"), e["process_name"].alias("processName"),
            e["process_path"].alias("processPath"), e["file_hash"].alias("fileHash"),
        ).alias("entities"),
        F.struct(
            F.col("asset"), F.col("identity"), F.col("threat_intel").alias("threatIntel"),
            F.col("tags"), criticality().alias("assetCriticality"),
            privileged().alias("privileged"),
            F.coalesce(F.col("asset")["environment"], F.lit("unknown")).alias("environment"),
        ).alias("context"),
    )
    assessment = F.struct(
        a["confidence"].alias("confidence"), a["severity"].alias("severity"),
        a["hypothesis"].alias("hypothesis"), a["evidence"].alias("evidence"),
        a["recommended"].alias("recommendedActions"),
    )
    planning = F.struct(
        F.lit(ctx.environment).alias("environment"), F.lit(ctx.dry_run).alias("dryRun"),
        iso_micros(now).alias("nowUtc"),
    )
    prompt = F.concat(
        F.lit(
            K.PLANNER_REQUEST_INTRO + "\n" + json.dumps(K.PLANNER_REPLY_SHAPE, indent=2)
            + "\n\n" + K.PLANNER_REQUEST_OUTRO + "\n\nAlert:\n"
        ),
        F.to_json(alert),
        F.lit("\n\nAssessment:\n"),
        F.to_json(assessment),
        F.lit("\n"),
    )
    request = F.to_json(
        F.struct(alert.alias("alert"), assessment.alias("assessment"),
                 planning.alias("planning"))
    )
    return scored.select("alert_id", request.alias("request"), prompt.alias("prompt"))


def rule_requests(goals: DataFrame) -> DataFrame:
    """Rule-generation payload per detection goal; missing context columns become null."""

    def part(name: str) -> Column:
        return F.col(name) if name in goals.columns else F.lit(None).cast("string")

    payload = F.to_json(
        F.struct(
            F.col("detection_goal"),
            F.lit(K.NESTED_SIEM).alias("siem"),
            part("example_events").alias("example_events"),
            part("existing_rules").alias("existing_rules"),
            part("existing_logs").alias("existing_logs"),
        ),
        {"ignoreNullFields": "false"},
    )
    return goals.withColumn("request", payload)


# --- replies --------------------------------------------------------------------


def braces(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; null when there is no such stretch."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.length(found) > 0, found)


def extract_object(text: Column) -> Column:
    """JSON object inside a reply, null when there is none."""
    return object_text(braces(text))


def rule_reply(text: Column) -> Column:
    """Like :func:`extract_object`, but plain text comes back as a message object."""
    snippet = py_strip(F.coalesce(text, F.lit("")))
    message = F.to_json(F.struct(snippet.alias("message")))
    return F.coalesce(extract_object(snippet), message)


ASSESSMENT_REPLY = "confidence double, severity int, hypothesis string, evidence array<string>"


def decode_assessment(reply: Column) -> Column:
    """Assessment of a scorer reply, null when it holds no JSON object or an empty one."""
    body = extract_object(reply)
    r = F.from_json(body, ASSESSMENT_REPLY)
    return F.when(
        body.isNotNull() & (body != "{}"),
        F.struct(
            F.coalesce(r["confidence"], F.lit(0.0)).alias("confidence"),
            F.coalesce(r["severity"], F.lit(0)).alias("severity"),
            F.coalesce(r["hypothesis"], F.lit(K.SCORER_NO_HYPOTHESIS)).alias("hypothesis"),
            F.coalesce(r["evidence"], F.array().cast("array<string>")).alias("evidence"),
            F.lit(None).cast(
                "array<struct<type:string,params:map<string,string>,rationale:string>>"
            ).alias("recommended"),
        ),
    )


_ACTION_REPLY = (
    "array<struct<actionId:string,type:string,risk:string,expectedImpact:string,"
    "reversible:string,durationSeconds:string,parameters:map<string,string>,rationale:string>>"
)
PLAN_REPLY = (
    "planId string, strategy string, priority string, summary string, "
    f"actions {_ACTION_REPLY}, rollbackActions {_ACTION_REPLY}, "
    "rationale array<string>, tags map<string,string>"
)


def _name(value: Column, names: list[str]) -> Column:
    """Enum text to its name: any case, or the ordinal as digits; null when unknown."""
    lowered = F.lower(F.trim(value))
    out = None
    for i, name in enumerate(names):
        branch = lowered.isin(name.lower(), str(i))
        out = F.when(branch, F.lit(name)) if out is None else out.when(branch, F.lit(name))
    return out


def _decode_actions(raw: Column) -> Column:
    def one(x: Column) -> Column:
        t = _name(x["type"], K.ACTION_TYPES)
        params = F.coalesce(
            F.transform_values(x["parameters"], lambda _, v: F.coalesce(v, F.lit(""))),
            A.empty_params(),
        )
        return A.action(
            t,
            params,
            F.coalesce(x["rationale"], F.lit("")),
            F.coalesce(x["risk"].try_cast("int"), F.lit(0)),
            F.coalesce(x["expectedImpact"].try_cast("int"), F.lit(0)),
            F.coalesce(F.lower(F.trim(x["reversible"])) == "true", F.lit(False)),
            x["durationSeconds"].try_cast("int"),
            F.coalesce(x["actionId"], A.action_id(t, params)),
        )

    known = F.filter(
        F.coalesce(raw, F.array().cast(_ACTION_REPLY)),
        lambda x: _name(x["type"], K.ACTION_TYPES).isNotNull(),
    )
    return F.transform(known, one)


def decode_plans(
    replies: DataFrame, out: str = "plan", key: str = "alert_id", text: str = "reply"
) -> DataFrame:
    """Plan struct per planner reply; null when unreadable or without a known action.

    Staged, so that each reply is parsed once per step and not once per field.
    """
    staged = pin(replies, {"_body": object_text(F.col(text))})
    wrapped = F.get_json_object("_body", "$.plan")
    staged = pin(staged, {"_r": F.from_json(F.coalesce(wrapped, "_body"), PLAN_REPLY)})
    r = F.col("_r")
    staged = pin(
        staged,
        {
            "_actions": _decode_actions(r["actions"]),
            "_rollbacks": _decode_actions(r["rollbackActions"]),
        },
    )
    built = F.struct(
        F.coalesce(r["planId"], stable_id(F.lit("reply"), key)).alias("plan_id"),
        F.coalesce(_name(r["strategy"], K.STRATEGIES), F.lit("NotifyOnly")).alias("strategy"),
        F.coalesce(r["priority"].try_cast("int"), F.lit(0)).alias("priority"),
        F.coalesce(r["summary"], F.lit("")).alias("summary"),
        F.col("_actions").alias("actions"),
        F.col("_rollbacks").alias("rollback_actions"),
        F.coalesce(r["rationale"], F.array().cast("array<string>")).alias("rationale"),
        r["tags"].alias("tags"),
    )
    return staged.withColumn(out, F.when(F.size("_actions") > 0, built)).drop(
        "_body", "_r", "_actions", "_rollbacks"
    )


REPLY_TEXT = "_reply_text"


def with_reply_texts(alerts: DataFrame, replies: DataFrame, key: str = "alert_id") -> DataFrame:
    """Add the text of each alert's planner reply, to be decoded after planning.

    Done before planning, the join shuffles alerts and texts and never whole plans.
    """
    return alerts.join(replies.select(key, F.col("reply").alias(REPLY_TEXT)), key, "left")


def with_plan_replies(
    planned: DataFrame, replies: DataFrame | None = None, key: str = "alert_id"
) -> DataFrame:
    """Use the external plan where a reply decodes, else keep the computed one.

    Without ``replies`` the alerts carry the texts since :func:`with_reply_texts`.
    """
    joined = planned if replies is None else with_reply_texts(planned, replies, key)
    return (
        decode_plans(joined, "_external", key, REPLY_TEXT)
        .drop(REPLY_TEXT)
        .withColumn("plan_source", F.when(F.col("_external").isNotNull(), F.lit("external"))
                    .otherwise(F.lit("computed")))
        .withColumn("plan", F.coalesce(F.col("_external"), F.col("plan")))
        .drop("_external")
    )
