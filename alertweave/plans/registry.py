"""Registered queries: each runs real operators over whole driver tables.

Outputs are flattened to scalar columns so that any engine can compare them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import actions as A
from ..functions import fixed as K
from ..operators import (
    approvals,
    audit,
    cases,
    dataset,
    enrich,
    execute,
    heuristics,
    knowledge,
    normalize,
    plan,
    policy,
    replies,
    report,
    score,
    training,
)
from ..session import ensure_checkpoint_dir, prepare
from ..sources import alerts as alert_source
from ..sources import readers, sinks
from ..streaming import stateful
from ..streaming import triage as triage_stream
from ..streaming.case_table import CaseTable
from . import fixtures as X
from .triage import Triage, ranking

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return fn(prepare(spark), sf)

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def flat_list(c: Column) -> Column:
    return F.array_join(c, "|")


def flat_map(c: Column) -> Column:
    pairs = F.transform(
        F.sort_array(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return F.array_join(pairs, "|")


# --- shared stages ----------------------------------------------------------------

STRICT = policy.PolicyConfig(
    min_confidence=0.75,
    risk_threshold=60,
    impact_threshold=60,
    max_actions=4,
    critical_threshold=3,
    prod_approval=("DisableUser", "IsolateHost", "QuarantineFile", "KillProcess",
                   "CollectForensics"),
    privileged_approval=("DisableUser", "IsolateHost"),
    critical_approval=("IsolateHost", "DisableUser", "BlockIp"),
    privileged_forbidden=("KillProcess", "QuarantineFile"),
    critical_forbidden=("KillProcess", "QuarantineFile"),
    environment_forbidden={"prod": ("KillProcess", "QuarantineFile"), "dev": ()},
)
# A policy that lets containment run, so that failures and rollbacks occur.
OPEN_CATALOG = {
    k: (v[0], False, v[2], v[3], v[4]) for k, v in K.ACTION_CATALOG.items()
}
OPEN = policy.PolicyConfig(
    risk_threshold=101, impact_threshold=101, critical_threshold=99,
    privileged_forbidden=(), privileged_approval=(),
)


def chain(spark: SparkSession, sf: str, **settings) -> Triage:
    return Triage(
        assets=X.assets(spark, sf),
        identities=X.identities(spark, sf),
        intel=X.intel(spark, sf),
        **settings,
    )


def normalized(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.normalize(X.alerts(spark, sf))


def valid(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.valid(normalized(spark, sf))


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    return chain(spark, sf).enriched(valid(spark, sf), X.now())


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return score.scenario_score(enriched(spark, sf))


def planned(spark: SparkSession, sf: str) -> DataFrame:
    return chain(spark, sf).planned(valid(spark, sf), X.now())


def decided(spark: SparkSession, sf: str) -> DataFrame:
    return chain(spark, sf).decided(valid(spark, sf), X.now())


def executed(spark: SparkSession, sf: str) -> DataFrame:
    return chain(spark, sf).executed(valid(spark, sf), X.now())


def stopped(spark: SparkSession, sf: str) -> DataFrame:
    """Real run that stops at the first failure; replies depend on the alert id."""
    ctx = execute.ExecutionContext(dry_run=False, stop_on_failure=True)
    done = chain(spark, sf, policy=OPEN, policy_catalog=OPEN_CATALOG).decided(
        valid(spark, sf), X.now()
    )
    number = F.col("alert_id").cast("bigint")
    fails = F.filter(
        F.col("plan")["actions"],
        lambda a: ((a["type"] == "IsolateHost") & (number % 5 < 3))
        | ((a["type"] == "Notify") & (number % 7 == 0)),
    )
    reply = F.map_from_entries(
        F.transform(
            fails,
            lambda a: F.struct(
                a["action_id"].alias("key"),
                F.struct(
                    F.lit(False).alias("succeeded"),
                    F.lit("refused").alias("message"),
                    F.lit(None).cast("string").alias("reference"),
                ).alias("value"),
            ),
        )
    )
    return execute.execute(done.withColumn("_reply", reply), ctx, outcomes=F.col("_reply"))


# --- normalization ----------------------------------------------------------------


@query
def normalize_alerts(spark, sf):
    e = F.col("entities")
    return valid(spark, sf).select(
        "alert_id", "siem_name", micros(F.col("ts")).alias("ts_us"), "alert_type", "rule_name",
        "severity", *[e[f].alias(f) for f in K.ENTITY_FIELDS],
    )


@query
def reject_alerts(spark, sf):
    return normalize.rejects(normalized(spark, sf)).select(
        "alert_id", "siem_name", "reject_reason"
    )


@query
def unwrap_responses(spark, sf):
    payloads = alert_source.unwrap(X.responses(spark, sf))
    raw = alert_source.build_raw(payloads, X.now())
    return raw.select(
        "alert_id", "siem_name", micros(F.col("ts")).alias("ts_us"), "rule_name", "alert_type",
        "original_severity", "next_cursor",
    )


@query
def push_headers(spark, sf):
    payloads = X.alerts(spark, sf).select(
        "payload", "siem_name", F.col("alert_id").alias("source_id")
    )
    raw = alert_source.build_raw(
        payloads, X.now(), profile="push", siem=F.nullif(F.col("siem_name"), F.lit("splunk"))
    )
    return raw.select("source_id", "siem_name", "rule_name", "alert_type", "original_severity")


@query
def page_alerts(spark, sf):
    a = X.alerts(spark, sf).select("alert_id", "ts", F.col("alert_id").cast("bigint").alias("id_no"))
    return alert_source.all_pages(a, 200, ("ts", "id_no")).select(
        "alert_id", "position", F.col("page").cast("bigint").alias("page"), "next_cursor"
    )


@query
def page_since(spark, sf):
    """The first pull from a given time on."""
    a = X.alerts(spark, sf).select("alert_id", "ts", F.col("alert_id").cast("bigint").alias("id_no"))
    since = F.lit("2024-01-02 00:00:00").cast("timestamp")
    return alert_source.page(a, since, None, 500, ("ts", "id_no")).select(
        "alert_id", "position", "next_cursor"
    )


@query
def page_cursor(spark, sf):
    """Pulls at several cursors, near the start and far behind it; all have one schema."""
    a = X.alerts(spark, sf).select("alert_id", "ts", F.col("alert_id").cast("bigint").alias("id_no"))
    pulls = [alert_source.page(a, None, c, 200, ("ts", "id_no")) for c in ("0", "200", "9900", "10000")]
    out = pulls[0]
    for p in pulls[1:]:
        out = out.union(p)
    return out.select("alert_id", "position", "next_cursor")


# --- enrichment -------------------------------------------------------------------


@query
def enrich_asset(spark, sf):
    df = enrich.asset_patch(valid(spark, sf), X.assets(spark, sf), X.now())
    p = F.col("p_asset")
    return df.select(
        "alert_id",
        p["context"]["asset_id"].alias("asset_id"),
        p["context"]["criticality"].alias("criticality"),
        p["context"]["environment"].alias("environment"),
        flat_list(p["context"]["roles"]).alias("roles"),
        flat_map(p["tags"]).alias("tags"),
        p["note"]["summary"].alias("note"),
    )


@query
def enrich_identity(spark, sf):
    df = enrich.identity_patch(valid(spark, sf), X.identities(spark, sf), X.now())
    p = F.col("p_identity")
    return df.select(
        "alert_id",
        p["context"]["user_id"].alias("user_id"),
        p["context"]["privileged"].alias("privileged"),
        p["context"]["department"].alias("department"),
        flat_list(p["context"]["groups"]).alias("groups"),
        flat_map(p["tags"]).alias("tags"),
    )


@query
def enrich_intel(spark, sf):
    df = enrich.intel_patch(valid(spark, sf), X.intel(spark, sf), X.now())
    p = F.col("p_intel")
    return df.select(
        "alert_id",
        p["context"]["reputation"].alias("reputation"),
        flat_list(p["context"]["matches"]).alias("matches"),
        flat_map(p["tags"]).alias("tags"),
    )


@query
def enrich_merged(spark, sf):
    return enriched(spark, sf).select(
        "alert_id",
        F.col("asset")["asset_id"].alias("asset_id"),
        F.col("identity")["user_id"].alias("user_id"),
        F.col("threat_intel")["reputation"].alias("reputation"),
        flat_map(F.col("tags")).alias("tags"),
        flat_list(F.transform("provenance", lambda n: n["provider"])).alias("providers"),
    )


# --- scoring ----------------------------------------------------------------------


@query
def score_scenario(spark, sf):
    a = F.col("assessment")
    first = F.get(a["recommended"], F.lit(0))
    return scored(spark, sf).select(
        "alert_id", "scenario", a["confidence"].alias("confidence"),
        a["severity"].alias("severity"), a["hypothesis"].alias("hypothesis"),
        flat_list(a["evidence"]).alias("evidence"),
        first["type"].alias("action"), flat_map(first["params"]).alias("params"),
        first["rationale"].alias("rationale"),
    )


@query
def score_rules(spark, sf):
    a = F.col("assessment")
    return score.keyword_score(valid(spark, sf)).select(
        "alert_id", a["confidence"].alias("confidence"), a["severity"].alias("severity"),
        a["hypothesis"].alias("hypothesis"), flat_list(a["evidence"]).alias("evidence"),
    )


@query
def score_fallback(spark, sf):
    """Two external score tables, the second with errors, then the keyword scorer."""
    ids = X.alerts(spark, sf).select("alert_id", F.col("alert_id").cast("bigint").alias("n"))
    model = ids.filter(F.col("n") % 3 == 0).select(
        "alert_id",
        score.assessment(F.lit(0.95), (F.col("n") % 100).cast("int"), F.lit("model"),
                         F.array(F.lit("m"))).alias("assessment"),
    )
    remote = ids.filter(F.col("n") % 5 == 0).select(
        "alert_id",
        F.lit(None).cast(score.ASSESSMENT_DDL).alias("assessment"),
        F.lit("TimeoutError").alias("error_type"),
        F.lit("too slow").alias("error_message"),
    )
    a = F.col("assessment")
    return score.with_replies(valid(spark, sf), [model, remote]).select(
        "alert_id", a["confidence"].alias("confidence"), a["severity"].alias("severity"),
        a["hypothesis"].alias("hypothesis"), flat_list(a["evidence"]).alias("evidence"),
    )


@query
def score_distinct(spark, sf):
    """Equal requests are scored once, whatever the order of their names."""
    n = F.col("alert_id").cast("bigint")
    request = F.when(
        n % 2 == 0,
        F.to_json(F.struct(F.col("rule_name").alias("ruleName"), F.col("severity"))),
    ).otherwise(F.to_json(F.struct(F.col("severity"), F.col("rule_name").alias("ruleName"))))

    def scorer(distinct: DataFrame) -> DataFrame:
        part = F.from_json("score_key", "ruleName string, severity int")
        return distinct.withColumn(
            "assessment",
            score.keyword_assessment(part["ruleName"], F.lit(None).cast("string"),
                                     part["severity"]),
        )

    a = F.col("assessment")
    return score.score_distinct(
        valid(spark, sf).withColumn("request", request), scorer
    ).select(
        "alert_id", a["confidence"].alias("confidence"), a["severity"].alias("severity"),
        a["hypothesis"].alias("hypothesis"),
    )


@query
def explanations(spark, sf):
    s = scored(spark, sf)
    return score.explain_scenario(s).select(
        "alert_id", "summary", flat_list(F.col("details")).alias("details")
    )


# --- planning ---------------------------------------------------------------------


@query
def plan_header(spark, sf):
    return ranking(plan.plan_header(scored(spark, sf)))


@query
def plan_selection(spark, sf):
    """Selected actions in selection order, before risk, checks and dedupe."""
    df = plan.select_actions(plan.plan_header(scored(spark, sf)))
    return df.select(
        "alert_id",
        flat_list(F.transform("candidates", lambda a: a["type"])).alias("types"),
        flat_list(F.transform("candidates", lambda a: a["rationale"])).alias("rationales"),
    )


def _action_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "alert_id", "seq", "action_id", "type", "risk", "impact", "reversible",
        flat_map(F.col("params")).alias("params"), "rationale",
    )


@query
def plan_actions(spark, sf):
    return _action_columns(plan.action_table(planned(spark, sf)))


@query
def plan_catalog_gaps(spark, sf):
    """Another catalog: tickets need a queue, which nobody gives, and host isolation is not in it."""
    catalog = {k: v for k, v in K.ACTION_CATALOG.items() if k != "IsolateHost"}
    catalog["OpenTicket"] = (*catalog["OpenTicket"][:4], ["queue"])
    planned = chain(spark, sf, planning=plan.PlanningContext(catalog=catalog)).planned(
        valid(spark, sf), X.now()
    )
    return _action_columns(plan.action_table(planned))


@query
def plan_rollbacks(spark, sf):
    return _action_columns(plan.action_table(planned(spark, sf), "rollback_actions"))


@query
def plan_texts(spark, sf):
    p = F.col("plan")
    return planned(spark, sf).select(
        "alert_id", p["plan_id"].alias("plan_id"), flat_list(p["rationale"]).alias("rationale"),
        flat_map(p["tags"]).alias("tags"),
    )


@query
def plan_static(spark, sf):
    df = plan.static_plan(scored(spark, sf), X.now())
    parts = F.concat(
        F.transform(F.col("plan")["actions"], lambda a: F.struct(F.lit(False).alias("undo"),
                                                                  a.alias("a"))),
        F.transform(F.col("plan")["rollback_actions"],
                    lambda a: F.struct(F.lit(True).alias("undo"), a.alias("a"))),
    )
    return df.select("alert_id", F.posexplode(parts).alias("seq", "x")).select(
        "alert_id", "seq", F.col("x.undo").alias("is_rollback"), "x.a.type", "x.a.risk",
        "x.a.impact", flat_map(F.col("x.a.params")).alias("params"), "x.a.rationale",
    )


@query
def plan_replies(spark, sf):
    """Planner replies: wrapped, bare, without a known action, and not JSON."""
    ids = X.alerts(spark, sf).select("alert_id", F.col("alert_id").cast("bigint").alias("n"))
    n = F.col("n")
    body = F.concat(
        F.lit('{"strategy":"contain","priority":"'), (n % 90).cast("string"),
        F.lit('","actions":[{"type":"blockip","parameters":{"src_ip":"9.9.9.'),
        (n % 250).cast("string"),
        F.lit('"},"risk":12,"reversible":true},{"type":"Reboot"},{"type":"9","actionId":"x'),
        n.cast("string"), F.lit('"}]}'),
    )
    reply = (
        F.when(n % 6 == 0, F.concat(F.lit('{"plan":'), body, F.lit("}")))
        .when(n % 6 == 1, body)
        .when(n % 6 == 2, F.lit('{"plan":{"strategy":"Contain","actions":[{"type":"Reboot"}]}}'))
        .when(n % 6 == 3, F.lit("no plan today"))
    )
    r = ids.select("alert_id", reply.alias("reply")).filter(F.col("reply").isNotNull())
    p = F.col("plan")
    answered = chain(spark, sf, plan_replies=r).planned(valid(spark, sf), X.now())
    return answered.select(
        "alert_id", "plan_source", p["strategy"].alias("strategy"),
        p["priority"].alias("priority"),
        flat_list(F.transform(p["actions"], lambda a: a["type"])).alias("types"),
        flat_list(F.transform(p["actions"], lambda a: a["action_id"])).alias("action_ids"),
        flat_list(F.transform(p["actions"], lambda a: a["risk"].cast("string"))).alias("risks"),
    )


@query
def extreme_values(spark, sf):
    """Priority, risk and impact for scores and criticalities far beyond their ranges."""
    n = F.col("alert_id").cast("bigint")
    case = lambda m, *v: F.get(F.array(*[F.lit(x) for x in v]), (n % m).cast("int"))
    crit = case(4, 2_000_000_000, -2_000_000_000, 3, 3)
    asset = F.struct(
        F.lit("a").alias("asset_id"), crit.alias("criticality"), F.lit("dev").alias("environment"),
        F.array().cast("array<string>").alias("roles"),
    )
    a = F.col("assessment")
    df = scored(spark, sf).withColumn(
        "assessment",
        a.withField("confidence", case(5, 1e300, -1e300, 0.0, 0.7, 0.7)).withField(
            "severity", case(3, 2_147_483_647, -2_147_483_648, 50)
        ),
    ).withColumn("asset", asset)
    free = {"Notify": (*K.ACTION_CATALOG["Notify"][:2], 0, 0, *K.ACTION_CATALOG["Notify"][4:])}
    action = A.action(F.lit("Notify"), A.empty_params(), F.lit(""), F.lit(0), F.lit(0), F.lit(False))
    rated = plan.estimate(action, free, a["confidence"], crit, F.lit(False))
    return plan.plan_header(df).select(
        "alert_id", "priority", rated["risk"].alias("risk_part"), rated["impact"].alias("impact_part")
    )


# --- policy -----------------------------------------------------------------------


def _decision_columns(df: DataFrame) -> DataFrame:
    return policy.decision_table(df).select(
        "alert_id", "seq", "type", "status", flat_list(F.col("reasons")).alias("reasons")
    )


@query
def policy_actions(spark, sf):
    return _decision_columns(decided(spark, sf))


@query
def policy_strict(spark, sf):
    ctx = plan.PlanningContext(environment="prod")
    t = chain(spark, sf, planning=ctx, policy=STRICT)
    return _decision_columns(t.decided(valid(spark, sf), X.now()))


@query
def policy_counts(spark, sf):
    return policy.policy_counts(decided(spark, sf)).select(
        "alert_id", "approved", "pending", "denied",
        flat_list(F.col("policy_notes")).alias("notes"),
    )


def _pending(spark, sf) -> DataFrame:
    return approvals.pending_actions(decided(spark, sf)).withColumn(
        "alert_no", F.col("alert_id").cast("bigint")
    )


def _pinned_pending(spark, sf) -> DataFrame:
    """Pending actions, computed once because requests, decisions and actions all read them."""
    ensure_checkpoint_dir(spark)
    return (
        _pending(spark, sf)
        .select("alert_id", "alert_no", "ts", "plan_id", "seq", "action_id", "type", "risk",
                "impact", "params", "rationale")
        .checkpoint()
    )


def _requests(pending: DataFrame) -> DataFrame:
    return approvals.requests(pending, ("ts", "alert_no", "seq"))


def _state(pending: DataFrame) -> DataFrame:
    """Every pending action's alert doubles as a decision on it, two out of three times."""
    n = F.col("alert_no")
    made = pending.filter(n % 3 != 2).select(
        "action_id",
        F.col("ts").alias("decided_at"),
        n.alias("event_id"),
        (n % 3 == 0).alias("approve"),
    )
    return approvals.approval_state(_requests(pending), made)


@query
def approval_requests(spark, sf):
    return _requests(_pending(spark, sf)).select(
        "action_id", "alert_id", "type", "risk", "impact", F.col("params_text").alias("params"),
        "reason", "status", micros(F.col("requested_at")).alias("requested_us"),
    )


@query
def approval_state(spark, sf):
    return _state(_pinned_pending(spark, sf)).select("action_id", "type", "status")


@query
def approved_actions(spark, sf):
    pending = _pinned_pending(spark, sf)
    return approvals.approved_actions(pending, _state(pending)).select(
        "alert_id", "seq", "action_id", "type"
    )


# --- execution --------------------------------------------------------------------


def _result_columns(df: DataFrame) -> DataFrame:
    return execute.result_table(df).select(
        "alert_id", "seq", "action_id", "type", "status", "executor", "message", "reference",
        "is_rollback", "original_action_id",
    )


@query
def execute_dry_run(spark, sf):
    return _result_columns(executed(spark, sf))


@query
def execute_stop(spark, sf):
    return _result_columns(stopped(spark, sf)).filter(~F.col("is_rollback")).drop(
        "original_action_id", "is_rollback"
    )


@query
def rollback_results(spark, sf):
    rows = stopped(spark, sf).select(
        "alert_id", flat_list(F.col("execution_notes")).alias("notes"),
        F.posexplode("rollback_results").alias("seq", "r"),
    )
    return rows.select(
        "alert_id", "notes", "seq", "r.action_id", "r.type", "r.status", "r.executor",
        "r.message", "r.reference", "r.original_action_id",
    )


@query
def execution_counts(spark, sf):
    return execute.execution_counts(stopped(spark, sf)).drop("plan_id")


@query
def outbox(spark, sf):
    done = chain(spark, sf, policy=OPEN, policy_catalog=OPEN_CATALOG).decided(
        valid(spark, sf), X.now()
    )
    return execute.outbox(done).drop("plan_id")


@query
def ack_updates(spark, sf):
    return execute.acknowledgements(
        executed(spark, sf), normalize.rejects(normalized(spark, sf))
    )


@query
def approved_execution(spark, sf):
    """The plans once more, after the approvals: granted actions run."""
    state = _state(_pinned_pending(spark, sf))
    granted = approvals.apply_approvals(decided(spark, sf), state)
    return execute.result_table(execute.execute(granted)).select(
        "alert_id", "seq", "action_id", "type", "status", "executor", "message"
    )


# --- audit, reports, cases --------------------------------------------------------


@query
def audit_events(spark, sf):
    """Every audit entry of the run, with its message and the main facts of its data."""
    n = normalized(spark, sf)
    t = chain(spark, sf)
    e = t.events(executed(spark, sf), normalize.rejects(n), X.now())
    names = {
        "planId": "plan_id", "actionId": "action_id", "actionType": "action_type", "status": "status",
        "executor": "executor", "total": "total", "failed": "failed", "skipped": "skipped",
        "dryRunCount": "dry_run", "approved": "approved", "pending": "pending", "denied": "denied",
    }
    fact = lambda k: F.try_element_at(F.col("data"), F.lit(k))
    return e.select("component", "event_type", "message", *[fact(k).alias(v) for k, v in names.items()])


@query
def audit_report(spark, sf):
    return audit.report(X.audit_entries(spark, sf)).select(
        "total_events", "action_executions", "failures", flat_list(F.col("summary")).alias("lines")
    )


@query
def audit_recent(spark, sf):
    """Reports of one correlation id and of the ten minutes before a given time."""
    e = X.audit_entries(spark, sf)
    upto = F.lit("2024-01-02 00:00:00").cast("timestamp")
    recent = audit.report(e, from_ts=upto - F.expr("INTERVAL 10 MINUTES"), to_ts=upto)
    one = audit.report(e, correlation="c7")
    keep = ["total_events", "action_executions", "failures"]
    return recent.select(F.lit("recent").alias("what"), *keep).unionByName(
        one.select(F.lit("one").alias("what"), *keep)
    )


@query
def cycle_report(spark, sf):
    """One cycle over all alerts; the cursor is that of the first pull."""
    pull = alert_source.page(X.alerts(spark, sf).select("alert_id", "ts"), limit=200)
    cursor = alert_source.next_pull(pull, X.now(), X.now()).first()["next_cursor"]
    return chain(spark, sf).cycle(X.alerts(spark, sf), X.now(), cursor)


@query
def scenario_report(spark, sf):
    df = report.scenario_report(executed(spark, sf))
    return df.withColumn("is_total", F.col("is_total").cast("int"))


@query
def case_state(spark, sf):
    return cases.case_state(X.case_events(spark, sf)).select(
        "case_id", "summary", "severity", "alert_key", "status",
        micros(F.col("created_at")).alias("created_us"),
        micros(F.col("updated_at")).alias("updated_us"),
    )


@query
def case_evidence(spark, sf):
    return cases.case_evidence(X.case_events(spark, sf)).select(
        "case_id", "seq", micros(F.col("ts")).alias("ts_us"), "description"
    )


@query
def case_event_log(spark, sf):
    return cases.event_log(X.case_events(spark, sf)).select(
        "case_id", "seq", "event_type", "message"
    )


@query
def case_openings(spark, sf):
    return cases.open_events(decided(spark, sf), X.now()).select(
        "case_id", "summary", "severity", "alert_key"
    )


@query
def pull_failure_events(spark, sf):
    e = X.table(spark, sf, "events")
    i = F.col("event_id")
    pulls = e.select(
        F.when(i % 2 == 0, i.cast("string")).alias("cursor"),
        F.when(i % 3 == 0, F.col("ts").cast("timestamp")).alias("since"),
        F.concat(F.lit("timeout "), i.cast("string")).alias("error"),
    )
    d = F.col("data")
    return audit.pull_failures(pulls, X.now()).select(
        "component", "event_type", "message", F.try_element_at(d, F.lit("cursor")).alias("cursor"),
        F.try_element_at(d, F.lit("sinceUtc")).alias("since_utc"),
    )


@query
def audit_ids(spark, sf):
    """The audit table as it is written: blank ids become hashes of the entries."""
    e = X.audit_entries(spark, sf).drop("data").withColumn("data", F.create_map(F.lit("k"), F.col("correlation_id")))
    number = F.substring("entry_id", 2, 20).cast("bigint")
    blank = F.when(number % 3 == 0, F.lit(" ")).when(number % 3 == 1, F.col("entry_id"))
    whole = e.withColumn("event_no", number).withColumn("entry_id", blank).withColumn("ts", X.now())
    return sinks.with_entry_ids(whole).select("event_no", "entry_id")


# --- files, as the readers parse them ----------------------------------------------


@query
def log_files(spark, sf):
    """A log file per document: an array, an object, lines, a scalar, and plain text."""
    d = X.table(spark, sf, "documents")
    i = F.col("doc_id")
    n = i.cast("string")
    value = (
        F.when(i % 5 == 0, F.concat(F.lit('[{"id":'), n, F.lit('},{"t":"x"}]')))
        .when(i % 5 == 1, F.concat(F.lit('{"id":'), n, F.lit("}")))
        .when(i % 5 == 2, F.concat(F.lit('{"id":'), n, F.lit('}\n\nbroken {\n{"b":2}\n')))
        .when(i % 5 == 3, n)
        .otherwise(F.concat(F.lit("x "), F.regexp_replace("text", "\n", "\nx ")))
    )
    return readers.parse_log_files(d.select(n.alias("path"), value.alias("value"))).select(
        "path", "pos", F.md5("document").alias("document_md5"), "error"
    )


def _files(df: DataFrame, key: str, **fields: Column) -> DataFrame:
    """One file for each row: a JSON array with one object."""
    body = F.to_json(F.array(F.struct(*[c.alias(n) for n, c in fields.items()])))
    return df.select(F.col(key).alias("file_no"), body.alias("value"))


@query
def asset_files(spark, sf):
    a = X.assets(spark, sf)
    files = _files(
        a, "pos", hostId=F.col("host_id"), HOSTNAME=F.col("hostname"), ip=F.col("ip"), environment=F.col("environment"),
        criticality=F.when(F.col("pos") % 3 != 0, F.col("criticality").cast("string")).otherwise("high"),
        owner=F.col("owner"), Team=F.col("team"),
    )
    return readers.parse_assets(files).drop("pos")


@query
def identity_files(spark, sf):
    i = X.identities(spark, sf)
    files = _files(
        i, "pos", userId=F.col("user_id"), username=F.col("username"), privileged=F.col("privileged"),
        department=F.col("department"), isserviceaccount=F.col("is_service_account"),
    )
    return readers.parse_identities(files).drop("pos")


@query
def intel_files(spark, sf):
    t = X.intel(spark, sf)
    files = _files(
        t, "pos", srcIp=F.col("src_ip"), fileHash=F.col("file_hash"), reputationScore=F.col("reputation"),
        source=F.col("source"), tags=F.col("tags"),
    )
    return readers.parse_intel(files).withColumn("tags", flat_list(F.col("tags"))).drop("pos")


@query
def audit_lines(spark, sf):
    """Audit lines: good ones, a cut one, a blank one, and one without a time."""
    e = X.table(spark, sf, "events")
    i = F.col("event_id")
    n = i.cast("string")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    good = F.to_json(
        F.struct(
            F.concat(F.lit("e"), n).alias("entryId"),
            F.when(i % 7 != 0, stamp).alias("timestampUtc"),
            F.lit("c").alias("correlationId"),
            F.col("event_type").alias("eventType"),
            F.create_map(F.lit("status"), F.lit("Failed")).alias("data"),
        )
    )
    value = F.when(i % 5 == 0, F.concat(F.lit('{"entryId":"'), n)).when(i % 5 == 1, F.lit("  ")).otherwise(good)
    return readers.parse_audit(e.select(value.alias("value"))).select(
        "entry_id", micros(F.col("ts")).alias("ts_us"), "event_type", flat_map(F.col("data")).alias("data")
    )


@query
def annotation_files(spark, sf):
    a = X.annotated(spark, sf)
    files = _files(
        a, "dataset_id", dataset_id=F.col("dataset_id"), detection_goal=F.col("detection_goal"),
        completion=F.col("completion"), rule_xml=F.col("rule_xml"),
    )
    return readers.parse_annotations(files.drop("file_no")).drop("pos")


@query
def knowledge_lines(spark, sf):
    e = X.entries(spark, sf)
    i = F.col("pos")
    body = F.to_json(
        F.struct(
            F.when(i % 3 != 0, F.col("title")).alias("title"),
            F.when(i % 4 != 0, F.col("content")).alias("content"),
            F.when(i % 5 != 0, F.col("tags")).alias("tags"),
        )
    )
    lines = e.select(i.alias("line_no"), body.alias("value"))
    return readers.parse_knowledge(lines).select(
        "line_no", "title", F.md5("content").alias("content_md5"), flat_list(F.col("tags")).alias("tags"),
        F.size("commands").alias("n_commands"),
    )


@query
def rejected_bodies(spark, sf):
    e = X.table(spark, sf, "events")
    i = F.col("event_id")
    body = F.when(i % 3 == 0, F.lit(" \t")).when(i % 3 == 1, F.lit('{"a":')).otherwise(F.lit('{"a":1}'))
    return alert_source.unreadable(e.select("event_id", body.alias("document"))).select(
        "event_id", "reject_reason"
    )


@query
def scorer_replies(spark, sf):
    """Scorer replies: an object in prose, an empty one, none, and values out of range."""
    n = F.col("alert_id").cast("bigint")
    reply = (
        F.when(n % 4 == 0, F.concat(F.lit('sure: {"confidence":0.8,"severity":'), (n % 100).cast("string"),
                                    F.lit(',"hypothesis":"h","evidence":["e","f"]} done')))
        .when(n % 4 == 1, F.lit("{}"))
        .when(n % 4 == 2, F.lit("no object"))
        .otherwise(F.lit('{"confidence":1e300,"severity":2147483647}'))
    )
    a = F.col("assessment")
    read = X.alerts(spark, sf).select("alert_id", replies.decode_assessment(reply).alias("assessment"))
    read = read.filter(a.isNotNull())
    return score.explain(read).withColumn("details", flat_list(F.col("details"))).join(
        read.select("alert_id", a["confidence"].alias("confidence"), a["severity"].alias("severity")), "alert_id"
    )


# --- dataset and heuristics -------------------------------------------------------

DOC_FIELDS = ["text", "lang", "source", "meta", "even", "meta.n"]


def _doc_rows(spark, sf) -> DataFrame:
    return dataset.project_rows(X.documents_as_logs(spark, sf), DOC_FIELDS, keep=("doc_id",))


@query
def dataset_rows(spark, sf):
    return _doc_rows(spark, sf).select(
        "doc_id", F.md5("text").alias("text_md5"), "lang", "source", "meta", "even",
        F.col("`meta.n`").alias("dotted"),
    )


@query
def dataset_file(spark, sf):
    """All documents as one CSV dataset, written and read again by the splits of its files."""
    ensure_checkpoint_dir(spark)
    d = X.table(spark, sf, "documents")
    rows = d.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang")
    path = f"{spark.sparkContext.getCheckpointDir()}/dataset-file-{uuid.uuid4().hex}"
    sinks.write_csv(rows, path, "errorifexists")
    return readers.read_dataset(spark, path).select("doc_id", F.md5("text").alias("text_md5"), "lang")


@query
def dataset_append(spark, sf):
    """Rows with an even source number are stored; all rows arrive."""
    rows = _doc_rows(spark, sf)
    stored = rows.filter(F.col("doc_id") % 2 == 0)
    return dataset.new_rows(stored, rows, ["text", "missing"], ["doc_id"]).select(
        "doc_id", "lang", "source", F.md5("text").alias("text_md5")
    )


@query
def dataset_statistics(spark, sf):
    """What an ingest of all rows into the stored half reports."""
    rows = _doc_rows(spark, sf)
    stored = rows.filter(F.col("doc_id") % 2 == 0)
    return sinks.ingest_statistics(stored, rows, ["text"], ["doc_id"])


@query
def dataset_dedupe(spark, sf):
    return dataset.deduplicate(_doc_rows(spark, sf), ["text"], ["doc_id"]).select(
        "doc_id", "lang", "source", F.md5("text").alias("text_md5")
    )


@query
def dataset_duplicates(spark, sf):
    return dataset.duplicate_count(_doc_rows(spark, sf), ["text"])


def _hits(spark, sf, limit: int = 0) -> DataFrame:
    return heuristics.matches(X.logs(spark, sf), X.LOG_ORDER, limit)


@query
def heuristic_candidates(spark, sf):
    return heuristics.candidates(_hits(spark, sf), X.LOG_ORDER).drop("ts", "event_id")


@query
def heuristic_first(spark, sf):
    """The first twenty hits per heuristic."""
    return heuristics.candidates(_hits(spark, sf, 20), X.LOG_ORDER).select(
        "dataset_id", "heuristic", "severity"
    )


@query
def heuristic_counts(spark, sf):
    return heuristics.candidate_counts(_hits(spark, sf))


@query
def response_plans(spark, sf):
    return heuristics.response_plans(_hits(spark, sf), X.LOG_ORDER).select(
        "dataset_id", "heuristic", "host", "ip", "rule_id", "rule_description", "severity",
        "log_excerpt", flat_list(F.col("actions")).alias("actions"),
    )


@query
def ip_change(spark, sf):
    return heuristics.ip_changes(X.logs(spark, sf), X.LOG_ORDER).select(
        "id", "agent_key", "previous_ip", "agent_ip"
    )


# --- training texts ---------------------------------------------------------------


@query
def training_pairs(spark, sf):
    return training.training_pairs(
        X.annotated(spark, sf), X.document_rows(spark, sf), strict=False
    ).select("dataset_id", F.md5("prompt").alias("prompt_md5"), "completion")


@query
def annotations_missing(spark, sf):
    """Annotations whose row is not in the dataset: every fifth label once more, by another id."""
    known = X.annotated(spark, sf)
    number = F.col("dataset_id").cast("bigint")
    strange = known.filter(number % 5 == 0).withColumn(
        "dataset_id", (number + 1_000_000_000).cast("string")
    )
    rows = X.document_rows(spark, sf)
    return training.missing_annotations(known.unionByName(strange), rows).select("dataset_id")


@query
def training_text(spark, sf):
    c = X.table(spark, sf, "conversations")
    ex = c.select(
        "conv_id", "turn",
        F.when(F.col("role") == "user", F.col("text")).otherwise(F.lit("")).alias("prompt"),
        F.when(F.col("turn") % 3 == 0, F.lit(" goal ")).alias("detection_goal"),
        F.when(F.col("role") != "user", F.col("text")).alias("completion"),
    )
    return training.training_text(ex).select("conv_id", "turn", F.md5("text").alias("text_md5"))


@query
def log_extracts(spark, sf):
    return training.log_extracts(X.annotated(spark, sf), X.document_rows(spark, sf)).select(
        "dataset_id", "id", "timestamp", "rule", "agent", "location",
        F.md5("full_log").alias("log_md5"), F.length("full_log").alias("log_chars"),
    )


# --- requests and knowledge -------------------------------------------------------


@query
def request_table(spark, sf):
    return replies.score_requests(enriched(spark, sf)).select("alert_id", "request")


@query
def score_prompts(spark, sf):
    return replies.score_requests(enriched(spark, sf)).select("alert_id", F.md5("prompt").alias("prompt_md5"))


@query
def plan_request_table(spark, sf):
    """Payload and prompt of the planner for every alert."""
    return replies.plan_requests(scored(spark, sf), X.now()).select(
        "alert_id", "request", F.md5("prompt").alias("prompt_md5")
    )


@query
def rule_request_table(spark, sf):
    """Rule-generation payloads; goals are the conversation texts, some with examples."""
    c = X.table(spark, sf, "conversations")
    goals = c.select(
        "conv_id", "turn", F.col("text").alias("detection_goal"),
        F.when(F.col("turn") % 2 == 0, F.col("role")).alias("example_events"),
        F.when(F.col("conv_id") % 3 == 0, F.lit('<rule id="1">\n</rule>')).alias("existing_rules"),
    )
    return replies.rule_requests(goals).select("conv_id", "turn", F.md5("request").alias("request_md5"))


@query
def reply_objects(spark, sf):
    """Replies around conversation texts: an object in prose, broken JSON, plain text."""
    c = X.table(spark, sf, "conversations")
    n = F.col("conv_id") + F.col("turn")
    plain = F.regexp_replace("text", "[{}]", "")
    reply = (
        F.when(n % 3 == 0, F.concat(plain, F.lit(' {"severity": 7, "note": {"a": 1}} '), plain))
        .when(n % 3 == 1, F.concat(plain, F.lit(' {"severity": 7 } and {"b": 2}')))
        .otherwise(plain)
    )
    return c.select(
        "conv_id", "turn",
        replies.extract_object(reply).alias("found"),
        F.md5(F.get_json_object(replies.rule_reply(reply), "$.message")).alias("message_md5"),
    )


@query
def knowledge_search(spark, sf):
    return knowledge.search(X.topics(spark, sf), X.entries(spark, sf), 5).select(
        "query_id", "pos", F.col("score").cast("int").alias("score"),
        F.col("rank").cast("int").alias("rank"),
    )


@query
def runbooks(spark, sf):
    item = F.col("query_id")
    t = X.topics(spark, sf).withColumn(
        "threat",
        F.when(
            item % 4 == 1,
            F.struct(
                (item % 10).cast("int").alias("severity"),
                F.when(item % 8 == 1, F.lit("bad login")).alias("description"),
                F.when(item % 3 == 0, F.array(F.lit(" stop it "), F.lit(" ")))
                .otherwise(F.array().cast("array<string>")).alias("commands"),
            ),
        ),
    )
    return knowledge.runbooks(t, X.entries(spark, sf)).select(
        "query_id", "language", flat_list(F.col("commands")).alias("commands"),
        flat_list(F.col("entries")).alias("entries"), F.md5("script_text").alias("script_md5"),
    )


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Which alerts come first and what to do about them, over all alerts."""
    return QUERIES["plan_header"](spark, sf)


# --- streams and tables kept over batches ------------------------------------------------


def _new_folder(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _parts(rows: DataFrame, column: str, n: int = 3) -> list[DataFrame]:
    """All rows in ``n`` ranges of a column; nulls are in the first."""
    number = F.col(column).cast("long")
    marks = rows.select(number.alias("v")).approxQuantile("v", [i / n for i in range(1, n)], 0.01)
    place = F.coalesce(sum((number >= F.lit(m)).cast("int") for m in marks), F.lit(0))
    return [rows.filter(place == i) for i in range(n)]


def _arriving(parts: list[DataFrame], folder: str, run: Callable[[DataFrame], object]) -> None:
    """Land one part after the other; the stream runs after each until it has read it."""
    for part in parts:
        part.write.mode("append").parquet(folder)
        run(part.sparkSession.readStream.schema(part.schema).parquet(folder)).awaitTermination()


@query
def stream_cycles(spark, sf):
    """Counters of all cycles of the alert stream, half of the landed files in each."""
    root = _new_folder(spark, "stream-cycles")
    X.alerts(spark, sf).write.json(f"{root}/landed")
    # A file for each task, as two files would be all alerts in two tasks.
    half = -(-X.cores(spark) // 2)
    source = triage_stream.read_alert_stream(spark, f"{root}/landed", max_files=half)
    triage_stream.start(source, chain(spark, sf), root, f"{root}/checkpoint", 0, X.now).awaitTermination()
    counters = [f.name for f in spark.read.parquet(f"{root}/cycles").schema if f.name not in ("batch_id", "next_cursor")]
    return spark.read.parquet(f"{root}/cycles").agg(*[F.sum(c).alias(c) for c in counters])


@query
def stream_cases(spark, sf):
    """Current cases of events that arrive in an order unlike that of their times."""
    events, root = X.case_events(spark, sf), _new_folder(spark, "stream-cases")
    table = CaseTable(spark, f"{root}/cases", events.schema)
    mixed = [events.filter(F.pmod("seq", F.lit(3)) == i) for i in range(3)]

    def run(stream: DataFrame):
        writer = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
        return writer.foreachBatch(lambda df, batch_id: table.add(df, batch_id)).start()

    _arriving(mixed, f"{root}/landed", run)
    return table.current().select(
        "case_id", "summary", "severity", "alert_key", "status",
        micros(F.col("created_at")).alias("created_us"),
        micros(F.col("updated_at")).alias("updated_us"),
    )


@query
def stream_addresses(spark, sf):
    """Address changes of logs that arrive in order of time, over several runs of the stream."""
    root = _new_folder(spark, "stream-addresses")
    _arriving(
        _parts(X.logs(spark, sf), "ts"), f"{root}/landed",
        lambda stream: stateful.address_stream(stream, root, f"{root}/checkpoint"),
    )
    return spark.read.parquet(f"{root}/address-changes").select("id", "agent_key", "previous_ip", "agent_ip")


@query
def stream_dataset(spark, sf):
    """Rows new to a stored dataset, over several runs of the stream."""
    root = _new_folder(spark, "stream-dataset")
    _arriving(
        _parts(_doc_rows(spark, sf), "doc_id"), f"{root}/landed",
        lambda stream: stateful.append_stream(stream, root, f"{root}/checkpoint", ["text"], ["doc_id"]),
    )
    return spark.read.parquet(f"{root}/dataset").select(
        "doc_id", "lang", "source", F.md5("text").alias("text_md5")
    )


@query
def dataset_commits(spark, sf):
    """A CSV dataset of all documents by committed appends, each of them tried twice."""
    path, fields = _new_folder(spark, "dataset-commits"), ["doc_id", "text", "lang"]
    rows = X.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), "text", "lang", F.col("doc_id").alias("doc_no")
    )
    for i, part in enumerate(_parts(rows, "doc_no")):
        for _ in range(2):
            sinks.append_dataset(spark, part, path, fields, ["text"], ["doc_no"], batch=f"part {i}")
    return readers.read_dataset(spark, path).select("doc_id", F.md5("text").alias("text_md5"), "lang")
