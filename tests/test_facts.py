"""The documented behaviours of the alert chain, on literal rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from alertweave.operators import approvals, audit, cases, enrich, execute, normalize, plan, policy
from alertweave.operators import score
from alertweave.sources.alerts import RAW_SCHEMA, build_raw, page, unwrap

TS = dt.datetime(2024, 1, 1)
ENTITIES = ["hostname", "host_id", "username", "user_id", "src_ip"]


def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def raw(spark, *rows):
    base = dict(siem_name="wazuh", ts=TS, rule_name="rule", alert_type="type",
                original_severity=None, payload="{}")
    data = [tuple({**base, **r}.get(f.name) for f in RAW_SCHEMA.fields) for r in rows]
    return spark.createDataFrame(data, RAW_SCHEMA)


def enriched(spark, entities, crit=None, priv=None, conf=0.9, sev=80, rec=None, alert_id="a1"):
    """One scored alert."""
    df = raw(spark, dict(alert_id=alert_id, siem_name="simulator", payload=json.dumps(entities)))
    out = enrich.enrich(normalize.valid(normalize.normalize(df).withColumn(
        "reject_reason", F.lit(None).cast("string"))), now())
    if crit is not None:
        out = out.withColumn("asset", F.struct(
            F.lit("x").alias("asset_id"), F.lit(crit).alias("criticality"),
            F.lit("dev").alias("environment"), F.array(F.lit("r")).alias("roles")))
    if priv is not None:
        out = out.withColumn("identity", F.struct(
            F.lit("u").alias("user_id"), F.lit(priv).alias("privileged"),
            F.lit("d").alias("department"), F.lit(None).cast("array<string>").alias("groups")))
    recommended = None
    if rec:
        recommended = F.array(*[F.struct(F.lit(t).alias("type"), p.alias("params"),
                                         F.lit("why").alias("rationale")) for t, p in rec])
    return out.withColumn("assessment", score.assessment(
        F.lit(conf), F.lit(sev), F.lit("h"), F.array(F.lit("e")), recommended))


def empty_map():
    return F.create_map().cast("map<string,string>")


def the_plan(df, ctx=None):
    return plan.plan(df, ctx).select("plan").first()["plan"]


def types(actions):
    return [a["type"] for a in actions]


# --- normalization ----------------------------------------------------------------


def norm(spark, **row):
    return normalize.normalize(raw(spark, {"alert_id": "a1", **row})).first()


def test_valid_alert_passes_and_entityless_is_rejected(spark):
    ok = norm(spark, payload='{"agent":{"name":"host"},"data":{"srcip":"1.2.3.4"}}')
    assert ok["reject_reason"] is None and ok["entities"]["src_ip"] == "1.2.3.4"
    bad = norm(spark, payload='{"data":{"domain":"d","hash":"h"}}')
    assert bad["reject_reason"].endswith("At least one entity must be present (host/user/ip).")
    both = norm(spark, alert_id="  \t", payload="{}")
    assert both["reject_reason"] == (
        "NormalizedAlert validation failed: AlertId is required.; "
        "At least one entity must be present (host/user/ip)."
    )


def test_profiles_are_dispatched_by_source(spark):
    assert norm(spark, siem_name="Simulator")["reject_reason"].startswith("No mapper")
    assert norm(spark, siem_name="WaZuH", payload='{"hostname":"h"}')["reject_reason"] is None


@pytest.mark.parametrize(
    "payload,field,value",
    [
        ('{"DATA":{"SrcIp":"1"},"srcip":"2"}', "src_ip", "1"),
        ('{"data":{"src_ip":null,"srcip":null},"agent":{"ip":"9"}}', "src_ip", ""),
        ('{"agent":{"ip":"9"}}', "src_ip", "9"),
        ('{"data":{"user":{"a":1}}}', "username", '{"a":1}'),
        ('{"data":"text","hostname":"h"}', "hostname", "h"),
        ('{"agent":{"Name":"x","name":"y"}}', "hostname", "x"),
        ("not json", "hostname", None),
    ],
)
def test_nested_paths(spark, payload, field, value):
    assert norm(spark, payload=payload)["entities"][field] == value


def test_flat_profile_takes_the_last_spelling(spark):
    row = norm(spark, siem_name="simulator", payload='{"Src_Ip":"1","src_ip":"2","username":null}',
               original_severity=120)
    assert row["entities"]["src_ip"] == "2"
    assert row["entities"]["username"] == ""
    assert row["severity"] == 120


@pytest.mark.parametrize(
    "original,level,expected",
    [(0, 3, 0), (-4, 3, 0), (1, 3, 7), (15, 3, 100), (16, 3, 16), (120, 3, 100), (None, '"7"', 47),
     (None, '"7.5"', 50), (None, "null", 50)],
)
def test_severity(spark, original, level, expected):
    row = norm(spark, original_severity=original, payload='{"rule":{"level":%s}}' % level)
    assert row["severity"] == expected


def test_patch_merges_and_later_tag_wins(spark):
    row = spark.range(1).select(
        enrich.merge_tags(
            F.create_map(F.lit("a"), F.lit("1"), F.lit("A"), F.lit("2")),
            F.create_map(F.lit("a"), F.lit("3")),
        ).alias("t"),
        enrich.merge_tags(F.lit(None).cast("map<string,string>"),
                          F.create_map(F.lit("b"), F.lit("4"))).alias("u"),
    ).first()
    assert row["t"] == {"a": "3", "A": "2"} and row["u"] == {"b": "4"}


def test_earliest_asset_wins_over_better_key(spark):
    assets = spark.createDataFrame(
        [(0, None, None, "1.1.1.1", 1, "dev", "o", None), (1, "H1", "n", None, 5, "prod", " ", "t")],
        "pos int, host_id string, hostname string, ip string, criticality int, environment string,"
        " owner string, team string",
    )
    df = normalize.valid(normalize.normalize(raw(
        spark,
        dict(alert_id="1", payload='{"agent":{"id":"h1"},"data":{"srcip":"1.1.1.1"}}'),
        dict(alert_id="2", payload='{"agent":{"id":"h1"}}'),
        dict(alert_id="3", payload='{"agent":{"id":"zz"}}'),
    )))
    rows = {r["alert_id"]: r for r in enrich.enrich(df, now(), assets).collect()}
    assert rows["1"]["asset"]["asset_id"] == "unknown" and rows["1"]["asset"]["criticality"] == 1
    assert rows["2"]["asset"]["roles"] == ["t"] and rows["2"]["tags"]["asset_owner"] == " "
    assert rows["3"]["asset"] is None and rows["3"]["provenance"] == []


# --- planning ---------------------------------------------------------------------


def test_low_confidence_opens_one_ticket(spark):
    p = the_plan(enriched(spark, {"src_ip": "1.2.3.4"}, conf=0.1, sev=30))
    assert p["strategy"] == "ObserveMore" and types(p["actions"]) == ["OpenTicket"]
    assert p["actions"][0]["action_id"] == "924c58321ca6edb5"


def test_contain_blocks_ip(spark):
    p = the_plan(enriched(spark, {"src_ip": "1.2.3.4"}))
    assert p["strategy"] == "ContainAndCollect" and "BlockIp" in types(p["actions"])


def test_critical_asset_escalates(spark):
    p = the_plan(enriched(spark, {"src_ip": "1.2.3.4"}, crit=5, conf=0.5, sev=60))
    assert p["strategy"] == "EscalateToHuman"
    assert types(p["actions"]) == ["OpenTicket", "Notify"]


def test_three_rollbacks_in_reverse(spark):
    p = the_plan(enriched(spark, {"src_ip": "1.2.3.4", "hostname": "h", "username": "u"}))
    assert types(p["rollback_actions"]) == ["UnisolateHost", "EnableUser", "UnblockIp"]


def test_no_entities_no_containment(spark):
    p = the_plan(enriched(spark, {}))
    assert types(p["actions"]) == ["OpenTicket", "CollectForensics"]


def test_recommendation_without_parameters_is_dropped(spark):
    df = enriched(spark, {"src_ip": "1.2.3.4"}, conf=0.1, rec=[("BlockIp", empty_map())])
    assert types(the_plan(df)["actions"]) == ["OpenTicket"]


def test_first_of_equal_actions_is_kept(spark):
    block = F.create_map(F.lit("src_ip"), F.lit("1.2.3.4"))
    p = the_plan(enriched(spark, {"src_ip": "1.2.3.4"}, rec=[("BlockIp", block)]))
    assert [a["rationale"] for a in p["actions"] if a["type"] == "BlockIp"] == [
        "Block suspicious source IP."
    ]


def test_empty_catalog_keeps_action_at_worst_risk(spark):
    ctx = plan.PlanningContext(catalog={})
    p = the_plan(enriched(spark, {}, conf=0.1), ctx)
    assert [(a["type"], a["risk"], a["impact"]) for a in p["actions"]] == [("OpenTicket", 100, 100)]


@pytest.mark.parametrize("conf,sev,want", [(0.3, 10, "NotifyOnly"), (0.6, 50, "Contain"),
                                           (0.85, 70, "ContainAndCollect"), (0.85, 69, "Contain")])
def test_strategy_borders(spark, conf, sev, want):
    assert the_plan(enriched(spark, {"src_ip": "1"}, conf=conf, sev=sev))["strategy"] == want


# --- policy -----------------------------------------------------------------------


def decisions(df, **kw):
    return {d["type"]: d for d in policy.evaluate(df, **kw).first()["decisions"]}


def test_unknown_type_is_denied_by_policy_catalog(spark):
    d = decisions(plan.plan(enriched(spark, {}, conf=0.1)), catalog={})
    assert d["OpenTicket"]["status"] == "Denied"
    assert d["OpenTicket"]["reasons"] == ["Unknown or unsupported action type."]


def test_risk_at_threshold_is_pending(spark):
    df = plan.plan(enriched(spark, {"hostname": "h"}, conf=1.0))
    d = decisions(df)["IsolateHost"]
    assert d["status"] == "PendingApproval"
    assert "Risk 70 exceeds approval threshold 70." in d["reasons"]


def test_point_six_is_below_the_single_precision_minimum(spark):
    d = decisions(plan.plan(enriched(spark, {"src_ip": "1"}, conf=0.6, sev=50)))
    assert d["BlockIp"]["status"] == "Denied" and d["OpenTicket"]["status"] == "Approved"
    assert d["BlockIp"]["reasons"] == [
        "Confidence 0.60 below minimum 0.60 for autonomous action 'BlockIp'."
    ]


def test_cap_denies_all_and_asks_nothing(spark):
    df = plan.plan(enriched(spark, {"src_ip": "1", "hostname": "h"}))
    out = policy.evaluate(df, config=policy.PolicyConfig(max_actions=3))
    assert {d["status"] for d in out.first()["decisions"]} == {"Denied"}
    assert approvals.pending_actions(out).count() == 0


# --- execution --------------------------------------------------------------------


def run(df, ctx, catalog=None, outcomes=None, executors=None):
    done = policy.evaluate(df, catalog=catalog, config=policy.PolicyConfig(
        risk_threshold=101, impact_threshold=101, privileged_forbidden=()))
    if outcomes is not None:
        done = done.withColumn("_o", outcomes)
        return execute.execute(done, ctx, executors, F.col("_o")).first()
    return execute.execute(done, ctx, executors).first()


def open_catalog():
    return {k: (v[0], False, *v[2:]) for k, v in policy.K.ACTION_CATALOG.items()}


def test_dry_run_and_skipped(spark):
    row = run(plan.plan(enriched(spark, {"src_ip": "1"})), execute.ExecutionContext())
    by = {r["type"]: r for r in row["results"]}
    assert by["OpenTicket"]["status"] == "DryRun"
    assert by["BlockIp"]["message"] == "Policy pending approval."


def test_no_executor_fails(spark):
    row = run(plan.plan(enriched(spark, {})), execute.ExecutionContext(dry_run=False),
              open_catalog())
    by = {r["type"]: r for r in row["results"]}
    assert by["CollectForensics"]["status"] == "Failed"
    assert by["CollectForensics"]["message"] == "No executor registered."
    assert by["OpenTicket"]["reference"] == "TICKET-924c58321ca6edb5"


def test_stop_on_failure_rolls_back_in_reverse(spark):
    df = plan.plan(enriched(
        spark, {"src_ip": "1", "username": "u", "hostname": "h"}, conf=0.8, sev=60))
    failing = F.map_from_entries(F.transform(
        F.filter(F.col("plan")["actions"], lambda a: a["type"] == "IsolateHost"),
        lambda a: F.struct(a["action_id"].alias("key"), F.struct(
            F.lit(False).alias("succeeded"), F.lit("no").alias("message"),
            F.lit(None).cast("string").alias("reference")).alias("value"))))
    ctx = execute.ExecutionContext(dry_run=False, stop_on_failure=True)
    row = run(df, ctx, open_catalog(), failing)
    assert [(r["type"], r["status"]) for r in row["results"]] == [
        ("OpenTicket", "Succeeded"), ("BlockIp", "Succeeded"), ("DisableUser", "Succeeded"),
        ("IsolateHost", "Failed")]
    assert [(r["type"], r["status"]) for r in row["rollback_results"]] == [
        ("EnableUser", "Succeeded"), ("UnblockIp", "Succeeded"), ("OpenTicket", "Skipped")]
    assert row["execution_notes"] == ["Stopped on first failure."]


def test_stop_without_executor_does_not_roll_back(spark):
    ctx = execute.ExecutionContext(dry_run=False, stop_on_failure=True)
    row = run(plan.plan(enriched(spark, {"src_ip": "1"})), ctx, open_catalog())
    assert types(row["results"]) == ["OpenTicket", "CollectForensics"]
    assert row["rollback_results"] == [] and row["execution_notes"] == []


# --- approvals, audit, cases ------------------------------------------------------


def test_first_final_decision_wins(spark):
    asked = spark.createDataFrame([("x", "Pending"), ("y", "Pending")],
                                  "action_id string, status string")
    made = spark.createDataFrame(
        [("x", 2, True), ("x", 1, False), ("zz", 1, True)],
        "action_id string, decided_at int, approve boolean")
    state = {r["action_id"]: r["status"] for r in approvals.approval_state(asked, made).collect()}
    assert state == {"x": "Denied", "y": "Pending"}


def test_audit_counts_and_inclusive_times(spark):
    rows = [("1", 0, "c", "ExecutionStart", {}), ("2", 5, "c", "ActionResult", {"status": "Succeeded"}),
            ("3", 6, "c", "actionresult", {"status": "failed"}), ("4", 9, "d", "ExecutionEnd", {})]
    df = spark.createDataFrame(
        [(a, TS + dt.timedelta(minutes=m), c, e, d) for a, m, c, e, d in rows],
        "entry_id string, ts timestamp, correlation_id string, event_type string,"
        " data map<string,string>")
    r = audit.report(df, "c").first()
    assert (r["total_events"], r["action_executions"], r["failures"]) == (3, 2, 1)
    assert r["summary"] == ["Total events: 3", "Action executions: 2", "Failures: 1"]
    at = F.lit("2024-01-01 00:05:00").cast("timestamp")
    assert audit.report(df, from_ts=at, to_ts=at).first()["total_events"] == 1


def test_case_fold(spark):
    ddl = ("case_id string, ts int, seq int, kind string, summary string, severity string,"
           " alert_key string, status string, description string")
    e = spark.createDataFrame([
        ("c", 1, 0, "evidence", None, None, None, None, "too early"),
        ("c", 2, 0, "open", "one", "1", "k", None, None),
        ("c", 3, 0, "close", None, None, None, "FalsePositive", None),
        ("c", 4, 0, "open", "two", "2", "k", None, None),
        ("c", 5, 0, "evidence", None, None, None, None, "late"),
        ("d", 1, 0, "close", None, None, None, "Closed", None),
        ("e", 1, 0, "close", None, None, None, "Closed", None),
        ("e", 2, 0, "open", "x", "3", "k", None, None)], ddl)
    got = {r["case_id"]: r for r in cases.case_state(e).collect()}
    assert set(got) == {"c", "e"}
    assert (got["c"]["summary"], got["c"]["status"], got["c"]["created_at"],
            got["c"]["updated_at"]) == ("two", "FalsePositive", 2, 5)
    assert got["e"]["status"] == "Open"
    assert [r["description"] for r in cases.case_evidence(e).collect()] == ["late"]


# --- sources ----------------------------------------------------------------------


@pytest.mark.parametrize("document,ids,cursor", [
    ('{"data":{"affected_items":[{"id":1},{"id":2}]},"cursor":7}', ["1", "2"], "7"),
    ('{"data":{"affected_items":"[1]","items":[{"id":3}]},"next_cursor":"n"}', ["3"], "n"),
    ('{"data":[{"id":4}]}', ["4"], None),
    ('{"data":"x","alerts":[{"_id":"5"}]}', ["5"], None),
    ('[{"alert_id":"6"}]', ["6"], None),
    ('{"id":8,"data":{"srcip":"1"},"rule":"text"}', ["8"], None),
    ("junk", [], None), ("  ", [], None)])
def test_envelopes(spark, document, ids, cursor):
    df = spark.createDataFrame([(document,)], "document string")
    rows = build_raw(unwrap(df), now()).collect()
    assert [r["alert_id"] for r in rows] == ids
    assert all(r["next_cursor"] == cursor for r in rows)


def test_pages(spark):
    df = spark.createDataFrame([(str(i), TS + dt.timedelta(seconds=i)) for i in range(7)],
                               "alert_id string, ts timestamp")
    p = page(df, cursor="3", limit=3)
    assert sorted((r["alert_id"], r["next_cursor"]) for r in p.collect()) == [
        ("3", "6"), ("4", "6"), ("5", "6")]
    last = page(df, cursor="6", limit=3).collect()
    assert [(r["alert_id"], r["next_cursor"]) for r in last] == [("6", None)]
    assert page(df, limit=0).count() == 7
    since = F.lit("2024-01-01 00:00:05").cast("timestamp")
    assert page(df, since=since, limit=0).count() == 2
