"""Streams give what the batch functions give."""

import json

import pytest
from pyspark.sql import functions as F

from alertweave.operators import approvals, heuristics, normalize
from alertweave.plans import fixtures as X
from alertweave.plans.triage import Triage
from alertweave.sources.alerts import RAW_SCHEMA
from alertweave.streaming import stateful, triage

SF = "/root/testdata/sf0.001"


def test_triage_stream(spark, tmp_path):
    landed, root = str(tmp_path / "in"), str(tmp_path / "out")
    alerts = X.alerts(spark, SF)
    alerts.repartition(2).write.json(landed)
    t = Triage()
    stream = triage.read_alert_stream(spark, landed, max_files=1)
    now = lambda: X.now()
    triage.start(stream, t, root, str(tmp_path / "cp"), 0, now).awaitTermination()
    normalized = t.normalized(alerts)
    executed = t.executed(normalize.valid(normalized), X.now())
    read = lambda name: spark.read.parquet(f"{root}/{name}")
    assert read("plans").count() == executed.count()
    assert read("rejects").count() == normalize.rejects(normalized).count()
    asked = approvals.requests(approvals.pending_actions(executed))
    got = read("approvals").select("action_id")
    assert sorted(r[0] for r in got.collect()) == sorted(
        r[0] for r in asked.select("action_id").collect())
    cycles = read("cycles").agg(F.sum("pulled"), F.sum("approvals_created"), F.count("*")).first()
    assert cycles[0] == 1000 and cycles[1] == asked.count() and cycles[2] >= 2
    assert read("recent_audit").count() == cycles[2]


def test_address_change_stream(spark, tmp_path):
    rows = X.logs(spark, SF).filter("event_id < 400")
    want = sorted(tuple(r) for r in heuristics.ip_changes(rows, X.LOG_ORDER)
                  .select("agent_key", "id", "previous_ip", "agent_ip").collect())
    src = str(tmp_path / "in")
    rows.filter("event_id < 200").coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema

    def run():
        stream = stateful.ip_change_stream(spark.readStream.schema(schema).parquet(src))
        q = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "cp")).outputMode("append")
             .trigger(availableNow=True).start())
        q.awaitTermination()

    run()
    rows.filter("event_id >= 200").coalesce(1).write.mode("append").parquet(src)
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    first = rows.agg(F.max(F.when(F.col("event_id") < 200, F.col("ts")))).first()[0]
    later = rows.agg(F.min(F.when(F.col("event_id") >= 200, F.col("ts")))).first()[0]
    result = sorted(tuple(r) for r in got.collect())
    if first <= later:
        assert result == want
    else:
        # Batches overlap in time here: order is by arrival, then by time inside a batch.
        parts = [rows.filter("event_id < 200"), rows.filter("event_id >= 200")]
        joined = parts[0].withColumn("b", F.lit(0)).unionByName(parts[1].withColumn("b", F.lit(1)))
        again = heuristics.ip_changes(joined, ["b", "ts", "id"]).select(
            "agent_key", "id", "previous_ip", "agent_ip")
        assert result == sorted(tuple(r) for r in again.collect())


def test_append_stream_is_idempotent(spark, tmp_path):
    root = str(tmp_path / "store")
    one = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, n int")
    two = spark.createDataFrame([("b", 4), ("c", 5)], "k string, n int")
    for batch, rows in ((0, one), (1, two), (1, two)):
        stateful.append_batch(rows, batch, root, ["k"], ["n"])
    got = spark.read.parquet(f"{root}/dataset").select("k", "n").collect()
    assert sorted(tuple(r) for r in got) == [("a", 1), ("b", 3), ("c", 5)]


def test_first_requests_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    for i, ids in enumerate((["x", "y", "x"], ["y", "z"])):
        spark.createDataFrame([(a,) for a in ids], "action_id string").coalesce(1).write.mode(
            "append").json(src)
        stream = stateful.first_requests(spark.readStream.schema("action_id string").json(src))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(
        ).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r[0] for r in got) == ["x", "y", "z"]


def test_first_request_of_a_batch_is_the_first_in_order(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "action_id string, ts int, alert_id string, seq int"
    for rows in ([("x", 5, "b", 0), ("x", 3, "a", 1), ("x", 3, "a", 0), ("y", 9, "c", 0)], [("x", 1, "z", 0), ("z", 2, "d", 0)]):
        spark.createDataFrame(rows, schema).repartition(1).write.mode("append").json(src)
        stream = spark.readStream.schema(schema).json(src)
        stateful.first_request_stream(stream, root, str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(f"{root}/dataset").select("action_id", "ts", "alert_id", "seq").collect()
    assert sorted(tuple(r) for r in got) == [("x", 3, "a", 0), ("y", 9, "c", 0), ("z", 2, "d", 0)]


def test_malformed_lines_and_recent_audit(spark, tmp_path):
    landed, root = tmp_path / "in", str(tmp_path / "out")
    landed.mkdir()
    good = {"alert_id": "1", "siem_name": "wazuh", "payload": json.dumps({"hostname": "h"})}
    (landed / "a.json").write_text(json.dumps(good) + "\n" + "{broken line\n")
    stream = triage.read_alert_stream(spark, str(landed))
    query = triage.start(stream, Triage(), root, str(tmp_path / "cp"), 0, lambda: X.now())
    query.awaitTermination()
    assert spark.read.parquet(f"{root}/plans").count() == 1
    assert spark.read.parquet(f"{root}/rejects").select("payload").first()[0] == "{broken line"
    report = triage.recent_audit(spark, root, X.now())
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(hour" in plan and report.first()["total_events"] > 0
    later = triage.recent_audit(spark, root, X.now() + F.expr("INTERVAL 2 HOURS"))
    assert later.first()["total_events"] == 0


def test_bad_alert_stops_nothing(spark, tmp_path):
    rows = [("1", "wazuh", None, None, None, None, "not json"),
            ("2", "wazuh", None, None, None, None, json.dumps({"hostname": "h"}))]
    df = spark.createDataFrame(rows, RAW_SCHEMA)
    triage.handle_batch(df, 0, Triage(), str(tmp_path), X.now())
    assert spark.read.parquet(f"{tmp_path}/plans").count() == 1
    assert spark.read.parquet(f"{tmp_path}/rejects").count() == 1
    assert pytest.approx(spark.read.parquet(f"{tmp_path}/acks").count()) == 4


@pytest.mark.parametrize("interval", [0, 1])
def test_cycles_are_counted_for_each_run(spark, tmp_path, interval):
    landed, root = tmp_path / "in", str(tmp_path / "out")
    landed.mkdir()
    for i in range(4):
        alert = {"alert_id": str(i), "siem_name": "wazuh", "payload": json.dumps({"hostname": f"h{i}"})}
        (landed / f"{i}.json").write_text(json.dumps(alert) + "\n")

    def run(cycles):
        stream = triage.read_alert_stream(spark, str(landed), max_files=1)
        return triage.run_cycles(stream, Triage(), root, str(tmp_path / "cp"), cycles, interval, lambda: X.now())

    def handled():
        return sorted(r[0] for r in spark.read.parquet(f"{root}/plans").select("alert_id").collect())

    assert run(1) == 1 and len(handled()) == 1
    # A restart goes on behind the first run, and its limit counts its own cycles.
    assert run(2) == 2 and len(handled()) == 3
    assert run(1) == 1 and handled() == ["0", "1", "2", "3"]
    if interval == 0:
        assert run(5) == 0 and len(handled()) == 4
