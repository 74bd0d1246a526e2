"""Tables kept over batches: runs, hours, current cases, address changes, committed appends."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from alertweave.operators import cases, ordered
from alertweave.sources import commits, readers, runs, sinks
from alertweave.streaming import stateful, triage
from alertweave.streaming.case_table import CaseTable

START = dt.datetime(2024, 1, 1)
EVENTS = ("case_id string, ts timestamp, seq int, kind string, summary string, severity string,"
          " alert_key string, status string, description string")


def case_rows(rng, n):
    rows = []
    for i in range(n):
        kind = rng.choice(["open", "open", "evidence", "close", "note"])
        status = rng.choice(["Closed", "FalsePositive", "Other", None]) if kind == "close" else None
        # A third of the events belong to one case, and events come late.
        case = "hot" if rng.random() < 0.33 else f"c{rng.randrange(12)}"
        ts = START + dt.timedelta(minutes=rng.randrange(40))
        rows.append((case, ts, i, kind, f"s{i}", str(i % 7), f"k{i}", status, f"d{i}"))
    return rows


def state(df):
    return sorted(tuple(r) for r in df.collect())


def test_cases_over_batches_are_those_of_all_events(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "FAN", 2)
    rng, told = random.Random(4), []
    schema = spark.createDataFrame([], EVENTS).schema
    table = CaseTable(spark, str(tmp_path / "t"), schema)
    assert table.current().count() == 0
    for batch in range(7):
        rows = case_rows(rng, 40)
        df = spark.createDataFrame(rows, EVENTS)
        assert table.add(df, batch)
        # The batch comes again, and another one under the number of a stored batch.
        assert not table.add(df, batch) and not table.add(spark.createDataFrame(case_rows(rng, 5), EVENTS), batch)
        told += rows
        assert state(table.current()) == state(cases.case_state(spark.createDataFrame(told, EVENTS)))
    assert len(table.runs.live()) <= 4


def test_a_merge_that_ended_early_counts_once(spark, tmp_path):
    store = runs.Runs(spark, str(tmp_path / "r"), "n int")
    for batch in range(3):
        store.put(spark.createDataFrame([(batch,)], "n int"), batch)
    store._publish(store.read([(0, 0), (1, 1)]), (0, 1))
    (tmp_path / "r" / "_made-lost").mkdir()
    assert store.live() == [(0, 1), (2, 2)] and store.holds(1) and not store.holds(3)
    assert sorted(r.n for r in store.read().collect()) == [0, 1, 2]
    store.compact(3)
    assert sorted(n for n in os.listdir(tmp_path / "r")) == ["run-0-1", "run-2-2"]


def test_hours_are_published_once_and_folders_stay_few(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "audit")
    store = runs.HourRuns(spark, root, "n int, hour string")
    rows = lambda b: spark.createDataFrame([(b, "01"), (b + 100, "02" if b % 5 else "03")], "n int, hour string")
    for batch in range(30):
        if batch == 9:
            # The run ends between two renames: hour 01 is dealt, the other is not.
            real, calls = runs.files.publish, []

            def failing(sp, source, target):
                calls.append(target)
                if len(calls) == 3:
                    raise OSError("lost")
                return real(sp, source, target)

            monkeypatch.setattr(runs.files, "publish", failing)
            with pytest.raises(OSError):
                store.put(rows(batch), batch)
            monkeypatch.setattr(runs.files, "publish", real)
            # It comes again with rows of another hour; what was published first stays.
            assert store.put(spark.createDataFrame([(9, "07")], "n int, hour string"), batch)
        else:
            assert store.put(rows(batch), batch)
        assert not store.put(rows(batch), batch)
    assert store.hours() == ["01", "02", "03"] and store.hours("02") == ["02", "03"]
    assert sorted(r.n for r in store.read().collect()) == sorted([*range(30), *range(100, 130)])
    assert len(store.hour("01").live()) <= 2 * runs.FAN
    assert {(r.n % 5, r.hour) for r in store.read("03").collect()} == {(0, "03")}
    assert all("hour=01" not in f for f in store.read("02").inputFiles())
    assert os.listdir(f"{root}/_done") and len([n for n in os.listdir(f"{root}/_done") if not n.startswith(".")]) == 1


@pytest.mark.parametrize("partitions", [1, 4, 30])
def test_changes_match_a_sequential_pass(spark, partitions):
    rng = random.Random(8)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "b", "c"]), rng.choice(["1", "2", None]), i * 2**40) for i in range(500)]
    df = spark.createDataFrame(rows, "n bigint, k string, v string, wide bigint").repartition(7)
    last, want = {}, []
    for n, k, v, wide in rows:
        if k in last and last[k] is not None and v is not None and last[k] != v:
            want.append((n, k, v, wide, last[k]))
        last[k] = v
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = ordered.changes(df, "k", ["n"], "v", "prev", partitions).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert sorted(tuple(r) for r in got) == want
    empty = ordered.changes(df.filter("false"), "k", ["n"], "v", "prev", partitions)
    assert empty.count() == 0 and empty.columns == [*df.columns, "prev"]


def test_addresses_of_a_hot_agent_over_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "FAN", 2)
    rng, root, last, want = random.Random(2), str(tmp_path / "out"), {}, []
    for batch in range(5):
        rows = []
        for i in range(200):
            agent = "hot" if i % 3 == 0 else f"a{rng.randrange(9)}"
            rows.append((f"{batch:02d}-{i:04d}", agent, f"10.0.0.{rng.randrange(3)}", START + dt.timedelta(seconds=i)))
        for id_, agent, ip, _ in rows:
            if agent in last and last[agent] != ip:
                want.append((agent, id_, last[agent], ip))
            last[agent] = ip
        df = spark.createDataFrame(rows, "id string, a string, ip string, ts timestamp")
        logs = df.repartition(4).select(
            "id", "ts", F.to_json(F.struct(F.col("a").alias("id"), "ip")).alias("agent"),
            F.lit("").alias("rule"), F.lit("t").alias("timestamp"), F.lit("x").alias("full_log"))
        stateful.address_batch(logs, batch, root)
        stateful.address_batch(logs, batch, root)  # again, as after a lost driver
    got = spark.read.parquet(f"{root}/address-changes").select("agent_key", "id", "previous_ip", "agent_ip")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_address_stream_equals_the_other_one(spark, tmp_path):
    from alertweave.plans import fixtures as X

    src = str(tmp_path / "in")
    X.logs(spark, "/root/testdata/sf0.001").filter("event_id < 300").repartition(3).write.parquet(src)
    schema = spark.read.parquet(src).schema
    source = lambda: spark.readStream.schema(schema).parquet(src)
    stateful.address_stream(source(), str(tmp_path / "a"), str(tmp_path / "cp")).awaitTermination()
    q = (stateful.ip_change_stream(source()).writeStream.format("parquet").option("path", str(tmp_path / "b"))
         .option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start())
    q.awaitTermination()
    names = ["agent_key", "id", "previous_ip", "agent_ip"]
    one, two = (state(spark.read.parquet(str(tmp_path / p)).select(names)) for p in ("a/address-changes", "b"))
    assert one == two and one


def test_an_append_happens_once(spark, tmp_path, monkeypatch):
    path, names = str(tmp_path / "d"), ["id", "t"]
    rows = lambda ids: spark.createDataFrame([(i, f"t,{i}\n", n) for n, i in enumerate(ids)], "id string, t string, n int")
    add = lambda ids, batch: sinks.append_dataset(spark, rows(ids), path, names, ["id"], ["n"], batch=batch)
    stored = lambda: sorted(r.id for r in readers.read_dataset(spark, path).collect())
    assert add("abca", "one") == 3 and stored() == list("abc")
    # The writer is lost after its files and before its commit.
    with monkeypatch.context() as m:
        m.setattr(commits.files, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            add("cde", "two")
    assert stored() == list("abc")
    assert add("cde", "two") == 2 and stored() == list("abcde")
    # Again after its commit, and an append that finds nothing new.
    assert add("cde", "two") == 2 and add("ab", "three") == 0 and stored() == list("abcde")
    assert len(commits.clean(spark, path)) == 1 and stored() == list("abcde")
    assert sinks.ingest(spark, rows("xy"), path, names, ["id"], ["n"], batch="four")["added_rows"] == 2
    assert stored() == list("abcdexy")


def test_the_first_append_may_be_lost_or_empty(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "d")
    rows = spark.createDataFrame([("a", 1)], "id string, n int")
    with monkeypatch.context() as m:
        m.setattr(commits.files, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            sinks.append_dataset(spark, rows, path, ["id"], ["id"], ["n"], batch="one")
    assert sinks.append_dataset(spark, rows.limit(0), path, ["id"], ["id"], ["n"], batch="none") == 0
    assert sinks.append_dataset(spark, rows, path, ["id"], ["id"], ["n"], batch="one") == 1
    assert readers.read_dataset(spark, path).count() == 1
    plain = str(tmp_path / "p")
    sinks.append_dataset(spark, rows, plain, ["id"], ["id"], ["n"])
    with pytest.raises(ValueError):
        sinks.append_dataset(spark, rows.withColumn("id", F.lit("z")), plain, ["id"], ["id"], ["n"], batch="x")


def test_recent_audit_lists_hours_only(spark, tmp_path):
    root = str(tmp_path)
    now = F.lit("2024-01-02 10:05:00").cast("timestamp")
    schema = ("entry_id string, ts timestamp, correlation_id string, component string, event_type string,"
              " message string, data map<string,string>")
    for batch, minute in enumerate([0, 56, 59, 64]):
        at = dt.datetime(2024, 1, 2, 9) + dt.timedelta(minutes=minute)
        entry = spark.createDataFrame([(f"e{batch}", at, "c", "x", "ActionResult", "m", {"status": "Failed"})], schema)
        triage.audit_runs(spark, root).put(entry.withColumn("hour", F.date_format("ts", "yyyyMMddHH")), batch)
    assert triage.recent_audit(spark, root, now).first()["failures"] == 3
    assert triage.audit_runs(spark, root).hours() == ["2024010209", "2024010210"]
