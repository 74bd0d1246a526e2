"""Writers and the readers that take their output."""

import datetime as dt

from pyspark.sql import functions as F

from alertweave.operators import audit, enrich, training
from alertweave.sources import readers, sinks

TS = dt.datetime(2024, 1, 1, 10)


def test_audit_round_trip(spark, tmp_path):
    ddl = ("entry_id string, ts timestamp, correlation_id string, component string,"
           " event_type string, message string, data map<string,string>")
    e = spark.createDataFrame(
        [(" ", TS, "c", "x", "ActionResult", "m", {"status": "Failed"}),
         ("k", TS, "c", "x", "Note", "m", None)], ddl)
    path = str(tmp_path / "a.jsonl")
    sinks.write_audit(e, path, "json")
    (tmp_path / "a.jsonl" / "extra.json").write_text('\nnot json\n{"entryId": 3')
    back = readers.read_audit(spark, path)
    ids = sorted(r["entry_id"] for r in back.collect())
    assert len(ids) == 2 and "k" in ids and len(max(ids, key=len)) == 32
    assert audit.report(back).first()["failures"] == 1
    assert readers.read_audit(spark, str(tmp_path / "none")).count() == 0
    sinks.write_audit(e, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).filter("date = '2024-01-01'").count() == 2


def test_dimensions_annotations_and_knowledge(spark, tmp_path):
    f = tmp_path / "assets.json"
    f.write_text('[{"HostId":"h1","criticality":3},{"hostid":"h2","ip":"1","owner":"o"}]')
    rows = readers.read_assets(spark, str(f)).orderBy("pos").collect()
    assert [(r["pos"], r["host_id"], r["criticality"]) for r in rows] == [(0, "h1", 3), (1, "h2", 0)]
    t = tmp_path / "intel.json"
    t.write_text('[{"srcIp":"1","reputationScore":9,"tags":["a","b"]}]')
    assert readers.read_intel(spark, str(t)).first()["tags"] == ["a", "b"]
    i = tmp_path / "ids.json"
    i.write_text('[{"userId":"u","privileged":true,"isServiceAccount":false}]')
    assert readers.read_identities(spark, str(i)).first()["privileged"] is True
    k = tmp_path / "kb.jsonl"
    k.write_text('{"title":"a","content":"c","tags":["t"]}\n\n{"content":"d"}\n')
    entries = readers.read_knowledge(spark, str(k)).orderBy("pos").collect()
    assert [(r["pos"], r["title"]) for r in entries] == [(0, "a"), (1, "untitled")]
    a = tmp_path / "notes.json"
    a.write_text('[{"dataset_id":"1","completion":"x"}]')
    assert readers.read_annotations(spark, str(a)).first()["completion"] == "x"


def test_texts_are_written(spark, tmp_path):
    pairs = spark.createDataFrame([("pé", "c")], "prompt string, completion string")
    sinks.write_pairs(pairs, str(tmp_path / "pairs"))
    assert spark.read.text(str(tmp_path / "pairs")).first()[0] == '{"prompt":"pé","completion":"c"}'
    ex = spark.createDataFrame(
        [("7", "7", "t", '{"a": 1}', '"x"', "l", 'say "hi"')],
        "dataset_id string, id string, timestamp string, rule string, agent string,"
        " location string, full_log string")
    sinks.write_extracts(training.extract_document(ex), str(tmp_path / "ex"))
    text = spark.read.text(str(tmp_path / "ex" / "dataset_id=7")).first()[0]
    assert spark.range(1).select(
        F.get_json_object(F.lit(text), "$[0].rule.a"), F.get_json_object(F.lit(text), "$[0].full_log")
    ).first()[:] == ("1", 'say "hi"')


def test_extracts_are_written_by_one_task_for_each_id(spark, tmp_path):
    path = tmp_path / "extracts"
    rows = spark.createDataFrame([(f"d{i % 3}", f'{{"i": {i}}}') for i in range(30)], "dataset_id string, value string")
    sinks.write_extracts(rows.repartition(6), str(path))
    for i in range(3):
        assert len(list((path / f"dataset_id=d{i}").glob("*.txt"))) == 1
    got = spark.read.text(str(path)).collect()
    assert sorted((r.dataset_id, r.value) for r in got) == sorted(tuple(r) for r in rows.collect())


def test_json_and_outbox_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", ["x", "é"]), ("b", [])], "id string, actions array<string>")
    sinks.write_json(rows, str(tmp_path / "plans"))
    got = spark.read.schema(rows.schema).json(str(tmp_path / "plans")).collect()
    assert sorted((r.id, r.actions) for r in got) == [("a", ["x", "é"]), ("b", [])]
    out = spark.createDataFrame([("1", "firewall"), ("2", "mail")], "action_id string, target string")
    for _ in range(2):
        sinks.write_outbox(out, str(tmp_path / "outbox"))
    stored = spark.read.parquet(str(tmp_path / "outbox"))
    assert stored.count() == 4 and stored.filter("target = 'mail'").select("action_id").distinct().count() == 1


def test_extra_tags_win_over_those_of_the_alert(spark):
    df = spark.createDataFrame([("1", {"a": "x", "b": "y"}), ("2", None)], "alert_id string, tags map<string,string>")
    extra = F.create_map(F.lit("b"), F.lit("z"), F.lit("scenario"), F.lit("s1"))
    got = {r.alert_id: r.tags for r in enrich.add_tags(df, extra).collect()}
    assert got == {"1": {"a": "x", "b": "z", "scenario": "s1"}, "2": {"b": "z", "scenario": "s1"}}
