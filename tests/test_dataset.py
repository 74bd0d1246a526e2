"""Datasets, heuristics, ordered scans, texts, replies and search on small rows."""

import random

import pytest
from pyspark.sql import functions as F

from alertweave.operators import dataset, heuristics, knowledge, ordered, replies, training
from alertweave.sources import readers, sinks


def test_projection_follows_top_level_names(spark):
    df = spark.createDataFrame(
        [('{"a":1,"b":{"x":[1,"p:q,r"]},"c":null,"d.e":"dot","f":true,"g":"true"}',)],
        "document string")
    row = dataset.project_rows(df, ["a", "b", "c", "d.e", "f", "g", "none"]).first()
    assert tuple(row) == ("1", '{"x": [1, "p:q,r"]}', "", "dot", "True", "true", "")


def test_new_rows_and_dedupe_keep_the_first(spark):
    stored = spark.createDataFrame([("a", "0", 0)], "k string, v string, n int")
    incoming = spark.createDataFrame(
        [("a", "1", 1), ("b", "2", 2), ("b", "3", 3), (None, "4", 4)], "k string, v string, n int")
    got = dataset.new_rows(stored, incoming, ["k", "nope"], ["n"]).collect()
    assert sorted(r["v"] for r in got) == ["2", "4"]
    assert dataset.duplicate_count(incoming, ["k"]).first()[0] == 1


def test_csv_round_trip(spark, tmp_path):
    path, out = str(tmp_path / "d.csv"), str(tmp_path / "e.csv")
    rows = spark.createDataFrame(
        [("1", 'say "hi",\nthere', 1), ("2", "", 2), ("1", "again", 3)], "id string, t string, n int")
    stats = sinks.ingest(spark, rows, path, ["id", "t"], ["id", "t"], ["n"])
    assert stats == {"added_rows": 3, "duplicates_removed": 0}
    assert sinks.append_dataset(spark, rows, path, ["id", "t"], ["id", "t"], ["n"]) == 0
    back = readers.read_dataset(spark, path, "o")
    assert {(r["id"], r["t"]) for r in back.collect()} == {
        ("1", 'say "hi",\nthere'), ("2", ""), ("1", "again")}
    assert sinks.rewrite_deduplicated(back, out, ["id", "t"], ["id"], ["o"]) == 1


def test_log_files(spark, tmp_path):
    texts = {"a.json": '{"x":1}', "b.json": '[{"x":2},{"x":3}]', "c.json": '{"x":4}\n\n{"x":5}\nbad',
             "d.json": "  ", "e.json": "7"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    rows = readers.read_logs(spark, str(tmp_path)).orderBy("path", "pos").collect()
    good = [r["document"] for r in rows if r["error"] is None]
    assert good == ['{"x":1}', '{"x":2}', '{"x":3}', '{"x":4}', '{"x":5}']
    assert sorted(r["error"] for r in rows if r["error"]) == [
        "Line is not valid JSON.", "Log file must contain a JSON object or array."]


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_ordered_scan_matches_a_sequential_pass(spark, partitions):
    rng = random.Random(5)
    # One key holds most rows, so it spans many partitions.
    rows = [(i, rng.choice(["hot"] * 8 + ["a", "b"]), str(rng.randint(0, 2))) for i in range(400)]
    df = spark.createDataFrame(rows, "n int, k string, v string").repartition(5)
    last, want = {}, {}
    for n, k, v in rows:
        want[n] = last.get(k)
        last[k] = v
    got = ordered.with_previous(df, "k", ["n"], "v", "prev", partitions)
    assert {r["n"]: r["prev"] for r in got.collect()} == want
    placed = ordered.with_position(df, ["n"], partitions=partitions).collect()
    assert all(r["position"] == r["n"] and r["total"] == 400 for r in placed)


def test_heuristics(spark):
    ddl = "n int, id string, timestamp string, rule string, agent string, full_log string"
    df = spark.createDataFrame([
        (1, "1", "t", '{"id":"5","description":"PowerShell run"}', '{"id":"7","ip":"1"}', "x"),
        (2, "2", "t", "", '{"id":"7"}', "Installation completed"),
        (3, "3", "t", "", '{"name":"web","ip":"9"}', "Installation completed, signed by A"),
        (4, "4", "t", '{"description":"installed product"}', '{"id":"7","ip":"2"}', "verified"),
        (5, "5", "t", "not json", "raw agent", "y" * 500 + " sudo"),
    ], ddl)
    found = heuristics.matches(df, ["n"])
    got = sorted((r["n"], r["heuristic"]) for r in found.collect())
    assert got == [(1, "powershell_usage"), (2, "unsigned_install"), (3, "signed_install"),
                   (4, "login_geo_anomaly"), (4, "signed_install"), (4, "unsigned_install"),
                   (5, "root_execution")]
    plans = {(r["dataset_id"], r["heuristic"]): r
             for r in heuristics.response_plans(found, ["n"], {"HIGH": ["go"]}).collect()}
    assert plans[("5", "root_execution")]["host"] == "raw agent"
    assert plans[("5", "root_execution")]["actions"] == []
    assert plans[("1", "powershell_usage")]["actions"] == ["go"]
    assert plans[("3", "signed_install")]["host"] == "web"
    assert len(plans[("5", "root_execution")]["log_excerpt"]) == 400
    assert heuristics.matches(df, ["n"], limit=1).filter("heuristic='signed_install'").count() == 1


def test_training_rows(spark):
    data = spark.createDataFrame([("1", "old", 1), ("1", "new", 2)], "id string, full_log string, n int")
    rows = training.keyed_rows(data, "id", ["n"])
    notes = spark.createDataFrame(
        [("1", None, " <r/> ", None), ("1", "g", None, None), ("9", "g", "x", None)],
        "dataset_id string, detection_goal string, completion string, rule_xml string")
    pairs = training.training_pairs(notes, rows, strict=False).collect()
    assert [p["completion"] for p in pairs] == ["<r/>"]
    assert "Detection goal: Detect suspicious activity." in pairs[0]["prompt"]
    assert "full_log: new" in pairs[0]["prompt"]
    with pytest.raises(KeyError):
        training.training_pairs(notes, rows)
    extract = spark.createDataFrame([(" {\"a\": 1} ",), ("plain \"q\"",), (" ",)], "t string")
    assert [r[0] for r in extract.select(training.json_or_text(F.col("t"))).collect()] == [
        '{"a": 1}', '"plain \\"q\\""', "{}"]


@pytest.mark.parametrize("text,found,reply", [
    ('ok {"a":1} end', '{"a":1}', '{"a":1}'),
    ('{"a":1} and {"b":2}', None, '{"message":"{\\"a\\":1} and {\\"b\\":2}"}'),
    (" plain ", None, '{"message":"plain"}'), ("} {", None, '{"message":"} {"}'),
    ("", None, '{"message":""}')])
def test_reply_parsing(spark, text, found, reply):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(replies.extract_object(F.col("t")), replies.rule_reply(F.col("t"))).first()
    assert tuple(row) == (found, reply)


def _brute(queries, entries, k):
    out = {}
    for qid, text in queries:
        toks = text.lower().split()
        scored = []
        for pos, title, content, tags in entries:
            hay = " ".join([title, content, " ".join(tags)]).lower()
            score = sum(1 for t in toks if t in hay)
            if score or not toks:
                scored.append((-score, pos))
        scored = sorted(scored) or [(0, e[0]) for e in entries]
        out[qid] = [(p, -s) for s, p in scored[:k]]
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 1])
def test_search_equals_brute_force(spark, block_bytes):
    rng = random.Random(3)
    words = ["alpha", "beta", "gam", "gamma", "x", "Del"]
    entries = [(i, rng.choice(words), " ".join(rng.choices(words, k=4)), [rng.choice(words)])
               for i in range(60)]
    queries = [(i, " ".join(rng.choices(words + ["zz"], k=rng.randint(0, 4)))) for i in range(20)]
    queries.append((99, "nomatch"))
    q = spark.createDataFrame(queries, "query_id int, query string")
    e = spark.createDataFrame(entries, "pos int, title string, content string, tags array<string>")
    got = knowledge.search(q, e.repartition(4), 5, block_bytes)
    result = {}
    for r in got.orderBy("query_id", "rank").collect():
        result.setdefault(r["query_id"], []).append((r["pos"], r["score"]))
    assert result == _brute(queries, entries, 5)


def test_policy_file(spark, tmp_path):
    f = tmp_path / "p.json"
    f.write_text('{"MinConfidenceForAutonomy":0.7,"safeLowConfidenceActions":[],'
                 '"requireApprovalInProd":["blockip","Nope"],'
                 '"forbiddenActionsByEnvironment":{"PROD":["killprocess"],"dev":[]}}')
    c = readers.load_policy(spark, str(f))
    assert c.min_confidence == 0.7 and c.safe == ("OpenTicket", "Notify")
    assert c.prod_approval == ("BlockIp",)
    assert c.environment_forbidden == {"prod": ("KillProcess",), "dev": ()}
    assert readers.load_policy(spark, str(tmp_path / "none.json")) == readers.PolicyConfig()
