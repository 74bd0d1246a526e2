"""What keeps one task from getting most of the work."""

import glob

import pytest
from pyspark.sql import functions as F

from alertweave.functions import actions as A
from alertweave.functions import fixed as K
from alertweave.operators import enrich, plan, replies, score
from alertweave.plans import fixtures as X
from alertweave.plans import registry
from alertweave.plans.triage import Triage
from alertweave.session import prepare
from alertweave.sources.runs import HourRuns

SF = "/root/testdata/sf0.001"
SHUFFLED = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}


@pytest.fixture
def settings(spark):
    before = {}

    def use(values):
        for key, value in values.items():
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield use
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_alerts_without_a_match_are_not_in_one_task(spark, settings):
    settings(SHUFFLED)
    alerts = spark.range(200).select(
        F.col("id").cast("string").alias("alert_id"), F.concat(F.lit("h"), "id").alias("host")
    )
    hosts = spark.createDataFrame([(1, "h7"), (2, "H7"), (3, " ")], "pos long, name string")
    found = enrich.first_match(alerts, hosts, [("name", F.col("host"))], "m")
    rows = found.select("alert_id", "m", F.spark_partition_id().alias("task")).collect()
    assert len(rows) == 200
    assert {r.alert_id: r.m.name for r in rows if r.m} == {"7": "h7"}
    assert len({r.task for r in rows if not r.m}) > 1


def test_plans_are_not_shuffled_to_their_replies(spark, settings):
    settings(SHUFFLED)
    answers = spark.createDataFrame([("1", "no plan"), ("1", "none")], "alert_id string, reply string")
    planned = Triage(plan_replies=answers).planned(registry.valid(spark, SF), X.now())
    text = planned.select("alert_id", "plan", "plan_source")._jdf.queryExecution().executedPlan().toString()
    assert text.index("Generate") < text.index("Exchange")


def test_replies_by_either_way(spark):
    """Joined before planning or after it: the same rows, also for an alert with two replies."""
    ids = [r[0] for r in registry.valid(spark, SF).select("alert_id").orderBy("alert_id").limit(4).collect()]
    good = '{"strategy":"Contain","actions":[{"type":"Notify"}]}'
    answers = spark.createDataFrame(
        [(ids[0], good), (ids[0], "none"), (ids[1], '{"actions":[]}'), (ids[2], None)], "alert_id string, reply string"
    )
    chosen = registry.valid(spark, SF).filter(F.col("alert_id").isin(ids))
    plain = plan.plan(score.scenario_score(enrich.enrich(chosen, X.now())))
    late = replies.with_plan_replies(plain, answers)
    early = Triage(plan_replies=answers).planned(chosen, X.now())
    show = lambda df: sorted((r.alert_id, r.plan_source, r.plan.plan_id) for r in df.collect())
    assert show(early) == show(late)
    assert sorted(r[:2] for r in show(early)) == sorted(
        [(ids[0], "computed"), (ids[0], "external"), *[(i, "computed") for i in ids[1:]]]
    )


def test_a_large_hour_is_written_by_several_tasks(spark, settings, tmp_path):
    settings({"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"})
    rows = spark.range(0, 20000, 1, 8).select(F.md5(F.col("id").cast("string")).alias("v"), F.lit("2024020100").alias("hour"))
    runs = HourRuns(spark, str(tmp_path / "audit"), "v string, hour string")
    assert runs.put(rows, 0)
    assert len(glob.glob(f"{tmp_path}/audit/hour=2024020100/run-0-0/*.parquet")) > 1
    assert runs.read().distinct().count() == 20000


def test_the_alert_stream_lands_in_a_file_for_each_core(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(registry, "_new_folder", lambda spark, name: str(tmp_path))
    counters = registry.QUERIES["stream_cycles"](spark, SF)
    assert len(glob.glob(f"{tmp_path}/landed/*.json")) == X.cores(spark)
    assert spark.read.parquet(f"{tmp_path}/cycles").select("batch_id").distinct().count() == 2
    assert counters.first()["pulled"] == X.events(spark, SF).count()


def test_a_large_shuffle_gives_each_core_several_tasks(spark, settings):
    """One long task for each core, and one more, is two rounds of which the second is almost empty."""
    settings({"spark.sql.shuffle.partitions": "64"})
    rows = prepare(spark).range(0, 4_000_000, 1, 8).select(F.xxhash64("id").alias("v"), F.xxhash64("id", "id").alias("w"))
    tasks = rows.repartition("v").select("w", F.spark_partition_id().alias("p")).filter("w != 0").agg(F.countDistinct("p"))
    assert tasks.first()[0] > 2 * spark.sparkContext.defaultParallelism


def test_a_rating_looks_an_action_up_once(spark):
    action = A.action(F.lit("BlockIp"), A.empty_params(), F.lit("why"))
    rated = plan.estimate(action, K.ACTION_CATALOG, F.lit(0.5), F.lit(1), F.lit(False))
    assert str(rated).count("array_contains") == 1


def test_ids_of_proposed_actions_are_those_of_their_texts(spark):
    names = ["src_ip", "hostname", "host_id", "username", "user_id"]
    rows = [("1.2.3.4", "h", "x", "u", "7"), ("1.2.3.4", "h", None, " ", "7"), ("", "", "x|=", "u", None)]
    e = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)).select(F.struct(*names).alias("e"))
    found = e.select(F.inline(plan.strategy_actions(F.lit("Contain"), F.col("e"))))
    ids = found.select("type", "params", "action_id", A.action_id(F.col("type"), F.col("params")).alias("again")).collect()
    assert [r.type for r in ids].count("IsolateHost") == 3 and [r.type for r in ids].count("BlockIp") == 2
    assert all(r.action_id == r.again for r in ids)


def test_planning_has_no_lambda_in_proposals_and_generators(spark):
    """An expression with a lambda is interpreted from its root; so few things may stand below one."""
    e = F.struct(*[F.lit("x").alias(n) for n in plan.NEEDED_ENTITIES])
    assert "lambda" not in str(plan.strategy_actions(F.lit("Contain"), e)).lower()
    text = registry.QUERIES["policy_counts"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    generators = [line for line in text.splitlines() if "Generate " in line]
    assert len(generators) >= 3 and not any("lambda" in line for line in generators)


@pytest.mark.parametrize("dropped", [(), ("IsolateHost",), tuple(K.ACTION_CATALOG)])
def test_proposals_are_rated_as_any_action(spark, dropped):
    catalog = {k: v for k, v in K.ACTION_CATALOG.items() if k not in dropped}
    if not dropped:
        catalog["DisableUser"] = (*catalog["DisableUser"][:4], ["user_id"])
    names = plan.NEEDED_ENTITIES
    rows = [(s, "1.2.3.4", "h", None, u, i) for s in [*K.STRATEGIES, None] for u, i in [("u", "7"), (" ", "7"), ("u", "")]]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in ["s", *names])).select("s", F.struct(*names).alias("e"))
    given = {n: F.length(F.trim(F.col("e")[n])) > 0 for n in names}
    given = {n: F.coalesce(c, F.lit(False)) for n, c in given.items()}
    more = F.lit(7).cast("bigint"), F.lit(-90).cast("bigint")
    for p in plan.proposals(F.col("s"), F.col("e"), given):
        rated = plan.rate(p.action, catalog, *more)
        known = A.known(p.action["type"], catalog) & A.parameters_ok(p.action["type"], p.action["params"], catalog)
        fast = plan._rate_proposal(p, catalog, *more)
        found = df.filter(p.when).select(
            F.to_json(rated).alias("want"), F.to_json(fast).alias("got"), known.alias("ready"),
            (F.lit(p.type in catalog) & plan._proposal_ok(p, catalog, given)).alias("ok"),
        ).collect()
        assert found and all(r.want == r.got and r.ready == r.ok for r in found)
