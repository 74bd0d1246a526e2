"""Registered queries of the alert part against their SQL."""

import os

import compare
import pytest

import __spark_entry__ as entry
from alertweave.plans import oracle, registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(registry.QUERIES)


def test_every_query_has_an_oracle():
    assert set(oracle.oracle_sql()) == set(registry.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, name):
    want = compare.oracle_rows(compare.connect(SF), entry.oracle_sql()[name])
    got = compare.spark_rows(entry.queries()[name](spark, SF))
    assert compare.differences(got, want) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chain_has_no_nested_loop_no_python_and_broadcast_lookups(spark):
    text = _plan(entry.queries()["policy_actions"](spark, SF))
    assert "NestedLoop" not in text and "CartesianProduct" not in text
    assert "Python" not in text and "BroadcastHashJoin" in text


def test_chain_does_not_shuffle_alerts(spark):
    from alertweave.plans import fixtures as X
    from alertweave.plans.triage import Triage

    raw = X.alerts(spark, SF).selectExpr("*")
    narrow = Triage().executed(Triage().normalized(raw).filter("reject_reason is null"), X.now())
    # The only exchange is the one that spreads the single-file fixture.
    assert _plan(narrow).count("Exchange") <= 1


def test_alerts_are_dealt_over_all_cores(spark):
    from alertweave.plans import fixtures as X

    alerts = X.alerts(spark, SF)
    tasks = alerts.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    assert len(tasks) == spark.sparkContext.defaultParallelism
    five = X.events(spark, SF, 5).selectExpr("spark_partition_id() AS p").distinct()
    assert five.count() == 5
