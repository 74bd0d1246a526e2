"""Alert-shaped views over the driver tables, by arithmetic both engines can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-02-01 00:00:00"


def _i() -> Column:
    return F.col("event_id")


def _u() -> Column:
    return F.col("user_id")


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cores(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


def events(spark: SparkSession, sf: str, tasks: int | None = None) -> DataFrame:
    """The events by hash of their id: the fixture's file may be one split, alerts are CPU work.

    ``tasks`` (one for each core if not given) is explicit, so adaptive execution, which sees
    few bytes, does not join the partitions again.
    """
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    return e.repartition(tasks or cores(spark), "event_id")


def _text(c: Column) -> Column:
    return c.cast("string")


def _by_event(**texts: str) -> Column:
    out = None
    for name, text in texts.items():
        branch = F.col("event_type") == name
        out = F.when(branch, F.lit(text)) if out is None else out.when(branch, F.lit(text))
    return out


def _case(parts: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = None
    for cond, value in parts:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(otherwise)


RULES = dict(
    error="Malware trojan found",
    click="Port scan detected",
    view="benign health check",
    signup="Failed login burst",
    purchase="Unusual process",
)


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Per event: the entity values an alert should end up with."""
    e = events(spark, sf)
    host = F.concat(F.lit("srv-"), _text(_u() % 40))
    return e.select(
        "event_id",
        "user_id",
        "event_type",
        F.col("ts").cast("timestamp").alias("ts"),
        _text(_i()).alias("alert_id"),
        _case(
            [
                (_i() % 20 == 0, F.lit("splunk")),
                (_i() % 4 == 0, F.lit("simulator")),
                (_i() % 7 == 0, F.lit("WAZUH")),
            ],
            F.lit("wazuh"),
        ).alias("siem_name"),
        _case(
            [
                (_i() % 11 == 0, F.lit("UnknownSignal")),
                (_i() % 13 == 0, F.lit("EdgeMissingParams")),
            ],
            _by_event(
                error="MalwareHashOnHost",
                click="PortScanFromIp",
                view="BenignNoise",
                signup="BruteForceUser",
                purchase="SuspiciousProcessOnHost",
            ),
        ).alias("alert_type"),
        F.when(_i() % 19 != 0, (_i() % 18).cast("int")).alias("level"),
        _by_event(**RULES).alias("rule_name"),
        F.when(
            _i() % 5 != 0,
            F.concat(F.lit("10.0."), _text(_u() % 8), F.lit("."), _text(_i() % 50)),
        ).alias("src_ip"),
        F.when(_u() % 3 != 0, F.concat(F.lit("user"), _text(_u()))).alias("username"),
        F.when(_u() % 4 != 0, F.concat(F.lit("u-"), _text(_u()))).alias("uid"),
        F.when(_i() % 6 != 0, F.when(_i() % 9 == 0, F.upper(host)).otherwise(host)).alias("hostname"),
        F.when(_i() % 4 == 1, F.concat(F.lit("host-"), _text(_u() % 60))).alias("host_id"),
        F.when(
            F.col("event_type") == "error", F.concat(F.lit("hash"), _text(_i() % 30))
        ).alias("file_hash"),
        # Only beside a source address, so that it never decides whether an alert has entities.
        F.when(
            (_i() % 5 != 0) & (_i() % 3 == 1), F.concat(F.lit("192.168.0."), _text(_i() % 9))
        ).alias("dst_ip"),
        F.when(_i() % 7 == 2, F.concat(F.lit("d"), _text(_u() % 5), F.lit(".example"))).alias("domain"),
        F.when(
            (F.col("event_type") == "purchase") & (_i() % 2 == 0),
            F.concat(F.lit("proc"), _text(_i() % 6), F.lit(".exe")),
        ).alias("process_name"),
        F.when(
            F.col("event_type") == "purchase", F.concat(F.lit("/bin/proc"), _text(_i() % 6))
        ).alias("process_path"),
    )


def payload() -> Column:
    """Payload JSON. Places and spelling of the names vary with the event id."""
    nested = F.to_json(
        F.struct(
            F.struct(
                F.col("level").alias("level"), F.col("rule_name").alias("description")
            ).alias("rule"),
            F.struct(
                F.when(_i() % 2 == 0, F.col("hostname")).alias("Name"),
                F.col("host_id").alias("id"),
            ).alias("agent"),
            F.struct(F.when(_i() % 2 == 1, F.col("hostname")).alias("name")).alias("manager"),
            F.struct(
                F.when(_i() % 3 == 0, F.col("src_ip")).alias("srcip"),
                F.when(_i() % 3 != 0, F.col("src_ip")).alias("SRC_IP"),
                F.when(_i() % 2 == 0, F.col("username")).alias("user"),
                F.when(_i() % 2 == 1, F.col("username")).alias("dstuser"),
                F.col("uid").alias("userId"),
                F.col("file_hash").alias("md5"),
                F.when(_i() % 2 == 0, F.col("dst_ip")).alias("DstIp"),
                F.when(_i() % 2 == 1, F.col("dst_ip")).alias("dst_ip"),
                F.col("domain"),
                F.when(_i() % 4 == 2, F.col("process_name")).alias("image"),
                F.when(_i() % 4 != 2, F.col("process_name")).alias("Process_Name"),
                F.col("process_path").alias("path"),
            ).alias("data"),
        )
    )
    flat = F.to_json(
        F.struct(
            F.col("hostname"),
            F.col("host_id").alias("HOST_ID"),
            F.col("username"),
            F.col("uid").alias("user_id"),
            F.col("src_ip").alias("Src_Ip"),
            F.col("file_hash"),
            F.col("dst_ip"),
            F.col("domain"),
            F.col("process_name").alias("Process_name"),
            F.col("process_path"),
        )
    )
    return F.when(F.col("siem_name") == "simulator", flat).otherwise(nested)


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    level = F.when((_i() % 2 == 1) | (F.col("siem_name") == "simulator"), F.col("level"))
    return facts(spark, sf).select(
        "alert_id", "siem_name", "ts", "rule_name", "alert_type",
        level.alias("original_severity"),
        payload().alias("payload"),
    )


def assets(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.alias("pos"),
        F.concat(F.lit("host-"), _text(k)).alias("host_id"),
        F.concat(F.lit("srv-"), _text(k % 40)).alias("hostname"),
        F.concat(F.lit("10.0."), _text(k % 8), F.lit("."), _text(k % 50)).alias("ip"),
        (F.col("s_nationkey") % 6).cast("int").alias("criticality"),
        F.when(k % 2 == 0, F.lit("prod")).otherwise(F.lit("dev")).alias("environment"),
        F.concat(F.lit("owner"), _text(F.col("s_nationkey"))).alias("owner"),
        F.when(k % 5 != 0, F.concat(F.lit("team"), _text(F.col("s_nationkey") % 3))).alias("team"),
    )


def identities(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("pos"),
        F.concat(F.lit("u-"), _text(k)).alias("user_id"),
        F.concat(F.lit("user"), _text(k)).alias("username"),
        (F.col("c_mktsegment") == "MACHINERY").alias("privileged"),
        F.col("c_mktsegment").alias("department"),
        (F.col("c_acctbal") < 0).alias("is_service_account"),
    )


def intel(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.alias("pos"),
        F.concat(F.lit("10.0."), _text(k % 8), F.lit("."), _text(k % 50)).alias("src_ip"),
        F.when(k % 3 == 0, F.concat(F.lit("hash"), _text(k % 30))).alias("file_hash"),
        F.col("p_size").alias("reputation"),
        F.col("p_brand").alias("source"),
        F.array(F.lower("p_type")).alias("tags"),
    )


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """One response document per event, in one of six envelopes around two alerts."""
    f = facts(spark, sf)
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+0000"))
    first = F.to_json(
        F.struct(
            F.col("alert_id").alias("id"),
            F.when(_i() % 10 != 0, stamp).alias("timestamp"),
            F.struct(
                F.col("rule_name").alias("description"), _text(_i() % 90).alias("id"),
                F.col("level").alias("level"),
            ).alias("rule"),
            F.struct(F.col("src_ip").alias("srcip")).alias("data"),
        )
    )
    second = F.to_json(
        F.struct(
            F.concat("alert_id", F.lit("b")).alias("_id"),
            stamp.alias("@timestamp"),
            F.struct(F.col("rule_name").alias("name"), F.lit("x7").alias("level")).alias("rule"),
            F.col("alert_type"),
        )
    )
    both = F.concat(F.lit("["), first, F.lit(","), second, F.lit("]"))
    cursor = F.concat(F.lit(',"cursor":'), _text(_i() + 1), F.lit("}"))
    kind = _i() % 6
    document = (
        F.when(kind == 0, F.concat(F.lit('{"data":{"affected_items":'), both, F.lit("}"), cursor))
        .when(kind == 1, F.concat(F.lit('{"data":{"affected_items":"none","items":'), both,
                                  F.lit('},"next_cursor":"n'), _text(_i()), F.lit('"}')))
        .when(kind == 2, F.concat(F.lit('{"data":'), both, cursor))
        .when(kind == 3, F.concat(F.lit('{"alerts":'), both, F.lit("}")))
        .when(kind == 4, both)
        .otherwise(first)
    )
    return f.select(document.alias("document"))


def logs(spark: SparkSession, sf: str) -> DataFrame:
    """All-string dataset rows for the heuristics; ordered by time, then event."""
    e = events(spark, sf)
    text = _by_event(
        error="sudo: user=root COMMAND=/bin/sh",
        click="powershell -File a.ps1",
        view="authentication success",
        signup="sshd: Accepted publickey",
        purchase="Installation completed",
    )
    agent = F.when(
        _i() % 17 == 0, F.concat(F.lit("agent "), _text(_u() % 30))
    ).otherwise(
        F.to_json(
            F.struct(
                F.when(_u() % 30 != 7, F.concat(F.lit("a"), _text(_u() % 30))).alias("id"),
                F.when(_u() % 2 == 0, F.concat(F.lit("node"), _text(_u() % 30))).alias("name"),
                F.when(_i() % 23 != 0, F.concat(F.lit("10.1.0."), _text(_i() % 4))).alias("ip"),
            )
        )
    )
    rule = F.to_json(
        F.struct(_text(_i() % 100).alias("id"), _by_event(**RULES).alias("description"))
    )
    return e.select(
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        _text(_i()).alias("id"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        rule.alias("rule"),
        agent.alias("agent"),
        F.concat(F.lit("loc"), _text(_u() % 5)).alias("location"),
        F.when(_i() % 9 == 0, F.concat(text, F.lit(" self-signed"))).otherwise(text).alias("full_log"),
    )


LOG_ORDER = ["ts", "event_id"]


def documents_as_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as JSON logs: ``document`` plus the order column ``doc_id``."""
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id",
        F.to_json(
            F.struct(
                "text", "lang", "source",
                F.struct(F.col("n_chars").alias("n"), F.col("lang").alias("l")).alias("meta"),
                (F.col("n_chars") % 2 == 0).alias("even"),
            )
        ).alias("document"),
    )


def annotated(spark: SparkSession, sf: str) -> DataFrame:
    goal = F.concat(
        F.lit("Quality "), _text(F.col("quality")), F.lit(", toxic "), _text(F.col("toxic"))
    )
    return table(spark, sf, "labels").select(
        _text(F.col("doc_id")).alias("dataset_id"),
        F.when(F.col("doc_id") % 4 != 0, goal).alias("detection_goal"),
        F.when(
            F.col("doc_id") % 3 != 0,
            F.concat(F.lit("  <rule id=\""), _text(F.col("doc_id")), F.lit("\"/>\n")),
        ).alias("completion"),
        F.concat(F.lit("<old id=\""), _text(F.col("doc_id")), F.lit("\"/>")).alias("rule_xml"),
    )


def document_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(
        _text(F.col("doc_id")).alias("id"),
        F.concat(F.lit("t"), _text(F.col("n_chars"))).alias("timestamp"),
        F.when(
            F.col("doc_id") % 3 == 0,
            F.concat(F.lit('{"id":"'), _text(F.col("doc_id") % 50), F.lit('"}')),
        ).when(F.col("doc_id") % 3 == 1, F.lit("plain rule")).otherwise(F.lit("")).alias("rule"),
        F.concat(F.lit('{"name":"'), F.col("source"), F.lit('"}')).alias("agent"),
        F.col("source").alias("location"),
        F.col("text").alias("full_log"),
    )


def entries(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("pos"),
        F.col("source").alias("title"),
        F.col("text").alias("content"),
        F.array(
            F.concat(F.lit(" run "), _text(F.col("doc_id")), F.lit(" ")), F.lit("  ")
        ).alias("commands"),
        F.array(F.col("lang")).alias("tags"),
    )


def topics(spark: SparkSession, sf: str) -> DataFrame:
    """The whole text of each benchmark item; some ask for nothing or for nonsense."""
    b = table(spark, sf, "benchmark")
    item = F.col("item_id")
    return b.select(
        item.alias("query_id"),
        F.when(item % 10 == 3, F.lit(""))
        .when(item % 10 == 7, F.lit("zzqx qqzx"))
        .otherwise(F.col("text"))
        .alias("query"),
    )


def case_events(spark: SparkSession, sf: str) -> DataFrame:
    """Open, evidence and close events per user, and purchases, a kind that cases ignore."""
    t = F.col("event_type")
    return table(spark, sf, "events").select(
        F.concat(F.lit("case-"), _text(_u())).alias("case_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        _i().alias("seq"),
        F.when(t.isin("signup", "click"), F.lit("open"))
        .when(t == "view", F.lit("evidence"))
        .when(t == "purchase", F.lit("purchase"))
        .otherwise(F.lit("close"))
        .alias("kind"),
        F.concat(F.lit("summary "), _text(_i())).alias("summary"),
        _text(_i() % 100).alias("severity"),
        F.concat(F.lit("wazuh:"), _text(_i())).alias("alert_key"),
        F.when(
            t.isin("error", "purchase"), F.when(_i() % 2 == 0, F.lit("FalsePositive")).otherwise(F.lit("Closed"))
        ).alias("status"),
        F.concat(F.lit("seen "), _text(_i())).alias("description"),
    )


def audit_entries(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("event_type")
    return table(spark, sf, "events").select(
        F.concat(F.lit("e"), _text(_i())).alias("entry_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("c"), _text(_u())).alias("correlation_id"),
        F.lit("Execution").alias("component"),
        F.when(t == "error", F.lit("ActionResult"))
        .when(t == "purchase", F.lit("actionresult"))
        .otherwise(F.lit("Note"))
        .alias("event_type"),
        F.lit("m").alias("message"),
        F.create_map(
            F.lit("status"),
            F.when(t == "error", F.lit("Failed"))
            .when(t == "purchase", F.lit("Succeeded"))
            .otherwise(F.lit("Failed")),
        ).alias("data"),
    )
