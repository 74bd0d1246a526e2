"""Readers for logs, dimensions, audit entries, datasets, annotations, knowledge (S-5 .. S-11)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions.json_access import single_value
from ..functions.staging import pin
from ..functions.text import non_blank, parse_instant
from ..operators.ordered import with_position
from ..operators.policy import PolicyConfig
from . import commits, csv_records, json_ranges


# --- S-5 / U-1 -------------------------------------------------------------------


def parse_log_files(files: DataFrame) -> DataFrame:
    """Files (``path``, ``value``) to log documents, in file order.

    A file is one object, an array, or one JSON value per line. ``error`` marks files that
    hold a scalar and lines that are not JSON. Output: ``path, pos, document, error``.
    """
    text = F.trim(F.regexp_replace("value", r"^﻿", ""))
    whole = single_value(text)
    lines = F.filter(F.split("value", r"\r\n|[\r\n]"), lambda x: x.rlike(r"\S"))
    parsed = files.filter(non_blank("value")).withColumn("_whole", whole)
    w = F.col("_whole")
    documents = (
        F.when(w.isNull(), F.col("_lines"))
        .when(w.startswith("["), F.from_json(w, "array<string>"))
        .otherwise(F.array(w))
    )
    scalar = w.isNotNull() & ~w.startswith("[") & ~w.startswith("{")
    return (
        parsed.withColumn("_lines", F.when(w.isNull(), lines))
        .withColumn(
            "_file_error",
            F.when(scalar, F.lit("Log file must contain a JSON object or array.")),
        )
        .select("path", "_file_error", F.posexplode(documents).alias("pos", "document"))
        .withColumn("error", F.coalesce("_file_error", _line_error()))
        .drop("_file_error")
    )


def _line_error() -> Column:
    return F.when(single_value(F.col("document")).isNull(), F.lit("Line is not valid JSON."))


#: Size from which ``read_logs`` looks into a file by ranges.
LARGE_FILE = 64 << 20


def read_logs(
    spark: SparkSession, paths: str | list[str], layout: str = "auto", large: int = LARGE_FILE
) -> DataFrame:
    """JSON logs as ``path, pos, document, error``, files in sorted order.

    ``auto`` tells an object, an array and lines apart like the tolerant loader does: small
    files as whole rows, files of ``large`` bytes or more by ranges, where an array is cut into its elements
    and lines stay lines, each in as many tasks as the file has splits. In large files of lines,
    and with ``lines``, ``pos`` orders lines within a file by offset block.
    """
    if layout == "lines":
        return _log_lines(spark.read.text(paths))
    size = F.col("_metadata.file_size")
    files = spark.read.text(paths, wholetext=True).filter(size < large)
    small = parse_log_files(files.select(F.col("_metadata.file_path").alias("path"), "value"))
    listed = spark.read.format("binaryFile").load(paths).select("path", "length")
    big = [r.path for r in listed.filter(F.col("length") >= large).select("path").collect()]
    return small.unionByName(_large_logs(spark, big)) if big else small


def _log_lines(lines: DataFrame) -> DataFrame:
    return (
        lines.select(
            F.col("_metadata.file_path").alias("path"),
            (
                F.col("_metadata.file_block_start") * F.lit(1 << 20)
                + F.monotonically_increasing_id() % F.lit(1 << 33)
            ).alias("pos"),
            F.col("value").alias("document"),
        )
        .filter(non_blank("document"))
        .withColumn("error", _line_error())
    )


def _large_logs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Large files by what their structure and then their elements show them to be."""
    pieces = json_ranges.split_pieces(spark, paths)
    starts, shapes = json_ranges.fold(json_ranges.summaries(pieces))
    arrays = {p: f for p, f in shapes.items() if f.single and f.first == "["}
    objects = [p for p, f in shapes.items() if f.single and f.first == "{"]
    of = lambda reader, chosen: reader.filter(F.col("_metadata.file_path").isin(list(chosen)))
    found = None
    if arrays:
        mine = pieces.filter(F.col("path").isin(list(arrays)))
        every = json_ranges.elements(mine, starts, arrays)
        # An element as the array's parser gives it: compact JSON, or the text of a string.
        parsed = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>")
        value = F.concat(F.lit("["), "value", F.lit("]"))
        bad = every.filter(single_value(value).isNull() | (F.size(parsed) != 1))
        broken = [r.path for r in bad.select("path").distinct().collect()]
        arrays = {p: f for p, f in arrays.items() if p not in broken}
        found = every.filter(F.col("path").isin(list(arrays))).select(
            "path", F.col("pos").cast("bigint").alias("pos"), F.get(parsed, F.lit(0)).alias("document")
        ).withColumn("error", _line_error())
    rest = [p for p in shapes if p not in arrays and p not in objects]
    parts = [found] if found is not None else []
    if objects:
        files = of(spark.read.text(paths, wholetext=True), objects)
        parts.append(parse_log_files(files.select(F.col("_metadata.file_path").alias("path"), "value")))
    if rest:
        parts.append(_log_lines(of(spark.read.text(paths), rest)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- S-6 -------------------------------------------------------------------------


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def _array_elements(files: DataFrame) -> DataFrame:
    """The objects of JSON arrays in ``value``, by place, with the other columns of the row."""
    kept = [c for c in files.columns if c != "value"]
    return files.select(
        *kept, F.posexplode(F.from_json("value", "array<map<string,string>>")).alias("pos", "_m")
    )


def _field(name: str) -> Column:
    """Value of a camelCase name, read in any case; the last spelling counts."""
    hits = F.filter(F.map_entries("_m"), lambda e: F.lower(e["key"]) == name.lower())
    return F.try_element_at(hits, F.lit(-1))["value"]


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """Asset records in array order (``pos``): the first matching record wins later."""
    return parse_assets(_whole_files(spark, path))


def parse_assets(files: DataFrame) -> DataFrame:
    kept = [c for c in files.columns if c != "value"]
    return _array_elements(files).select(
        *kept,
        "pos",
        _field("hostId").alias("host_id"),
        _field("hostname").alias("hostname"),
        _field("ip").alias("ip"),
        F.coalesce(_field("criticality").try_cast("int"), F.lit(0)).alias("criticality"),
        _field("environment").alias("environment"),
        _field("owner").alias("owner"),
        _field("team").alias("team"),
    )


def read_identities(spark: SparkSession, path: str) -> DataFrame:
    return parse_identities(_whole_files(spark, path))


def parse_identities(files: DataFrame) -> DataFrame:
    kept = [c for c in files.columns if c != "value"]
    return _array_elements(files).select(
        *kept,
        "pos",
        _field("userId").alias("user_id"),
        _field("username").alias("username"),
        F.coalesce(_field("privileged").try_cast("boolean"), F.lit(False)).alias("privileged"),
        _field("department").alias("department"),
        F.coalesce(_field("isServiceAccount").try_cast("boolean"), F.lit(False)).alias(
            "is_service_account"
        ),
    )


def read_intel(spark: SparkSession, path: str) -> DataFrame:
    return parse_intel(_whole_files(spark, path))


def parse_intel(files: DataFrame) -> DataFrame:
    kept = [c for c in files.columns if c != "value"]
    return _array_elements(files).select(
        *kept,
        "pos",
        _field("srcIp").alias("src_ip"),
        _field("fileHash").alias("file_hash"),
        F.coalesce(_field("reputationScore").try_cast("int"), F.lit(0)).alias("reputation"),
        _field("source").alias("source"),
        F.from_json(_field("tags"), "array<string>").alias("tags"),
    )


# --- S-8 -------------------------------------------------------------------------

AUDIT_SCHEMA = (
    "entryId string, timestampUtc string, correlationId string, component string, "
    "eventType string, message string, data map<string,string>, _corrupt_record string"
)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit entries from JSON lines; blank and malformed lines are dropped."""
    if "*" not in path and not _exists(spark, path):
        return parse_audit(spark.createDataFrame([], "value string"))
    return parse_audit(spark.read.text(path))


def parse_audit(lines: DataFrame) -> DataFrame:
    """Audit entries of the JSON lines in ``value``."""
    e = F.from_json(
        "value", AUDIT_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    )
    parsed = pin(lines.filter(non_blank("value")), {"_e": e}).select("_e.*")
    return parsed.filter(
        F.col("_corrupt_record").isNull() & F.col("timestampUtc").isNotNull()
    ).select(
        F.col("entryId").alias("entry_id"),
        parse_instant("timestampUtc").alias("ts"),
        F.col("correlationId").alias("correlation_id"),
        "component",
        F.col("eventType").alias("event_type"),
        "message",
        "data",
    )


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return target.getFileSystem(conf).exists(target)


# --- S-9 -------------------------------------------------------------------------


def file_order() -> Column:
    """Sortable place of a row in its files: path, split start, running number in the task."""
    return F.struct(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"),
    )


def read_dataset(
    spark: SparkSession, path: str | list[str], row_order: str | None = None
) -> DataFrame:
    """All-string CSV with a header and quoted multi-line values; empty stays empty text.

    A file is read by as many tasks as it has splits. ``row_order`` names a sortable column
    with the file order of the rows. Of a dataset with manifests, committed appends are read.
    """
    if isinstance(path, str) and (folders := commits.committed(spark, path)):
        path = folders
    return csv_records.read_records(spark, path, row_order)


# --- S-10 ------------------------------------------------------------------------


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotations from a JSON list; anything but a list is an error."""
    return parse_annotations(_whole_files(spark, path))


def parse_annotations(text: DataFrame) -> DataFrame:
    shape = (
        "array<struct<dataset_id:string,detection_goal:string,completion:string,rule_xml:string>>"
    )
    is_list = F.ltrim("value").startswith("[") & single_value(F.trim("value")).isNotNull()
    checked = F.when(is_list, F.from_json("value", shape)).otherwise(
        F.raise_error(F.lit("Annotations file must contain a list of entries.")).cast(shape)
    )
    return text.select(F.posexplode(checked).alias("pos", "a")).select("pos", "a.*")


# --- S-11 ------------------------------------------------------------------------


def read_knowledge(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Knowledge entries from JSON lines, in file order, with defaults filled in."""
    lines = spark.read.text(path).select("value", file_order().alias("_order"))
    return with_position(parse_knowledge(lines), ["_order"], "pos").drop("_order", "total")


def parse_knowledge(lines: DataFrame) -> DataFrame:
    """Entries of the JSON lines in ``value``, beside the other columns."""
    shape = "title string, content string, commands array<string>, tags array<string>"
    kept = [c for c in lines.columns if c != "value"]
    raw = pin(lines, {"_e": F.from_json("value", shape)}).select(*kept, "_e.*")
    empty = F.array().cast("array<string>")
    present = (
        F.coalesce("title", "content").isNotNull()
        | F.col("commands").isNotNull()
        | F.col("tags").isNotNull()
    )
    return raw.filter(present).select(
        *kept,
        F.coalesce("title", F.lit("untitled")).alias("title"),
        F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce("commands", empty).alias("commands"),
        F.coalesce("tags", empty).alias("tags"),
    )


# --- small settings files --------------------------------------------------------


def _settings_text(spark: SparkSession, path: str) -> str:
    """A settings file through Spark, so any store that the cluster reads will do."""
    return "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def load_policy(
    spark: SparkSession, path: str | None, fallback: PolicyConfig | None = None
) -> PolicyConfig:
    """Policy settings; a path that does not exist, a blank file and missing values fall back.

    A file that is there but cannot be read, or is no JSON, is an error.

    Names read in any case, unknown actions are dropped, and an empty action list means
    the default list. Environment lists may be empty.
    """
    fallback = fallback or PolicyConfig()
    if path is None or not _exists(spark, path):
        return fallback
    text = _settings_text(spark, path)
    if not text.strip():
        return fallback
    raw = json.loads(text)
    if raw is None:
        return fallback
    values = {k.lower(): v for k, v in raw.items()}
    names = {t.lower(): t for t in K.ACTION_TYPES}
    d = K.POLICY_DEFAULTS

    def scalar(name: str):
        value = values.get(name.lower())
        return d[name] if value is None else value

    def known(items) -> tuple[str, ...]:
        return tuple(names[i.lower()] for i in items if i and i.lower() in names)

    def actions(name: str) -> tuple[str, ...]:
        value = values.get(name.lower())
        found = known(value) if value is not None else ()
        return found or tuple(d[name])

    env = values.get("forbiddenactionsbyenvironment")
    environments = {k.lower(): known(v or []) for k, v in (env or {}).items()}
    if not environments:
        environments = {k: tuple(v) for k, v in d["forbiddenActionsByEnvironment"].items()}
    return PolicyConfig(
        min_confidence=float(scalar("minConfidenceForAutonomy")),
        risk_threshold=int(scalar("riskApprovalThreshold")),
        impact_threshold=int(scalar("impactApprovalThreshold")),
        max_actions=int(scalar("maxActionsPerPlan")),
        critical_threshold=int(scalar("criticalAssetThreshold")),
        safe=actions("safeLowConfidenceActions"),
        prod_approval=actions("requireApprovalInProd"),
        privileged_approval=actions("requireApprovalOnPrivilegedIdentities"),
        critical_approval=actions("requireApprovalOnCriticalAssets"),
        privileged_forbidden=actions("forbidActionsOnPrivilegedIdentities"),
        critical_forbidden=actions("forbidActionsOnCriticalAssets"),
        environment_forbidden=environments,
    )


def load_response_actions(spark: SparkSession, path: str | None) -> dict[str, list[str]]:
    """Severity to action list; keys lower-cased, ``default`` added when missing."""
    if path is None:
        raw = K.RESPONSE_ACTIONS
    else:
        raw = json.loads(_settings_text(spark, path))
        if not isinstance(raw, dict):
            raise ValueError("Action map must be a JSON object.")
    out = {k.lower(): list(v) for k, v in raw.items()}
    out.setdefault("default", [])
    return out
