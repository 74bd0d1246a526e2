"""Training pairs, training text and log extracts (P-25..P-27, J-5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions.json_access import single_value
from ..functions.text import empty_to_null, py_strip


def keyed_rows(dataset: DataFrame, key: str, order_by: list[str]) -> DataFrame:
    """Last row per key, as a keyed load keeps it; combines before the shuffle."""
    columns = dataset.columns
    rest = [c for c in columns if c not in order_by]
    return (
        dataset.groupBy(F.col(f"`{key}`").alias("_key"))
        .agg(F.max(F.struct(*[F.col(f"`{c}`") for c in (*order_by, *rest)])).alias("_last"))
        .select(*[F.col("_last")[c].alias(c) for c in columns])
    )


def join_annotations(annotations: DataFrame, dataset: DataFrame, key: str = "id") -> DataFrame:
    """Annotations with their dataset row; Spark picks the join by the sides' sizes."""
    row = F.struct(*[F.col(f"`{c}`") for c in dataset.columns]).alias("row")
    return annotations.join(
        dataset.select(F.col(key).alias("dataset_id"), row), "dataset_id", "inner"
    )


def missing_annotations(
    annotations: DataFrame, dataset: DataFrame, key: str = "id"
) -> DataFrame:
    return annotations.join(
        dataset.select(F.col(key).alias("dataset_id")), "dataset_id", "left_anti"
    )


def require_complete(annotations: DataFrame, dataset: DataFrame, key: str = "id") -> None:
    """Raise when an annotation has no dataset row. Looks for one example only."""
    gap = missing_annotations(annotations, dataset, key).select("dataset_id").take(1)
    if gap:
        raise KeyError(f"No row found for dataset_id {gap[0][0]}.")


def prompt_and_completion(
    joined: DataFrame, fields: list[str] | None = None
) -> DataFrame:
    """Add ``prompt``, ``completion`` and ``pair_error`` to annotations joined to rows."""
    fields = K.PAIR_FIELDS if fields is None else fields
    row_type = joined.schema["row"].dataType
    present = [f for f in fields if f in row_type.names]
    row = F.col("row")
    block = F.concat_ws(
        "\n",
        F.array_compact(
            F.array(
                *[
                    F.when(F.length(row[f]) > 0, F.concat(F.lit(f"{f}: "), row[f]))
                    for f in present
                ]
            ).cast("array<string>")
        ),
    )
    described = (
        F.when(
            F.length(row["rule"]) > 0, F.concat(F.lit("Current description: "), row["rule"])
        )
        if "rule" in row_type.names
        else F.lit(None).cast("string")
    )
    goal = F.coalesce(F.col("detection_goal"), F.lit(K.PAIR_GOAL_DEFAULT))
    prompt = F.concat_ws(
        "\n\n",
        F.lit(K.PAIR_INTRO),
        F.concat(F.lit("Detection goal: "), goal),
        F.lit("Sample log event:"),
        block,
        described,
        F.lit(K.PAIR_OUTRO),
    )
    texts = [F.col(c) for c in ("completion", "rule_xml") if c in joined.columns]
    answer = F.coalesce(*texts)
    return joined.withColumns(
        {
            "prompt": prompt,
            "pair_error": F.when(
                F.coalesce(F.length(answer), F.lit(0)) == 0,
                F.lit("Each annotation entry must provide 'completion' or 'rule_xml'."),
            ),
            "completion": py_strip(answer),
        }
    )


def training_pairs(
    annotations: DataFrame,
    dataset: DataFrame,
    key: str = "id",
    fields: list[str] | None = None,
    strict: bool = True,
) -> DataFrame:
    """``dataset_id, prompt, completion`` rows. ``strict`` raises on missing rows or texts."""
    if strict:
        require_complete(annotations, dataset, key)
    built = prompt_and_completion(join_annotations(annotations, dataset, key), fields)
    if strict:
        bad = built.filter(F.col("pair_error").isNotNull()).select("pair_error").take(1)
        if bad:
            raise ValueError(bad[0][0])
    return built.filter(F.col("pair_error").isNull()).select("dataset_id", "prompt", "completion")


def training_text(examples: DataFrame) -> DataFrame:
    """Add ``text``: prompt (or goal), blank line, completion (or response)."""

    def pick(*names: str) -> Column:
        found = [empty_to_null(n) for n in names if n in examples.columns]
        return py_strip(F.coalesce(*found, F.lit("")))

    prompt = empty_to_null(pick("prompt", "detection_goal"))
    completion = empty_to_null(pick("completion", "response"))
    return examples.withColumn("text", F.concat_ws("\n\n", prompt, completion))


def json_or_text(value: Column) -> Column:
    """JSON text of a field: its own JSON if it parses, a JSON string if not, {} if blank."""
    stripped = py_strip(F.coalesce(value, F.lit("")))
    parsed = single_value(stripped)
    quoted = F.regexp_extract(F.to_json(F.array(stripped)), r"(?s)^\[(.*)\]$", 1)
    is_json = parsed.isNotNull() | (stripped == "null")
    return F.when(stripped == "", F.lit("{}")).when(is_json, stripped).otherwise(quoted)


def log_extracts(annotations: DataFrame, dataset: DataFrame, key: str = "id") -> DataFrame:
    """One extract per annotated row, with rule and agent as JSON and the log cut short."""
    row = F.col("row")
    names = dataset.columns
    location = row["location"] if "location" in names else F.lit("")
    return join_annotations(annotations.select("dataset_id"), dataset, key).select(
        "dataset_id",
        row["id"].alias("id"),
        row["timestamp"].alias("timestamp"),
        json_or_text(row["rule"]).alias("rule"),
        json_or_text(row["agent"]).alias("agent"),
        F.coalesce(location, F.lit("")).alias("location"),
        F.substring(F.coalesce(row["full_log"], F.lit("")), 1, K.EXTRACT_EXCERPT).alias(
            "full_log"
        ),
    )


def extract_document(extracts: DataFrame) -> DataFrame:
    """JSON array text of each extract, ready to be written under its dataset id."""

    def text(name: str) -> Column:
        return F.regexp_extract(F.to_json(F.array(F.col(name))), r"(?s)^\[(.*)\]$", 1)

    body = F.concat(
        F.lit('[{"id":'), text("id"),
        F.lit(',"timestamp":'), text("timestamp"),
        F.lit(',"rule":'), F.col("rule"),
        F.lit(',"agent":'), F.col("agent"),
        F.lit(',"location":'), text("location"),
        F.lit(',"full_log":'), text("full_log"),
        F.lit("}]"),
    )
    return extracts.select("dataset_id", body.alias("value"))
