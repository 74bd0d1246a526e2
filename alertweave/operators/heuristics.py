"""Keyword heuristics, address changes and response plans (P-22..P-24, W-1, W-2, J-11, A-6).

Input rows are the all-string dataset: ``id, timestamp, rule, agent, full_log`` plus the
columns of a total row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions.json_access import MAP_TYPE, wrapped_values
from ..functions.staging import pin
from ..functions.text import contains_all, contains_any, empty_to_null
from .ordered import changes


def _field_text(field: str) -> Column:
    if field == "description":
        return F.lower(F.coalesce(F.col("rule_description"), F.lit("")))
    return F.lower(F.coalesce(F.col(field), F.lit("")))


def keyword_match(heuristic: dict) -> Column:
    """True when any field passes: no excluded word, all required words, one keyword."""
    out = F.lit(False)
    for field in heuristic.get("fields", []):
        text = _field_text(field)
        hit = F.lit(True)
        if heuristic.get("exclude"):
            hit = hit & ~contains_any(text, heuristic["exclude"])
        if heuristic.get("all_keywords"):
            hit = hit & contains_all(text, heuristic["all_keywords"])
        if not heuristic.get("keywords"):
            continue
        out = out | (hit & contains_any(text, heuristic["keywords"]))
    return out


def parse_rows(rows: DataFrame) -> DataFrame:
    """Add the parsed agent and rule parts; unreadable JSON counts as an empty object."""
    staged = pin(
        rows,
        {
            f"_{c}_json": wrapped_values(F.when(F.ltrim(c).startswith("{"), F.col(c)))
            for c in ("agent", "rule")
        },
    )

    def parsed(c: str) -> Column:
        values = F.col(f"_{c}_json")
        return F.from_json(F.when(F.size(values) == 1, F.get(values, F.lit(0))), MAP_TYPE)

    def part(m: str, name: str) -> Column:
        return F.try_element_at(F.col(m), F.lit(name))

    return (
        pin(staged, {"_agent": parsed("agent"), "_rule": parsed("rule")})
        .withColumn("agent_id", part("_agent", "id"))
        .withColumn("agent_name", part("_agent", "name"))
        .withColumn("agent_ip", part("_agent", "ip"))
        .withColumn("_agent_ok", F.size("_agent") > 0)
        .withColumn("rule_id", part("_rule", "id"))
        .withColumn("rule_description", part("_rule", "description"))
        .drop("_agent", "_rule", "_agent_json", "_rule_json")
    )


def _slim(parsed: DataFrame, order_by: list[str]) -> DataFrame:
    """Everything outputs need, with the log cut to the longest excerpt."""
    return parsed.select(
        *order_by,
        *[c for c in ("id", "timestamp", "agent") if c not in order_by],
        "agent_id",
        "agent_name",
        "agent_ip",
        "_agent_ok",
        "rule_id",
        "rule_description",
        F.substring(F.coalesce("full_log", F.lit("")), 1, K.RESPONSE_EXCERPT).alias("excerpt"),
        *[c for c in parsed.columns if c == "_hits"],
    )


def ip_changes(
    rows: DataFrame, order_by: list[str], partitions: int | None = None
) -> DataFrame:
    """Rows whose agent was last seen with another address (``previous_ip``).

    Rows without an agent key or address are skipped and do not count as "last seen".
    """
    slim = rows if "excerpt" in rows.columns else _slim(parse_rows(rows), order_by)
    key = F.coalesce(empty_to_null("agent_id"), empty_to_null("agent_name"))
    usable = slim.withColumn("agent_key", key).filter(
        F.col("agent_key").isNotNull() & (F.length("agent_ip") > 0)
    )
    return changes(usable, "agent_key", order_by, "agent_ip", "previous_ip", partitions)


def _table(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]).cast("array<string>"), index)


def matches(
    rows: DataFrame,
    order_by: list[str],
    limit: int = 0,
    heuristics: list[dict] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """One row per (row, heuristic) hit; ``limit`` keeps the first N hits per heuristic.

    Keyword hits come from one narrow pass; only the address-change heuristic needs
    the ordered scan. With a limit, each task keeps its own first N before the shuffle.
    """
    heuristics = K.HEURISTICS if heuristics is None else heuristics
    parsed = parse_rows(rows)
    keyword = [(i, h) for i, h in enumerate(heuristics) if not h.get("matcher")]
    # Without heuristics there are no hits, but the columns stay.
    nothing = _slim(parsed, order_by).withColumn("heuristic_no", F.lit(0)).filter(F.lit(False))
    parts = [] if heuristics else [nothing]
    if keyword:
        hits = F.array_compact(
            F.array(*[F.when(keyword_match(h), F.lit(i)) for i, h in keyword])
        )
        found = _slim(pin(parsed, {"_hits": hits}), order_by)
        parts.append(found.withColumn("heuristic_no", F.explode("_hits")).drop("_hits"))
    for i, h in enumerate(heuristics):
        if h.get("matcher") == "ip_change":
            changed = ip_changes(_slim(parsed, order_by), order_by, partitions)
            parts.append(
                changed.drop("agent_key", "previous_ip").withColumn("heuristic_no", F.lit(i))
            )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if limit > 0:
        w = Window.partitionBy("heuristic_no").orderBy(*order_by)
        out = out.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit)
        out = out.drop("_rn")
    no = F.col("heuristic_no")
    return (
        out.withColumn("heuristic", _table([h["name"] for h in heuristics], no))
        .withColumn("severity", _table([h.get("severity") for h in heuristics], no))
        .withColumn("detection_goal", _table([h.get("goal") for h in heuristics], no))
        .withColumn("example_completion", _table([h.get("completion") for h in heuristics], no))
    )


def candidates(found: DataFrame, order_by: list[str]) -> DataFrame:
    """Annotation candidates; sort by ``order_by`` and ``heuristic_no`` for source order."""
    return found.select(
        *[c for c in order_by if c not in ("id", "timestamp")],
        "heuristic_no",
        F.col("id").alias("dataset_id"),
        "timestamp",
        "heuristic",
        F.coalesce("severity", F.lit("info")).alias("severity"),
        "detection_goal",
        F.coalesce("rule_description", F.lit("")).alias("rule_description"),
        F.substring("excerpt", 1, K.CANDIDATE_EXCERPT).alias("log_excerpt"),
        "example_completion",
    )


def candidate_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("heuristic").agg(F.count("*").alias("n"))


def response_plans(
    found: DataFrame, order_by: list[str], actions: dict[str, list[str]] | None = None
) -> DataFrame:
    """Host, rule and the action list of the heuristic's severity.

    The action map is a small setting with one list per severity, so it becomes a
    literal map; unknown severities use ``default``.
    """
    actions = K.RESPONSE_ACTIONS if actions is None else actions
    lowered = {k.lower(): list(v) for k, v in actions.items()}
    lowered.setdefault("default", [])
    pairs = []
    for key, texts in lowered.items():
        pairs += [
            F.lit(key),
            F.array(*[F.lit(t) for t in texts]).cast("array<string>"),
        ]
    table = F.create_map(*pairs)
    severity = F.coalesce("severity", F.lit("default"))
    host = F.when(
        F.col("_agent_ok"),
        F.coalesce(empty_to_null("agent_name"), empty_to_null("agent_id"), F.col("agent")),
    ).otherwise(F.col("agent"))
    return found.select(
        *[c for c in order_by if c not in ("id", "timestamp")],
        "heuristic_no",
        F.col("id").alias("dataset_id"),
        "timestamp",
        host.alias("host"),
        F.when(F.col("_agent_ok"), F.col("agent_ip")).alias("ip"),
        "rule_id",
        "rule_description",
        F.col("excerpt").alias("log_excerpt"),
        "heuristic",
        "detection_goal",
        severity.alias("severity"),
        F.coalesce(
            F.try_element_at(table, F.lower(severity)),
            F.try_element_at(table, F.lit("default")),
        ).alias("actions"),
    )
