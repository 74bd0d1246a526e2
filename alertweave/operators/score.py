"""Threat assessments: scenario table, keyword scorer, fallbacks (J-12, J-14, P-34, A-12, P-31)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions.actions import PARAMS_DDL
from ..functions.text import contains_any

RECOMMENDED_DDL = "array<struct<type:string,params:map<string,string>,rationale:string>>"
ASSESSMENT_DDL = (
    "struct<confidence:double,severity:int,hypothesis:string,evidence:array<string>,"
    f"recommended:{RECOMMENDED_DDL}>"
)


def assessment(
    confidence: Column,
    severity: Column,
    hypothesis: Column,
    evidence: Column,
    recommended: Column | None = None,
) -> Column:
    return F.struct(
        confidence.cast("double").alias("confidence"),
        severity.cast("int").alias("severity"),
        hypothesis.alias("hypothesis"),
        evidence.cast("array<string>").alias("evidence"),
        (F.lit(None) if recommended is None else recommended)
        .cast(RECOMMENDED_DDL)
        .alias("recommended"),
    ).cast(ASSESSMENT_DDL)


def scenario() -> Column:
    """Scenario name: the tag if the alert carries one, else its type, else benign noise."""
    return F.coalesce(
        F.try_element_at(F.col("tags"), F.lit("scenario_type")),
        F.col("alert_type"),
        F.lit("BenignNoise"),
    )


def _scenario_case(name: Column, position: int, default) -> Column:
    out = None
    for key, values in K.SCENARIO_SCORES.items():
        value = F.lit(values[position])
        out = F.when(name == key, value) if out is None else out.when(name == key, value)
    return out.otherwise(F.lit(default))


def scenario_score(enriched: DataFrame) -> DataFrame:
    """Add ``scenario`` and ``assessment`` from the fixed scenario table."""
    name = F.col("scenario")
    e = F.col("entities")
    recommended = None
    for key, (action_type, params, why) in K.SCENARIO_ACTIONS.items():
        pairs = []
        for param, (entity, default) in params.items():
            pairs += [F.lit(param), F.coalesce(e[entity], F.lit(default))]
        one = F.array(
            F.struct(
                F.lit(action_type).alias("type"),
                F.create_map(*pairs).cast(PARAMS_DDL).alias("params"),
                F.lit(why).alias("rationale"),
            )
        )
        branch = name == key
        recommended = F.when(branch, one) if recommended is None else recommended.when(branch, one)
    hypothesis = F.when(name.isin(K.BENIGN_SCENARIOS), F.lit(K.BENIGN_TEXT)).otherwise(
        F.lit(K.SUSPICIOUS_TEXT)
    )
    return enriched.withColumn("scenario", scenario()).withColumn(
        "assessment",
        assessment(
            _scenario_case(name, 0, K.SCENARIO_DEFAULT[0]),
            _scenario_case(name, 1, K.SCENARIO_DEFAULT[1]),
            hypothesis,
            F.array(F.concat(F.lit("scenario:"), name)),
            recommended,
        ),
    )


def keyword_assessment(rule_name: Column, alert_type: Column, severity: Column) -> Column:
    """First keyword group found in rule name and type decides, else the severity, else a default."""
    text = F.lower(
        F.concat(F.coalesce(rule_name, F.lit("")), F.lit(" "), F.coalesce(alert_type, F.lit("")))
    )
    out = None
    for words, sev, conf, hypothesis, evidence in K.KEYWORD_SCORES:
        value = assessment(F.lit(conf), F.lit(sev), F.lit(hypothesis), F.array(F.lit(evidence)))
        branch = contains_any(text, words)
        out = F.when(branch, value) if out is None else out.when(branch, value)
    conf, hypothesis, evidence = K.SEVERITY_SCORE
    out = out.when(
        severity.isNotNull(),
        assessment(
            F.lit(conf),
            F.greatest(F.lit(0), F.least(F.lit(100), severity)),
            F.lit(hypothesis),
            F.array(F.lit(evidence)),
        ),
    )
    sev, conf, hypothesis, evidence = K.DEFAULT_SCORE
    return out.otherwise(
        assessment(F.lit(conf), F.lit(sev), F.lit(hypothesis), F.array(F.lit(evidence)))
    )


def keyword_score(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn(
        "assessment",
        keyword_assessment(F.col("rule_name"), F.col("alert_type"), F.col("severity")),
    )


def constant_assessment(confidence: float, severity: int, hypothesis: Column, evidence: Column):
    return assessment(F.lit(confidence), F.lit(severity), hypothesis, evidence)


def unavailable() -> Column:
    conf, sev, hyp, _ = K.SCORER_UNAVAILABLE
    return constant_assessment(conf, sev, F.lit(hyp), F.array())


def failed(error_type: Column, message: Column) -> Column:
    conf, sev, text = K.SCORER_ERROR
    prefix = text.replace("{error}", "")
    return constant_assessment(conf, sev, F.concat(F.lit(prefix), error_type), F.array(message))


def last_resort() -> Column:
    conf, sev, hyp, evidence = K.SCORER_LAST_RESORT
    return constant_assessment(conf, sev, F.lit(hyp), F.array(*[F.lit(x) for x in evidence]))


def with_replies(
    alerts: DataFrame,
    sources: list[DataFrame],
    fallback: str = "rules",
    key: str = "alert_id",
) -> DataFrame:
    """First non-null assessment among external score tables, then the fallback.

    Every source has one row per ``key`` and columns ``assessment`` and, optionally,
    ``error_type`` and ``error_message`` for a scorer that failed. ``fallback`` is
    ``rules`` (keyword scorer), ``unavailable`` or ``last_resort``.
    """
    out = alerts
    found = []
    for i, source in enumerate(sources):
        value = F.col("assessment").cast(ASSESSMENT_DDL)
        if "error_type" in source.columns:
            value = F.coalesce(
                value,
                F.when(
                    F.col("error_type").isNotNull(),
                    failed(F.col("error_type"), F.col("error_message")),
                ),
            )
        out = out.join(source.select(key, value.alias(f"_s{i}")), key, "left")
        found.append(F.col(f"_s{i}"))
    end = {
        "rules": lambda: keyword_assessment(
            F.col("rule_name"), F.col("alert_type"), F.col("severity")
        ),
        "unavailable": unavailable,
        "last_resort": last_resort,
    }[fallback]()
    return out.withColumn("assessment", F.coalesce(*found, end)).drop(
        *[f"_s{i}" for i in range(len(sources))]
    )


def canonical_key(json_text: Column) -> Column:
    """Same text for equal JSON objects: the variant form stores names in sorted order."""
    return F.to_json(F.try_parse_json(json_text))


def score_distinct(
    alerts: DataFrame,
    scorer: Callable[[DataFrame], DataFrame],
    json_column: str = "request",
) -> DataFrame:
    """Run ``scorer`` once per distinct request and give every alert its score back.

    ``scorer`` receives one row per distinct ``score_key`` and adds ``assessment``;
    it is the place for a costly model, for example a pandas UDF. The distinct step
    combines before its shuffle. Joining back is an equi-join with one row per key on
    the scored side, so adaptive execution can split a key that covers many alerts.
    """
    keyed = alerts.withColumn(
        "score_key",
        F.coalesce(canonical_key(F.col(json_column)), F.col(json_column)),
    )
    scored = scorer(keyed.select("score_key").distinct()).select("score_key", "assessment")
    return keyed.join(scored, "score_key", "left")


def explain(scored: DataFrame) -> DataFrame:
    """Summary and details of an external assessment."""
    a = F.col("assessment")
    return scored.select("alert_id", a["hypothesis"].alias("summary"),
                         a["evidence"].alias("details"))


def explain_scenario(scored: DataFrame) -> DataFrame:
    """Summary and details of the fixed scenario table."""
    return scored.select(
        "alert_id",
        F.concat(F.lit("Stub explanation for "), F.col("scenario"), F.lit(".")).alias("summary"),
        F.array(
            F.lit("Deterministic stub scorer."), F.concat(F.lit("scenario="), F.col("scenario"))
        ).alias("details"),
    )
