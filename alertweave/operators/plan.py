"""Response plans: strategy, actions, risk, order, rollback, texts (P-8 .. P-17).

All steps are array expressions inside the alert's own row, so a plan never
needs a shuffle.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import actions as A
from ..functions import fixed as K
from ..functions.staging import pin
from ..functions.text import bool_text, clamp, empty_to_null, non_blank, stable_id, two_decimals, whole
from .enrich import criticality, privileged


@dataclass(frozen=True)
class PlanningContext:
    environment: str = "dev"
    dry_run: bool = True
    catalog: dict = field(default_factory=lambda: dict(K.ACTION_CATALOG))


def strategy(confidence: Column, severity: Column, crit: Column, priv: Column) -> Column:
    return (
        F.when(confidence < F.lit(0.3), F.lit("ObserveMore"))
        .when(((crit >= 4) | priv) & (confidence < F.lit(0.85)), F.lit("EscalateToHuman"))
        .when((confidence >= F.lit(0.85)) & (severity >= 70), F.lit("ContainAndCollect"))
        .when((confidence >= F.lit(0.6)) & (severity >= 50), F.lit("Contain"))
        .otherwise(F.lit("NotifyOnly"))
    )


def priority(confidence: Column, severity: Column, crit: Column) -> Column:
    """Sums in bigint, so that no value of a reply or an asset can overflow."""
    total = severity.cast("bigint") + crit.cast("bigint") * 10 + whole(confidence * 20)
    return clamp(total, 0, 100).cast("int")


def summary(strategy_: Column, severity: Column, confidence: Column) -> Column:
    return F.concat(
        F.lit("Strategy="), strategy_,
        F.lit(", Severity="), severity.cast("string"),
        F.lit(", Confidence="), two_decimals(confidence),
    )


def plan_header(scored: DataFrame) -> DataFrame:
    """Add ``strategy``, ``priority`` and ``plan_summary`` (enough to rank alerts)."""
    a = F.col("assessment")
    return (
        scored.withColumn(
            "strategy", strategy(a["confidence"], a["severity"], criticality(), privileged())
        )
        .withColumn("priority", priority(a["confidence"], a["severity"], criticality()))
        .withColumn("plan_summary", summary(F.col("strategy"), a["severity"], a["confidence"]))
    )


#: Entities an action of a strategy may need.
NEEDED_ENTITIES = ["src_ip", "hostname", "host_id", "username", "user_id"]


def _given(e: Column) -> dict[str, Column]:
    """Per entity an action may need, whether it is non-blank."""
    return {n: non_blank(e[n]) for n in NEEDED_ENTITIES}


def _any_of(given: dict[str, Column], names: list[str]) -> Column:
    return functools.reduce(operator.or_, [given[n] for n in names], F.lit(False))


def _pick(e: Column, given: dict[str, Column], names: list[str]) -> Column:
    """Parameter map of the non-blank entities among ``names``."""
    parts = [
        F.when(given[n], F.create_map(F.lit(n), e[n])).otherwise(A.empty_params()) for n in names
    ]
    return F.map_concat(*parts) if len(parts) > 1 else parts[0]


def _on(action_type: str, e: Column, given: dict[str, Column], names: list[str], why: str) -> Column:
    """An action on the non-blank entities among ``names``.

    The id is that of ``A.action``; here the names are known, so its text needs no lambda.
    """
    texts = [F.when(given[n], F.concat(F.lit(f"{n}="), e[n])) for n in sorted(names)]
    signature = F.concat(F.lit(f"{action_type}:"), F.concat_ws("|", *texts))
    return A.action(
        F.lit(action_type), _pick(e, given, names), F.lit(why), id_=A.hashed(signature)
    )


def _simple(action_type: str, why: str) -> Column:
    return A.action(F.lit(action_type), A.empty_params(), F.lit(why))


@dataclass(frozen=True)
class Proposal:
    """An action that strategies propose, when they do, and the entities it takes."""

    type: str
    when: Column
    action: Column
    names: tuple[str, ...] = ()


def proposals(strategy_: Column, e: Column, given: dict[str, Column]) -> list[Proposal]:
    """What strategies propose, in order.

    Types and parameter names are known here, so that nothing has to be looked up per action, and
    no array lambda is needed, which Spark would interpret with all that its array is built from.
    """
    others = strategy_.isin("ObserveMore", "NotifyOnly", "EscalateToHuman", "Contain")
    collects = ~F.coalesce(others, F.lit(False))
    contains = collects | (strategy_ == "Contain")

    def contain(action_type: str, names: list[str], why: str) -> Proposal:
        return Proposal(
            action_type, contains & _any_of(given, names), _on(action_type, e, given, names, why),
            tuple(names),
        )

    return [
        contain("BlockIp", ["src_ip"], K.BLOCK_TEXT),
        contain("DisableUser", ["username", "user_id"], K.DISABLE_TEXT),
        contain("IsolateHost", ["hostname", "host_id"], K.ISOLATE_TEXT),
        Proposal("CollectForensics", collects, _simple("CollectForensics", K.FORENSICS_TEXT)),
        Proposal("Notify", strategy_ == "NotifyOnly", _simple("Notify", K.NOTIFY_TEXT)),
        Proposal("Notify", strategy_ == "EscalateToHuman", _simple("Notify", K.ESCALATE_TEXT)),
        Proposal("OpenTicket", F.lit(True), _simple("OpenTicket", K.TICKET_TEXT)),
    ]


def _listed(found: list[tuple[Column, Column]], ddl: str = A.ACTION_DDL) -> list[Column]:
    """For each condition and value, an array of the value or an empty one."""
    none = F.array().cast(f"array<{ddl}>")
    return [F.when(when, F.array(value)).otherwise(none) for when, value in found]


def strategy_actions(
    strategy_: Column, e: Column, given: dict[str, Column] | None = None
) -> Column:
    """Candidate actions of a strategy, in the order they are proposed."""
    found = proposals(strategy_, e, given or _given(e))
    return F.concat(*_listed([(p.when, p.action) for p in found]))


def _entity_ok(action_type: Column, given: dict[str, Column]) -> Column:
    """Whether one of the entities that a type needs is non-blank."""
    types: dict[tuple[str, ...], list[str]] = {}
    for name, needed in K.ENTITY_NEEDS.items():
        types.setdefault(tuple(needed), []).append(name)
    out = F.lit(True)
    for needed, named in types.items():
        other = F.coalesce(~A.one_of(action_type, named), F.lit(True))
        out = out & (other | _any_of(given, list(needed)))
    return out


def recommended_actions(given: dict[str, Column]) -> Column:
    """The recommendations of the assessment whose entities are there."""
    return F.transform(
        F.filter(
            F.coalesce(F.col("assessment")["recommended"], F.array()),
            lambda r: _entity_ok(r["type"], given),
        ),
        lambda r: A.action(
            r["type"], r["params"], F.coalesce(r["rationale"], F.lit(K.RECOMMENDED_TEXT))
        ),
    )


def _with_given(planned: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Columns that say which entities are non-blank, so that each is looked at once."""
    given = _given(F.col("entities"))
    named = {f"_has_{n}": c for n, c in given.items()}
    return planned.withColumns(named), {n: F.col(f"_has_{n}") for n in given}


def select_actions(planned: DataFrame, out: str = "candidates") -> DataFrame:
    """Add the selected actions (strategy set plus recommendations) in selection order.

    The order is a stable sort by rank, expressed as one filter per rank.
    """
    df, given = _with_given(planned)

    def of_type(name: str) -> Column:
        return F.filter(F.col("_kept"), lambda a: a["type"] == name)

    kept = F.concat(
        strategy_actions(F.col("strategy"), F.col("entities"), given), recommended_actions(given)
    )
    ranked = [of_type(t) for t in K.SELECTION_ORDER]
    rest = F.filter(F.col("_kept"), lambda a: ~A.one_of(a["type"], K.SELECTION_ORDER))
    return (
        df.withColumn("_kept", kept)
        .withColumn(out, F.concat(*ranked, rest))
        .drop("_kept", *[f"_has_{n}" for n in given])
    )


def estimate(action: Column, catalog: dict, confidence: Column, crit: Column, priv: Column):
    """Risk and impact from catalog defaults and context; unknown types get the worst values."""
    return rate(action, catalog, *surcharges(confidence, crit, priv))


def surcharges(confidence: Column, crit: Column, priv: Column) -> tuple[Column, Column]:
    """What context adds to the default risk and impact of every action of a plan."""
    extra = F.when(priv, F.lit(10)).otherwise(F.lit(0))
    return whole((F.lit(1.0) - confidence) * 30) + extra, crit.cast("bigint") * 5 + extra


def _or_default(value: Column, default: Column) -> Column:
    return clamp(F.when(value <= 0, default).otherwise(value), 0, 100)


def rate(action: Column, catalog: dict, more_risk: Column, more_impact: Column) -> Column:
    t = action["type"]

    def rated(x: Column) -> Column:
        default_risk, default_impact = x["risk"], x["impact"]
        return A.action(
            t,
            action["params"],
            action["rationale"],
            F.when(x["known"], _or_default(default_risk + more_risk, default_risk)).otherwise(
                _or_default(action["risk"], F.lit(100))
            ),
            F.when(x["known"], _or_default(default_impact + more_impact, default_impact)).otherwise(
                _or_default(action["impact"], F.lit(100))
            ),
            F.when(x["known"], A.catalog_field(t, catalog, 0, False)).otherwise(F.lit(False)),
            action["duration_seconds"],
            action["action_id"],
        )

    defaults = F.struct(
        A.known(t, catalog).alias("known"),
        A.catalog_field(t, catalog, 2, 0).alias("risk"),
        A.catalog_field(t, catalog, 3, 0).alias("impact"),
    )
    return A.let(defaults, rated)


def _rate_proposal(p: Proposal, catalog: dict, more_risk: Column, more_impact: Column) -> Column:
    """``rate`` of a proposal, whose type and thereby defaults are known."""
    if p.type in catalog:
        reversible, _, risk, impact, _ = catalog[p.type]
        default_risk, default_impact = F.lit(risk or 0), F.lit(impact or 0)
        risk_ = _or_default(default_risk + more_risk, default_risk)
        impact_ = _or_default(default_impact + more_impact, default_impact)
    else:
        reversible, risk_, impact_ = False, F.lit(100), F.lit(100)
    return p.action.withField("risk", risk_.cast("int")).withField(
        "impact", impact_.cast("int")
    ).withField("reversible", F.lit(bool(reversible)))


def _proposal_ok(p: Proposal, catalog: dict, given: dict[str, Column]) -> Column:
    """``A.parameters_ok`` of a proposal, which has the non-blank entities of its names."""
    out = F.lit(True)
    for keys in A.key_groups(catalog).get(p.type, []):
        out = out & _any_of(given, [k for k in keys if k in p.names])
    return out


def distinct_actions(actions: Column) -> Column:
    """First action per signature. The id is a hash of the signature, so ids stand in for it."""
    ids = actions["action_id"]
    # The filter is for the few plans with a repeated id, or without one.
    given = F.array_except(ids, F.array(F.lit(None).cast("string")))
    return F.when(F.size(given) == F.size(ids), actions).otherwise(
        F.filter(actions, lambda a, i: F.array_position(ids, a["action_id"]) == i + 1)
    )


def stable_order(actions: Column) -> Column:
    """By risk, impact, type ordinal and id. Sorts small keys, then picks by index."""
    keys = F.sort_array(
        F.transform(
            actions,
            lambda a, i: F.struct(
                a["risk"].alias("risk"),
                a["impact"].alias("impact"),
                A.by_type(
                    a["type"], {t: n for n, t in enumerate(K.ACTION_TYPES)}, len(K.ACTION_TYPES)
                ).alias("ordinal"),
                a["action_id"].alias("id"),
                i.alias("i"),
            ),
        )
    )
    picked = F.transform(keys, lambda k: F.get(actions, k["i"]))
    return F.when(F.size(actions) < 2, actions).otherwise(picked)


def rollback_actions(actions: Column, catalog: dict) -> Column:
    """Undo actions of the reversible ones, last action first."""
    undone = [t for t, back in K.ROLLBACK_OF.items() if t in catalog and back in catalog]
    reversible = F.filter(
        F.reverse(actions), lambda a: a["reversible"] & A.one_of(a["type"], undone)
    )

    def undo(a: Column) -> Column:
        t = A.by_type(a["type"], K.ROLLBACK_OF)
        return A.action(
            t,
            a["params"],
            F.concat(F.lit("Rollback for "), a["type"]),
            A.catalog_field(t, catalog, 2, 0),
            A.catalog_field(t, catalog, 3, 0),
            A.catalog_field(t, catalog, 0, False),
        )

    return F.transform(reversible, undo)


def rationale(ctx: PlanningContext) -> Column:
    a = F.col("assessment")
    texts = [
        (
            F.col("strategy").isNotNull() & a["severity"].isNotNull(),
            F.concat(
                F.lit("Selected strategy "), F.col("strategy"),
                F.lit(" based on confidence "), two_decimals(a["confidence"]),
                F.lit(" and severity "), a["severity"].cast("string"), F.lit("."),
            ),
        ),
        (
            F.lit(True),
            F.concat(
                F.lit("Asset criticality: "), criticality().cast("string"),
                F.lit("; privileged identity: "), bool_text(privileged()), F.lit("."),
            ),
        ),
        (F.lit(True), F.lit(f"Environment: {ctx.environment}; DryRun: {ctx.dry_run}.")),
        (non_blank(a["hypothesis"]), F.concat(F.lit("Hypothesis: "), a["hypothesis"])),
        (
            F.size(a["evidence"]) > 0,
            F.concat(F.lit("Evidence count: "), F.size(a["evidence"]).cast("string")),
        ),
    ]
    return F.concat(*_listed(texts, "string"))


def plan_tags(ctx: PlanningContext) -> Column:
    a = F.col("assessment")
    return F.create_map(
        F.lit("siem"), F.col("siem_name"),
        F.lit("alert_id"), F.col("alert_id"),
        F.lit("environment"), F.lit(ctx.environment),
        F.lit("severity"), a["severity"].cast("string"),
        F.lit("confidence"), two_decimals(a["confidence"]),
    )


def plan(scored: DataFrame, ctx: PlanningContext | None = None) -> DataFrame:
    """One ``plan`` struct per alert. Plan ids are a hash of source and alert id."""
    ctx = ctx or PlanningContext()
    conf = F.col("assessment")["confidence"]
    more_risk, more_impact = surcharges(conf, criticality(), privileged())
    header, given = _with_given(plan_header(scored))
    more = F.col("_more_risk"), F.col("_more_impact")
    recommended = F.transform(
        recommended_actions(given), lambda a: rate(a, ctx.catalog, *more)
    )
    found = proposals(F.col("strategy"), F.col("entities"), given)
    rated = [(p, _rate_proposal(p, ctx.catalog, *more)) for p in found]
    known = [
        (p.when & _proposal_ok(p, ctx.catalog, given), a) for p, a in rated if p.type in ctx.catalog
    ]
    unknown = [(p.when, a) for p, a in rated if p.type not in ctx.catalog]

    def keep_known(a: Column) -> Column:
        return A.known(a["type"], ctx.catalog) & A.parameters_ok(
            a["type"], a["params"], ctx.catalog
        )

    ready = F.concat(
        *_listed(known),
        F.filter(F.col("_recommended"), keep_known),
        *_listed(unknown),
        F.filter(F.col("_recommended"), lambda a: ~A.known(a["type"], ctx.catalog)),
    )
    staged = (
        header.withColumns({"_more_risk": more_risk, "_more_impact": more_impact})
        .withColumn("_recommended", recommended)
        .withColumn("_ready", ready)
        .withColumn("_distinct", distinct_actions(F.col("_ready")))
        .withColumn("_actions", stable_order(F.col("_distinct")))
    )
    built = F.struct(
        stable_id("siem_name", "alert_id").alias("plan_id"),
        F.col("strategy"),
        F.col("priority"),
        F.col("plan_summary").alias("summary"),
        F.col("_actions").alias("actions"),
        rollback_actions(F.col("_actions"), ctx.catalog).alias("rollback_actions"),
        rationale(ctx).alias("rationale"),
        plan_tags(ctx).alias("tags"),
    )
    return pin(staged, {"plan": built}).drop(
        "_more_risk", "_more_impact", "_recommended", "_ready", "_distinct", "_actions",
        "strategy", "priority", "plan_summary", *[f"_has_{n}" for n in given],
    )


def static_plan(scored: DataFrame, now: Column) -> DataFrame:
    """The second planner: fixed risk and impact, no dedupe, reorder or required-parameter check."""
    e = F.col("entities")
    a = F.col("assessment")
    header = plan_header(scored)
    host = F.coalesce(F.when(F.length(e["host_id"]) > 0, e["host_id"]),
                      F.when(F.length(e["hostname"]) > 0, e["hostname"]))

    def fixed_action(name: str, why: str, params: Column | None = None) -> Column:
        rollback, _, risk, impact, _ = K.ACTION_CATALOG.get(name, K.UNKNOWN_STATIC)
        params = A.empty_params() if params is None else params.cast(A.PARAMS_DDL)
        return A.action(F.lit(name), params, F.lit(why), F.lit(risk), F.lit(impact),
                        F.lit(rollback), id_=F.lit(None).cast("string"))

    contain = [
        F.when(F.length(e["src_ip"]) > 0,
               fixed_action("BlockIp", K.BLOCK_TEXT, F.create_map(F.lit("src_ip"), e["src_ip"]))),
        F.when(F.length(e["username"]) > 0,
               fixed_action("DisableUser", K.DISABLE_TEXT,
                            F.create_map(F.lit("username"), e["username"]))),
        F.when(host.isNotNull(),
               fixed_action("IsolateHost", K.ISOLATE_TEXT, F.create_map(F.lit("host_id"), host))),
    ]
    ticket = fixed_action("OpenTicket", K.TICKET_TEXT)
    s = F.col("strategy")
    actions = (
        F.when(s == "ObserveMore", F.array(ticket))
        .when(s == "NotifyOnly", F.array(fixed_action("Notify", K.NOTIFY_TEXT), ticket))
        .when(s == "Contain", F.array_compact(F.array(*contain, ticket)))
        .when(
            s == "ContainAndCollect",
            F.array_compact(
                F.array(*contain, fixed_action("CollectForensics", K.FORENSICS_TEXT), ticket)
            ),
        )
        .otherwise(F.array(fixed_action("Notify", K.ESCALATE_TEXT), ticket))
    )

    def undo(x: Column) -> Column:
        t = A.by_type(x["type"], K.ROLLBACK_OF)
        return A.action(
            t, x["params"], F.concat(F.lit("Rollback for "), x["type"]),
            A.catalog_field(t, K.ACTION_CATALOG, 2), A.catalog_field(t, K.ACTION_CATALOG, 3),
            A.catalog_field(t, K.ACTION_CATALOG, 0), id_=F.lit(None).cast("string"),
        )

    rollbacks = F.transform(
        F.filter(F.reverse(F.col("_actions")), lambda x: A.one_of(x["type"], K.ROLLBACK_OF)),
        undo,
    )
    environment = F.coalesce(empty_to_null(F.col("asset")["environment"]), F.lit("unknown"))
    built = F.struct(
                stable_id("siem_name", "alert_id").alias("plan_id"),
                F.col("strategy"),
                F.col("priority"),
                F.col("plan_summary").alias("summary"),
                F.col("_actions").alias("actions"),
                rollbacks.alias("rollback_actions"),
                F.array(
                    F.concat(
                        F.lit("Selected strategy "), s, F.lit(" based on confidence "),
                        two_decimals(a["confidence"]), F.lit(" and severity "),
                        a["severity"].cast("string"), F.lit("."),
                    ),
                    F.concat(
                        F.lit("Asset criticality: "), criticality().cast("string"),
                        F.lit("; privileged identity: "), bool_text(privileged()), F.lit("."),
                    ),
                ).alias("rationale"),
                F.create_map(
                    F.lit("environment"), environment,
                    F.lit("generatedAt"), now.cast("string"),
                ).alias("tags"),
    )
    return pin(header.withColumn("_actions", actions), {"plan": built}).drop(
        "_actions", "strategy", "priority", "plan_summary"
    )


def action_table(planned: DataFrame, which: str = "actions") -> DataFrame:
    """One row per action of a plan, with its place in the plan."""
    return planned.select(
        "alert_id",
        "siem_name",
        F.col("plan")["plan_id"].alias("plan_id"),
        F.posexplode(F.col("plan")[which]).alias("seq", "action"),
    ).select("alert_id", "siem_name", "plan_id", "seq", "action.*")
