"""Policy gate over planned actions (P-18, P-19, A-3, J-7, J-8)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import actions as A
from ..functions import fixed as K
from ..functions.staging import pin
from ..functions.text import two_decimals
from .enrich import criticality, privileged

DECISION_DDL = "array<struct<action_id:string,type:string,status:string,reasons:array<string>>>"
_D = K.POLICY_DEFAULTS


@dataclass(frozen=True)
class PolicyConfig:
    min_confidence: float = _D["minConfidenceForAutonomy"]
    risk_threshold: int = _D["riskApprovalThreshold"]
    impact_threshold: int = _D["impactApprovalThreshold"]
    max_actions: int = _D["maxActionsPerPlan"]
    critical_threshold: int = _D["criticalAssetThreshold"]
    safe: tuple[str, ...] = tuple(_D["safeLowConfidenceActions"])
    prod_approval: tuple[str, ...] = tuple(_D["requireApprovalInProd"])
    privileged_approval: tuple[str, ...] = tuple(_D["requireApprovalOnPrivilegedIdentities"])
    critical_approval: tuple[str, ...] = tuple(_D["requireApprovalOnCriticalAssets"])
    privileged_forbidden: tuple[str, ...] = tuple(_D["forbidActionsOnPrivilegedIdentities"])
    critical_forbidden: tuple[str, ...] = tuple(_D["forbidActionsOnCriticalAssets"])
    environment_forbidden: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            k: tuple(v) for k, v in _D["forbiddenActionsByEnvironment"].items()
        }
    )

    @property
    def float_threshold(self) -> Column:
        """The threshold is single precision, so a confidence of 0.6 stays below 0.60f."""
        return F.lit(self.min_confidence).cast("float").cast("double")


def decide(
    action: Column,
    confidence: Column,
    crit: Column,
    priv: Column,
    environment: str,
    config: PolicyConfig,
    catalog: dict,
) -> Column:
    """Status and ordered reasons of one action."""
    t = action["type"]
    quoted = F.concat(F.lit("Action '"), t, F.lit("'"))
    crit_text = F.concat(F.lit("(criticality="), crit.cast("string"), F.lit(")"))
    forbidden_here: tuple[str, ...] = ()
    for env, names in config.environment_forbidden.items():
        if env.lower() == environment.lower():
            forbidden_here = tuple(names)
    critical = crit >= config.critical_threshold

    denials = F.array_compact(
        F.array(
            F.when(
                ~A.parameters_ok(t, action["params"], catalog),
                F.lit("Missing required parameters."),
            ),
            F.when(
                A.one_of(t, forbidden_here),
                F.concat(quoted, F.lit(f" is forbidden in environment '{environment}'.")),
            ),
            F.when(
                (confidence < config.float_threshold) & ~A.one_of(t, config.safe),
                F.concat(
                    F.lit("Confidence "), two_decimals(confidence),
                    F.lit(" below minimum "), two_decimals(config.float_threshold),
                    F.lit(" for autonomous action '"), t, F.lit("'."),
                ),
            ),
            F.when(
                priv & A.one_of(t, config.privileged_forbidden),
                F.concat(quoted, F.lit(" is forbidden on privileged identities.")),
            ),
            F.when(
                critical & A.one_of(t, config.critical_forbidden),
                F.concat(quoted, F.lit(" is forbidden on critical assets "), crit_text,
                         F.lit(".")),
            ),
        )
    )
    approvals = F.array_compact(
        F.array(
            F.when(
                A.catalog_field(t, catalog, 1, False),
                F.lit("Catalog marks this action as approval-required by default."),
            ),
            F.when(
                action["risk"] >= config.risk_threshold,
                F.concat(
                    F.lit("Risk "), action["risk"].cast("string"),
                    F.lit(f" exceeds approval threshold {config.risk_threshold}."),
                ),
            ),
            F.when(
                action["impact"] >= config.impact_threshold,
                F.concat(
                    F.lit("Impact "), action["impact"].cast("string"),
                    F.lit(f" exceeds approval threshold {config.impact_threshold}."),
                ),
            ),
            F.when(
                F.lit(environment.lower() == "prod") & A.one_of(t, config.prod_approval),
                F.concat(quoted, F.lit(" requires approval in prod.")),
            ),
            F.when(
                priv & A.one_of(t, config.privileged_approval),
                F.lit("Target identity is privileged."),
            ),
            F.when(
                critical & A.one_of(t, config.critical_approval),
                F.concat(F.lit("Target asset is critical "), crit_text, F.lit(".")),
            ),
        )
    )
    is_known = A.known(t, catalog)
    # The reasons are built once in a struct field; the status is read off them.
    return F.struct(
        action["action_id"].alias("action_id"),
        t.alias("type"),
        F.when(is_known, denials)
        .otherwise(F.array(F.lit("Unknown or unsupported action type.")))
        .alias("denials"),
        F.when(is_known, approvals).otherwise(F.array().cast("array<string>")).alias("approvals"),
    )


def _settle(d: Column) -> Column:
    status = (
        F.when(F.size(d["denials"]) > 0, F.lit("Denied"))
        .when(F.size(d["approvals"]) > 0, F.lit("PendingApproval"))
        .otherwise(F.lit("Approved"))
    )
    reasons = (
        F.when(F.size(d["denials"]) > 0, d["denials"])
        .when(F.size(d["approvals"]) > 0, d["approvals"])
        .otherwise(F.array(F.lit("Within policy limits.")))
    )
    return F.struct(
        d["action_id"].alias("action_id"),
        d["type"].alias("type"),
        status.alias("status"),
        reasons.alias("reasons"),
    )


def evaluate(
    planned: DataFrame,
    environment: str = "dev",
    config: PolicyConfig | None = None,
    catalog: dict | None = None,
    use_context: bool = True,
) -> DataFrame:
    """Add ``decisions`` (one per action, in plan order) and ``policy_notes``.

    ``catalog`` is the policy's own catalog, which may differ from the planner's.
    ``use_context=False`` judges without asset and identity facts.
    """
    config = config or PolicyConfig()
    catalog = K.ACTION_CATALOG if catalog is None else catalog
    a = F.col("assessment")
    crit = criticality() if use_context else F.lit(0)
    priv = privileged() if use_context else F.lit(False)
    actions = F.col("plan")["actions"]
    count = F.size(actions)
    over = count > config.max_actions

    judged = F.transform(
        actions,
        lambda x: decide(x, a["confidence"], crit, priv, environment, config, catalog),
    )
    denied_all = F.transform(
        actions,
        lambda x: F.struct(
            x["action_id"].alias("action_id"),
            x["type"].alias("type"),
            F.lit("Denied").alias("status"),
            F.array(F.lit(f"Plan exceeds max actions {config.max_actions}.")).alias("reasons"),
        ),
    )
    tail = F.concat(
        F.lit("Assessment: Severity="), a["severity"].cast("string"),
        F.lit(", Confidence="), two_decimals(a["confidence"]), F.lit("."),
    )
    counts = F.concat(
        F.lit("Approved="), count_status("Approved").cast("string"),
        F.lit(", Pending="), count_status("PendingApproval").cast("string"),
        F.lit(", Denied="), count_status("Denied").cast("string"), F.lit("."),
    )
    capped = F.concat(
        F.lit("Denied: plan has "), count.cast("string"),
        F.lit(f" actions, exceeds limit {config.max_actions}."),
    )
    settled = (
        F.when(over, denied_all).otherwise(F.transform("_judged", _settle)).cast(DECISION_DDL)
    )
    done = pin(planned.withColumn("_judged", judged), {"decisions": settled}).drop("_judged")
    return done.withColumn(
        "policy_notes", F.array(F.when(over, capped).otherwise(counts), tail)
    )


def count_status(status: str) -> Column:
    return F.size(F.filter(F.col("decisions"), lambda d: d["status"] == status))


def policy_counts(decided: DataFrame) -> DataFrame:
    """Approved, pending and denied per plan, counted inside the row."""
    return decided.select(
        "alert_id",
        F.col("plan")["plan_id"].alias("plan_id"),
        count_status("Approved").alias("approved"),
        count_status("PendingApproval").alias("pending"),
        count_status("Denied").alias("denied"),
        "policy_notes",
    )


def decision_table(decided: DataFrame) -> DataFrame:
    """One row per action with its decision and the action's fields."""
    pairs = F.arrays_zip(
        F.col("plan")["actions"].alias("action"), F.col("decisions").alias("decision")
    )
    return decided.select(
        "alert_id",
        "siem_name",
        "ts",
        F.col("plan")["plan_id"].alias("plan_id"),
        F.posexplode(pairs).alias("seq", "pair"),
    ).select(
        "alert_id",
        "siem_name",
        "ts",
        "plan_id",
        "seq",
        "pair.action.*",
        F.col("pair.decision.status").alias("status"),
        F.col("pair.decision.reasons").alias("reasons"),
    )
