"""Execution outcomes, rollbacks, outbound requests and acknowledgements.

(W-4, W-5, J-9, J-17, A-4, K-7, K-8.) Nothing is sent anywhere: the results say
what each executor would do, or take its reply from an ``outcomes`` column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import actions as A
from ..functions import fixed as K
from ..functions.staging import pin
from ..functions.text import non_blank, stable_id
from .policy import count_status, decision_table

OUTCOMES_DDL = "map<string,struct<succeeded:boolean,message:string,reference:string>>"
RESULT_DDL = (
    "struct<action_id:string,type:string,status:string,executor:string,message:string,"
    "reference:string,is_rollback:boolean,original_action_id:string,executed:boolean>"
)


@dataclass(frozen=True)
class ExecutionContext:
    environment: str = "dev"
    dry_run: bool = True
    stop_on_failure: bool = False


def _by_executor(executors: list, position: int) -> dict:
    out = {}
    for row in executors:
        for t in row[0]:
            out.setdefault(t, row[position])
    return out


def _feasible(action: Column, executors: list) -> Column:
    any_key = {t: k for t, k in _by_executor(executors, 2).items() if not k}
    needed = {t: k for t, k in _by_executor(executors, 2).items() if k}
    keys = A.by_type(action["type"], needed)
    if not needed:
        return A.one_of(action["type"], any_key)
    return A.one_of(action["type"], any_key) | F.coalesce(
        A.has_key(action["params"], keys), F.lit(False)
    )


def _result(
    action: Column,
    status: Column,
    executor: Column,
    message: Column,
    reference: Column | None = None,
    rollback_of: Column | None = None,
    executed: Column | None = None,
) -> Column:
    return F.struct(
        action["action_id"].alias("action_id"),
        action["type"].alias("type"),
        status.alias("status"),
        executor.alias("executor"),
        message.alias("message"),
        (F.lit(None) if reference is None else reference).cast("string").alias("reference"),
        F.lit(rollback_of is not None).alias("is_rollback"),
        (F.lit(None) if rollback_of is None else rollback_of)
        .cast("string")
        .alias("original_action_id"),
        (F.lit(False) if executed is None else executed).alias("executed"),
    )


def _run(action: Column, ctx: ExecutionContext, executors: list, outcomes: Column | None,
         dry_text: str) -> Column:
    """What the routed executor answers: status, executor, message, reference, executed."""
    t = action["type"]
    missing = A.by_type(t, _by_executor(executors, 3))
    reference = F.concat(A.by_type(t, _by_executor(executors, 4)), action["action_id"])
    stub_text = A.by_type(t, K.EXECUTED_TEXT)
    with_reply = not ctx.dry_run and outcomes is not None

    def answer(x: Column) -> Column:
        if ctx.dry_run:
            done, text, ref = F.lit("DryRun"), F.lit(dry_text), F.lit(None).cast("string")
        elif not with_reply:
            done, text, ref = F.lit("Succeeded"), stub_text, reference
        else:
            reply = x["reply"]
            ok = F.coalesce(reply["succeeded"], F.lit(True))
            done = F.when(ok, F.lit("Succeeded")).otherwise(F.lit("Failed"))
            text = F.coalesce(reply["message"], stub_text)
            ref = F.when(reply.isNull(), reference).otherwise(reply["reference"])
        has_executor, feasible = x["name"].isNotNull(), x["feasible"]
        ran = has_executor & feasible
        return F.struct(
            F.when(~has_executor, F.lit("Failed"))
            .when(~feasible, F.lit("Skipped"))
            .otherwise(done)
            .alias("status"),
            F.coalesce(x["name"], F.lit(K.PIPELINE_NAME)).alias("executor"),
            F.when(~has_executor, F.lit(K.NO_EXECUTOR))
            .when(~feasible, missing)
            .otherwise(text)
            .alias("message"),
            F.when(ran, ref).alias("reference"),
            (ran if not ctx.dry_run else F.lit(False)).alias("executed"),
        )

    asked = [
        A.by_type(t, _by_executor(executors, 1)).alias("name"),
        _feasible(action, executors).alias("feasible"),
    ]
    if with_reply:
        asked.append(F.try_element_at(outcomes, action["action_id"]).alias("reply"))
    return A.let(F.struct(*asked), answer)


def execute(
    decided: DataFrame,
    ctx: ExecutionContext | None = None,
    executors: list | None = None,
    outcomes: Column | None = None,
) -> DataFrame:
    """Add ``results``, ``rollback_results`` and ``execution_notes`` to every plan.

    ``outcomes`` maps action ids to executor replies (for instance joined from a reply
    table); an action without a reply counts as done.
    """
    ctx = ctx or ExecutionContext()
    executors = K.EXECUTORS if executors is None else executors
    if outcomes is not None:
        outcomes = outcomes.cast(OUTCOMES_DDL)
    plan = F.col("plan")

    def one(action: Column, i: Column) -> Column:
        def settled(x: Column) -> Column:
            status, run = x["status"], x["run"]
            approved = status == "Approved"
            why = (
                F.when(status == "PendingApproval", F.lit(K.SKIP_PENDING))
                .when(status == "Denied", F.lit(K.SKIP_DENIED))
                .otherwise(F.lit(K.SKIP_OTHER))
            )
            return _result(
                action,
                F.when(approved, run["status"]).otherwise(F.lit("Skipped")),
                F.when(approved, run["executor"]).otherwise(F.lit(K.PIPELINE_NAME)),
                F.when(approved, run["message"]).otherwise(why),
                F.when(approved, run["reference"]),
                executed=approved & run["executed"],
            )

        def run_if_approved(status: Column) -> Column:
            run = F.when(
                F.coalesce(status == "Approved", F.lit(True)),
                _run(action, ctx, executors, outcomes, K.DRY_RUN_TEXT),
            )
            return F.struct(status.alias("status"), run.alias("run"))

        decision = F.get(F.col("decisions"), i)["status"]
        return A.let(A.let(decision, run_if_approved), settled)

    out = pin(decided, {"results": F.transform(plan["actions"], one)})
    no_results = F.array().cast(f"array<{RESULT_DDL}>")
    if not ctx.stop_on_failure:
        return out.withColumn("rollback_results", no_results).withColumn(
            "execution_notes", F.array().cast("array<string>")
        )

    failed_at = F.array_position(F.transform("results", lambda r: r["status"]), "Failed")
    cut = F.slice("results", 1, F.greatest(F.col("_p"), F.lit(1)))
    out = (
        pin(
            out.withColumn("_p", failed_at.cast("int")),
            {"results": F.when(F.col("_p") > 0, cut).otherwise(F.col("results"))},
        )
        .withColumn(
            "_stopped",
            (F.col("_p") > 0) & F.try_element_at(F.col("results"), F.lit(-1))["executed"],
        )
    )
    succeeded = F.transform(
        F.filter("results", lambda r: r["status"] == "Succeeded"), lambda r: r["action_id"]
    )
    originals = F.filter(
        F.reverse(plan["actions"]), lambda a: F.array_contains(F.col("_ok"), a["action_id"])
    )

    def undo(step: Column) -> Column:
        original, t, wanted = step["original"], step["type"], step["wanted"]
        id_ = original["action_id"]

        def of(matching: Column) -> Column:
            rollback = F.try_element_at(matching, F.lit(-1))["action"]
            run = _run(rollback, ctx, executors, outcomes, K.DRY_ROLLBACK_TEXT)
            return F.when(
                F.size(matching) > 0,
                A.let(
                    run,
                    lambda r: _result(rollback, r["status"], r["executor"], r["message"],
                                      r["reference"], id_, r["executed"]),
                ),
            ).otherwise(
                _result(original, F.lit("Skipped"), F.lit(K.PIPELINE_NAME),
                        F.lit(K.NO_ROLLBACK), None, id_, F.lit(False))
            )

        return A.let(
            F.filter("_offered", lambda o: (o["wanted"] == wanted) & (o["action"]["type"] == t)), of
        )

    # The hash of type and parameters is taken once for each action, and only where a run stopped.
    def wanted_rollback(original: Column) -> Column:
        t = A.by_type(original["type"], K.ROLLBACK_OF)
        return F.struct(original.alias("original"), t.alias("type"),
                        A.action_id(t, original["params"]).alias("wanted"))

    offered = F.transform(
        plan["rollback_actions"],
        lambda r: F.struct(r.alias("action"), A.action_id(r["type"], r["params"]).alias("wanted")),
    )
    staged = pin(
        out.withColumn("_ok", succeeded),
        {
            "_undo": F.when(F.col("_stopped"), F.transform(originals, wanted_rollback)),
            "_offered": F.when(F.col("_stopped"), offered),
        },
    )
    notes = F.when(F.col("_stopped"), F.array(F.lit(K.STOP_NOTE))).otherwise(
        F.array().cast("array<string>")
    )
    return pin(
        staged,
        {
            "rollback_results": F.coalesce(F.transform("_undo", undo), no_results),
            "execution_notes": notes,
        },
    ).drop("_p", "_stopped", "_ok", "_undo", "_offered")


def count_result(status: str) -> Column:
    return F.size(F.filter(F.col("results"), lambda r: r["status"] == status))


def result_table(executed: DataFrame) -> DataFrame:
    """One row per action result, rollbacks after the actions."""
    return executed.select(
        "alert_id",
        F.col("plan")["plan_id"].alias("plan_id"),
        F.posexplode(F.concat("results", "rollback_results")).alias("seq", "r"),
    ).select("alert_id", "plan_id", "seq", "r.*").drop("executed")


def execution_counts(executed: DataFrame) -> DataFrame:
    """Totals per plan, counted inside the row."""
    return executed.select(
        "alert_id",
        F.col("plan")["plan_id"].alias("plan_id"),
        F.size("results").alias("total"),
        count_result("Succeeded").alias("succeeded"),
        count_result("Failed").alias("failed"),
        count_result("Skipped").alias("skipped"),
        count_result("DryRun").alias("dry_run"),
    )


def outbox(decided: DataFrame, environment: str = "dev") -> DataFrame:
    """Outbound request rows of the approved actions, one JSON body per action."""
    rows = decision_table(decided).filter(F.col("status") == "Approved")
    params = F.col("params")
    text = F.col("rationale")

    def param_or(key: str, default: Column) -> Column:
        value = F.try_element_at(params, F.lit(key))
        return F.when(non_blank(value), value).otherwise(default)

    firewall = F.to_json(
        F.struct(
            F.col("action_id").alias("correlationId"),
            F.try_element_at(params, F.lit("src_ip")).alias("ip"),
            text.alias("reason"),
            F.when(F.col("duration_seconds") > 0, F.col("duration_seconds"))
            .otherwise(F.lit(K.FIREWALL_TTL_SECONDS))
            .alias("ttlSeconds"),
        )
    )
    ticket = F.to_json(
        F.struct(
            F.col("action_id").alias("correlationId"),
            param_or("title", F.concat(F.lit("Security ticket: "), F.col("type"))).alias("title"),
            param_or("description", text).alias("description"),
            params.alias("parameters"),
            text.alias("rationale"),
            F.lit(environment).alias("environment"),
        )
    )
    notify = F.to_json(
        F.struct(
            F.col("action_id").alias("correlationId"),
            param_or("message", text).alias("message"),
            params.alias("parameters"),
            text.alias("rationale"),
            F.lit(environment).alias("environment"),
        )
    )
    t = F.col("type")
    return (
        rows.withColumn(
            "target",
            F.when(t.isin("BlockIp", "UnblockIp"), F.lit("firewall"))
            .when(t == "OpenTicket", F.lit("ticketing"))
            .when(t == "Notify", F.lit("notification")),
        )
        .filter(F.col("target").isNotNull())
        .filter(
            (F.col("target") != "firewall") | non_blank(F.try_element_at(params, F.lit("src_ip")))
        )
        .select(
            "alert_id",
            "plan_id",
            "action_id",
            "type",
            "target",
            F.when(t == "BlockIp", F.lit("block-ip"))
            .when(t == "UnblockIp", F.lit("unblock-ip"))
            .alias("endpoint"),
            F.when(F.col("target") == "firewall", firewall)
            .when(F.col("target") == "ticketing", ticket)
            .otherwise(notify)
            .alias("body"),
        )
    )


def final_ack() -> Column:
    """InProgress while anything is pending or failed, else Closed."""
    return F.when(
        (count_status("PendingApproval") > 0) | (count_result("Failed") > 0), F.lit("InProgress")
    ).otherwise(F.lit("Closed"))


def acknowledgements(executed: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """Two rows per alert: Seen at the start, then the final status. Blank ids get none."""

    def rows(df: DataFrame, status: Column) -> DataFrame:
        return df.filter(non_blank("alert_id")).select(
            "alert_id",
            F.posexplode(F.array(F.lit("Seen"), status)).alias("step", "status"),
        )

    out = rows(executed, final_ack())
    if rejected is not None:
        out = out.unionByName(rows(rejected, F.lit("InProgress")))
    return out


def correlation_id(plan_id: Column) -> Column:
    return stable_id(F.lit("execution"), plan_id)
