"""Stateful streams: approval dedupe, address changes, dataset append (ST-3, ST-4, ST-5)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.staging import ship
from ..functions.text import empty_to_null
from ..operators import dataset as D
from ..operators.heuristics import parse_rows
from ..operators.ordered import changes
from ..sources.runs import Runs
from .known import KnownIds, append_new
from .triage import batch_folder, write_batch

ship(__name__)


def first_requests(pending: DataFrame, bound: str | None = None) -> DataFrame:
    """One pending row per action id over the whole stream, of the batch that has it first.

    Inside that batch any row may be taken; ``first_request_stream`` takes the first in order.

    State never expires by default, as the request store never forgets. ``bound`` (for
    example ``"7 days"`` on ``ts``) limits the state and may repeat older ids.
    """
    if bound is None:
        return pending.dropDuplicates(["action_id"])
    return pending.withWatermark("ts", bound).dropDuplicatesWithinWatermark(["action_id"])


def first_request_stream(
    pending: DataFrame,
    root: str,
    checkpoint: str,
    order_by: tuple[str, ...] = ("ts", "alert_id", "seq"),
) -> StreamingQuery:
    """Store the first pending row per action id: by arrival, then in order inside a batch."""
    return append_stream(pending, root, checkpoint, ["action_id"], list(order_by))


CHANGE_SCHEMA = "agent_key string, id string, previous_ip string, agent_ip string"


def _changes(
    key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    """Compare each row of one agent with the address before it."""
    rows = pd.concat(list(batches)).sort_values(["_ord", "id"], kind="stable")
    last = state.get[0] if state.exists else None
    previous = rows["agent_ip"].shift(1)
    previous.iloc[0] = last
    rows = rows.assign(previous_ip=previous, agent_key=key[0])
    state.update((rows["agent_ip"].iloc[-1],))
    changed = rows[rows["previous_ip"].notna() & (rows["previous_ip"] != rows["agent_ip"])]
    yield changed[["agent_key", "id", "previous_ip", "agent_ip"]]


def _addresses(rows: DataFrame, order_by: str) -> DataFrame:
    slim = parse_rows(rows).select(
        F.coalesce(empty_to_null("agent_id"), empty_to_null("agent_name")).alias("agent_key"),
        F.col(order_by).alias("_ord"),
        "id",
        "agent_ip",
    )
    return slim.filter(F.col("agent_key").isNotNull() & (F.length("agent_ip") > 0))


def ip_change_stream(rows: DataFrame, order_by: str = "ts") -> DataFrame:
    """Rows whose agent was last seen with another address; the state is one address per agent.

    Only order, id and address of a row reach the stateful step. A group holds one agent's
    rows of one micro-batch, so the source's ``maxFilesPerTrigger`` bounds it; where an agent
    may be hot, use ``address_stream``.
    """
    return _addresses(rows, order_by).groupBy("agent_key").applyInPandasWithState(
        _changes,
        outputStructType=CHANGE_SCHEMA,
        stateStructType="last_ip string",
        outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout,
    )


LAST_SCHEMA = "agent_key string, agent_ip string, batch bigint"


def _latest(rows: DataFrame) -> DataFrame:
    """The address of the latest batch for each agent."""
    return rows.groupBy("agent_key").agg(
        F.max_by("agent_ip", "batch").alias("agent_ip"), F.max("batch").alias("batch")
    )


def address_batch(rows: DataFrame, batch_id: int, root: str, order_by: str = "ts") -> None:
    """Write the address changes of one micro-batch and keep the last address of each agent.

    The addresses of earlier batches enter as the first row of their agent, and the whole goes
    through the ordered scan, which spreads an agent over as many tasks as its rows need. Rows
    are in order of ``order_by``, id and address inside a batch, and by arrival between batches.
    """
    spark = rows.sparkSession
    last = Runs(spark, f"{root}/last-address", LAST_SCHEMA)
    last.compact(batch_id, _latest)
    slim = _addresses(rows, order_by).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        keys = slim.select("agent_key").distinct()
        before = _latest(last.read([r for r in last.live() if r[1] < batch_id])).join(keys, "agent_key", "left_semi")
        carried = before.select(
            "agent_key", *[F.lit(None).cast(slim.schema[c].dataType).alias(c) for c in ("_ord", "id")], "agent_ip"
        )
        both = slim.withColumn("_new", F.lit(True)).unionByName(carried.withColumn("_new", F.lit(False)))
        # The rows of a micro-batch have no size estimate, so the number of tasks is the session's.
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        changed = changes(both, "agent_key", ["_new", "_ord", "id", "agent_ip"], "agent_ip", "previous_ip", tasks)
        write_batch(changed.select("agent_key", "id", "previous_ip", "agent_ip"), root, "address-changes", batch_id)
        newest = F.max_by("agent_ip", F.struct("_ord", "id", "agent_ip")).alias("agent_ip")
        last.put(slim.groupBy("agent_key").agg(newest).withColumn("batch", F.lit(batch_id).cast("bigint")), batch_id)
    finally:
        slim.unpersist()


def address_stream(rows: DataFrame, root: str, checkpoint: str, order_by: str = "ts") -> StreamingQuery:
    """Address changes of a stream under ``root/address-changes``; no agent's rows meet in one task."""
    return (
        rows.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, batch_id: address_batch(df, batch_id, root, order_by))
        .trigger(availableNow=True)
        .start()
    )


def append_batch(
    rows: DataFrame, batch_id: int, root: str, unique_fields: list[str], order_by: list[str]
) -> None:
    """Append the rows of one micro-batch that are new to the stored table.

    The signatures of the table are kept in hash buckets next to it (``known``): the batch reads
    those of its own rows, not the table.
    """
    spark = rows.sparkSession
    fresh = D.deduplicate(rows, unique_fields, order_by)
    signed = fresh.withColumn("_sig", D.signature(fresh, unique_fields))

    def write(new: DataFrame) -> DataFrame:
        write_batch(new, root, "dataset", batch_id)
        return spark.read.schema(signed.schema).parquet(batch_folder(root, "dataset", batch_id))

    append_new(signed, F.col("_sig"), batch_id, KnownIds(spark, f"{root}/dataset-known"), write)


def append_stream(
    rows: DataFrame,
    root: str,
    checkpoint: str,
    unique_fields: list[str],
    order_by: list[str],
) -> StreamingQuery:
    return (
        rows.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(
            lambda df, batch_id: append_batch(df, batch_id, root, unique_fields, order_by)
        )
        .trigger(availableNow=True)
        .start()
    )
