"""Order-dependent columns without one task per key or one global window.

Row position and "previous value of the same key" follow a total order. A plain
window would put a whole key, or the whole table, into one task. Instead rows are
range-partitioned on the order, so any key may spread over many partitions; each
partition is solved alone and a summary with one row per partition carries the
state across partition borders.

The range-partitioned rows are cut with a reliable checkpoint, because partition
numbers must not change between the two reads of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.staging import ship
from ..session import ensure_checkpoint_dir

ship(__name__)

_PARTITION_BYTES = 256 << 20
_MOST_PARTITIONS = 1_000_000
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def _partitions(df: DataFrame) -> int:
    """As many partitions as a shuffle has by default, and more for an input that needs them."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(
        int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),
        min(_MOST_PARTITIONS, size // _PARTITION_BYTES + 1),
    )


def _ranged(df: DataFrame, order: list[Column], partitions: int | None) -> DataFrame:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or _partitions(df)
    numbered = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
        .checkpoint()
    )
    return numbered.withColumn("_part", F.shiftright("_mid", _LOCAL_BITS).cast("int"))


def with_position(
    df: DataFrame, order_by: list[str], out: str = "position", partitions: int | None = None
) -> DataFrame:
    """Add the 0-based place of each row in ``order_by`` order and ``total`` rows."""
    ranged = _ranged(df, [F.col(c) for c in order_by], partitions)
    # One row per partition: the windows below run over at most `partitions` rows.
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select(
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(everything).alias("total"),
    )
    local = F.col("_mid") - F.shiftleft(F.col("_part").cast("long"), _LOCAL_BITS)
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_before") + local)
        .drop("_part", "_mid", "_before")
    )


def with_previous(
    df: DataFrame,
    key: str,
    order_by: list[str],
    value: str,
    out: str,
    partitions: int | None = None,
) -> DataFrame:
    """Add the ``value`` of the preceding row with the same ``key`` (null for the first).

    Keys must not be null. Only the first key of a partition can continue from the
    partition before it, so one carried (key, value) per partition is enough.
    """
    ranged = _ranged(df, [F.col(key), *[F.col(c) for c in order_by]], partitions)
    ends = ranged.groupBy("_part").agg(
        F.max_by(F.struct(F.col(key).alias("k"), F.col(value).alias("v")), "_mid").alias("_end")
    )
    by_part = Window.orderBy("_part")  # at most `partitions` rows
    carry = ends.select("_part", F.lag("_end").over(by_part).alias("_carry"))
    local = Window.partitionBy("_part", key).orderBy("_mid")
    first = F.row_number().over(local) == 1
    return (
        ranged.withColumn("_first", first)
        .withColumn("_lag", F.lag(value).over(local))
        .join(F.broadcast(carry), "_part", "left")
        .withColumn(
            out,
            F.when(~F.col("_first"), F.col("_lag")).when(
                F.col("_carry")["k"] == F.col(key), F.col("_carry")["v"]
            ),
        )
        .drop("_part", "_mid", "_first", "_lag", "_carry")
    )


#: Kinds of rows that a task of ``changes`` gives.
_HIT, _FIRST, _LAST = 0, 1, 2


def _scan(key: str, value: str, out: str):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Hits of one sorted partition, its first row (without ``out``) and its last row."""
        part, end = TaskContext.get().partitionId(), None
        for rows in batches:
            if rows.empty:
                continue
            before = rows[[key, value]].astype(object).shift(1)
            if end is not None:
                before.iloc[0] = end.iloc[-1][[key, value]]
            hit = (before[key] == rows[key]) & before[value].notna() & rows[value].notna() & (before[value] != rows[value])
            kind = pd.Series(_HIT, index=rows.index)
            if end is None:
                kind.iloc[0] = _FIRST
                hit.iloc[0] = True
            yield rows[hit].assign(**{out: before[value][hit], "_part": part, "_kind": kind[hit]})
            end = rows.tail(1)
        if end is not None:
            yield end.assign(**{out: None, "_part": part, "_kind": _LAST})

    return scan


def changes(
    df: DataFrame, key: str, order_by: list[str], value: str, out: str, partitions: int | None = None
) -> DataFrame:
    """The rows whose ``value`` is not that of the preceding row of the same ``key``, kept in ``out``.

    A null on either side is no change; keys must not be null; ``order_by`` must be total for each
    key. Rows are exchanged once, by ranges of (key, order), so any key may spread over many
    tasks. A task goes through its sorted rows and gives the changes and its two border rows;
    only these are checkpointed, and the borders are settled among themselves.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    order = [F.col(key), *[F.col(c) for c in order_by]]
    ranged = df.repartitionByRange(partitions or _partitions(df), *order).sortWithinPartitions(*order)
    extra = [
        T.StructField(out, df.schema[value].dataType), T.StructField("_part", T.IntegerType()),
        T.StructField("_kind", T.IntegerType()),
    ]
    nullable = [T.StructField(f.name, f.dataType) for f in df.schema.fields]
    found = ranged.mapInPandas(_scan(key, value, out), T.StructType(nullable + extra)).checkpoint()
    # At most two rows for each partition.
    borders = found.filter(F.col("_kind") != _HIT)
    ends = borders.select("_part", "_kind", F.struct(F.col(key).alias("k"), F.col(value).alias("v")).alias("_end"))
    by_part = Window.orderBy("_part", "_kind")
    carry = ends.withColumn("_carry", F.lag("_end").over(by_part)).filter(F.col("_kind") == _FIRST)
    first = (
        borders.filter(F.col("_kind") == _FIRST)
        .drop(out)
        .join(F.broadcast(carry.select("_part", "_carry")), "_part")
        .filter((F.col("_carry")["k"] == F.col(key)) & (F.col("_carry")["v"] != F.col(value)))
        .withColumn(out, F.col("_carry")["v"])
    )
    kept = [*df.columns, out]
    return found.filter(F.col("_kind") == _HIT).select(*kept).unionByName(first.select(*kept))
