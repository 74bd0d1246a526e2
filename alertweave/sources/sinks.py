"""Writers (K-1 .. K-8). Everything is append-only or written to a new path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import empty_to_null, iso_micros, non_blank, stable_id
from ..operators import dataset as D
from . import commits
from .readers import read_dataset


def write_audit(
    entries: DataFrame, path: str, fmt: str = "parquet", partition_by_date: bool = True
) -> None:
    """Append audit entries. Blank ids are replaced by a hash of the entry.

    Parquet partitioned by date is the form to query; ``json`` keeps one line per entry
    under the interchange names.
    """
    fixed = with_entry_ids(entries)
    if fmt == "json":
        fixed.select(
            F.col("entry_id").alias("entryId"),
            iso_micros(F.col("ts")).alias("timestampUtc"),
            F.col("correlation_id").alias("correlationId"),
            "component",
            F.col("event_type").alias("eventType"),
            "message",
            "data",
        ).write.mode("append").json(path)
        return
    writer = fixed.withColumn("date", F.to_date("ts")).write.mode("append").format(fmt)
    if partition_by_date:
        writer = writer.partitionBy("date")
    writer.save(path)


def with_entry_ids(entries: DataFrame) -> DataFrame:
    """Entries with a hash of the entry in place of a blank id."""
    id_ = F.when(non_blank("entry_id"), F.col("entry_id")).otherwise(
        stable_id(
            F.lit("entry"), "correlation_id", F.col("ts").cast("string"), "component",
            "event_type", "message", F.to_json("data"),
        )
    )
    return entries.withColumn("entry_id", id_)


def write_csv(df: DataFrame, path: str, mode: str) -> None:
    """All-string rows with a header in each file; empty and missing values are both empty."""
    df.select(*[empty_to_null(c).alias(c) for c in df.columns]).write.mode(mode).csv(
        path, header=True, escape='"', quote='"', emptyValue="", nullValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def append_dataset(
    spark: SparkSession,
    incoming: DataFrame,
    path: str,
    fields: list[str],
    unique_fields: list[str],
    order_by: list[str],
    stored: DataFrame | None = None,
    batch: str | None = None,
) -> int:
    """Append the new rows of ``incoming`` to a CSV dataset and return how many.

    The rows are pinned before the write, so the count and the file agree and the
    anti-join reads the dataset as it was.

    ``batch`` names the append and makes it happen once (``commits``): run again after a loss at
    any point, it leaves the dataset as one run would. Without it the files are appended plainly,
    and rows of a half-committed append can be there twice after a retry.
    """
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    if batch is not None and (before := commits.rows_of(spark, path, batch)) is not None:
        return before
    before = stored if stored is not None else _stored(spark, path, fields)
    fresh = D.new_rows(before, incoming, unique_fields, order_by).checkpoint()
    added = fresh.count()
    if batch is not None:
        return commits.append(spark, path, batch, added, lambda at: write_csv(fresh.select(*fields), at, "errorifexists"))
    if added:
        write_csv(fresh.select(*fields), path, "append")
    return added


def _stored(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    from .readers import _exists

    if _exists(spark, path) and commits.committed(spark, path) != []:
        return read_dataset(spark, path)
    return spark.createDataFrame([], ", ".join(f"`{f}` string" for f in fields))


def rewrite_deduplicated(
    dataset: DataFrame,
    new_path: str,
    fields: list[str],
    unique_fields: list[str],
    order_by: list[str],
) -> int:
    """Write the deduplicated dataset to ``new_path`` (never over its own input).

    Returns the duplicates removed; switching readers to the new path is the swap.
    """
    removed = D.duplicate_count(dataset, unique_fields).first()[0]
    kept = D.deduplicate(dataset, unique_fields, order_by)
    write_csv(kept.select(*fields), new_path, "errorifexists")
    return removed


def ingest_statistics(
    stored: DataFrame, incoming: DataFrame, unique_fields: list[str], order_by: list[str]
) -> DataFrame:
    """What ``ingest`` would report: rows it adds, and repeats that a dedupe then removes."""
    fresh = D.new_rows(stored, incoming, unique_fields, order_by)
    added = fresh.agg(F.count("*").alias("added_rows"))
    removed = D.duplicate_count(stored.unionByName(fresh), unique_fields)
    return added.select("added_rows", F.lit(1).alias("_one")).join(
        removed.withColumn("_one", F.lit(1)), "_one"
    ).drop("_one")


def ingest(
    spark: SparkSession,
    incoming: DataFrame,
    path: str,
    fields: list[str],
    unique_fields: list[str],
    order_by: list[str],
    dedup_to: str | None = None,
    batch: str | None = None,
) -> dict:
    """Append and optionally deduplicate; returns the ingest statistics (A-8)."""
    added = append_dataset(spark, incoming, path, fields, unique_fields, order_by, batch=batch)
    removed = 0
    if dedup_to is not None:
        removed = rewrite_deduplicated(
            read_dataset(spark, path, row_order="row_no"), dedup_to, fields, unique_fields,
            ["row_no"],
        )
    return {"added_rows": added, "duplicates_removed": removed}


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Prompt and completion as JSON lines; non-ASCII text stays as it is."""
    pairs.select("prompt", "completion").write.mode("errorifexists").json(path)


def write_extracts(documents: DataFrame, path: str) -> None:
    """One directory per dataset id holding its JSON array; an id is written by one task."""
    documents.repartition("dataset_id").write.mode("errorifexists").partitionBy("dataset_id").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """Candidates or response plans as JSON."""
    df.write.mode("errorifexists").json(path)


def append_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Append rows of an event-like table (case events, outbox, acknowledgements)."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def write_outbox(outbox: DataFrame, path: str) -> None:
    append_table(outbox, path, ("target",))


