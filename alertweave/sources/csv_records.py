"""CSV with quoted multi-line values, read by many tasks (S-9).

A line break ends a record unless it lies inside quotes. Whether it does depends on all quotes
before it, so the file is read twice. The first pass counts the quotes of each split; the parity
of all splits before it tells whether a split starts inside a value. In the second pass each
task puts its own lines together to records. Only a record that crosses the border of a split
is put together in a shuffle, from the pieces that its splits hold.

A quote inside a value must be doubled and the value quoted, as CSV writers do; escapes are
doubled quotes alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import ship

ship(__name__)

OPTIONS = dict(
    multiLine=True, escape='"', quote='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
)
#: Records that a task gives to Spark at once.
CHUNK = 4096
_PIECES = "path string, block bigint, n bigint, part bigint, text string, whole boolean"


def split_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, block, value``: the physical lines, those of a split in order in one task."""
    return spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
    )


def quote_parity(lines: DataFrame) -> list[tuple[str, int, int, bool]]:
    """(path, block, odd, ends) of each split: whether its quotes are odd, and whether a line
    ends outside quotes if the split starts inside. The driver has planned the splits itself,
    so one row for each is no more than it holds."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))

    def run(batches):
        at, odd, ends = None, 0, False

        def out(rows):
            columns = zip(*rows, strict=True) if rows else [()] * 4
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "block", "odd", "ends"]
            )

        for batch in batches:
            done = []
            for path, block, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (path, block) != at:
                    if at is not None:
                        done.append((*at, odd, ends))
                    at, odd, ends = (path, block), 0, False
                odd ^= more
                ends = ends or odd == 1
            yield out(done)
        yield out([(*at, odd, ends)] if at is not None else [])

    slim = lines.select("path", "block", (quotes % 2).cast("int").alias("odd"))
    return [tuple(r) for r in slim.mapInArrow(run, "path string, block bigint, odd int, ends boolean").collect()]


def starts_inside(parity: Iterable[tuple[str, int, int, bool]]) -> dict[tuple[str, int], int]:
    """The splits that start inside a quoted value, with the split in which its record began."""
    out: dict[tuple[str, int], int] = {}
    at, inside, since = None, 0, 0
    for path, block, odd, ends in sorted(parity):
        if path != at:
            at, inside, since = path, 0, 0
        if inside:
            out[path, block] = since
        if not inside or ends:
            since = block
        inside ^= odd
    return out


def records_of(
    lines: Iterable[tuple[str, int, str]], inside: dict[tuple[str, int], int]
) -> Iterator[tuple[str, int, int, int, str, bool]]:
    """(path, block, n, part, text, whole): records in the lines of whole splits.

    ``block`` and ``n`` are the split and the number of the line in it where the record begins. A piece of a
    record that goes over a border is not whole; the last record of a split that begins in it
    has n -1 then, as only one such record can leave a split, and ``part`` is the split of the piece.
    """
    at, held, open_, n, first, owner = None, [], False, 0, 0, None

    def left() -> Iterator[tuple[str, int, int, int, str, bool]]:
        if held:
            yield at[0], at[1] if owner is None else owner, -1, at[1], "\n".join(held), False

    for path, block, line in lines:
        if (path, block) != at:
            yield from left()
            at, held, n = (path, block), [], 0
            owner = inside.get(at)
            open_ = owner is not None
        if not held:
            first = n
        held.append(line)
        n += 1
        if line.count('"') % 2:
            open_ = not open_
        if not open_:
            if owner is None:
                yield path, block, first, block, "\n".join(held), True
            else:
                yield path, owner, -1, block, "\n".join(held), False
                owner = None
            held = []
    yield from left()


def logical_records(lines: DataFrame, inside: dict[tuple[str, int], int]) -> DataFrame:
    """``path, block, n, text`` of every record; ``path, block, n`` is the file order."""

    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def chunk(found: list) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            columns = zip(*found, strict=True) if found else [()] * len(kinds)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["path", "block", "n", "part", "text", "whole"],
            )

        found: list = []
        for record in records_of(rows(), inside):
            found.append(record)
            if len(found) == CHUNK:
                yield chunk(found)
                found = []
        yield chunk(found)

    pieces = lines.select("path", "block", "value").mapInArrow(run, _PIECES)
    whole = pieces.filter("whole").select("path", "block", "n", "text")
    if not inside:
        # No record crosses a border. The last one of a file may lack its closing quote.
        return pieces.select("path", "block", "n", "text")
    parts = pieces.filter("NOT whole").groupBy("path", "block").agg(
        F.array_sort(F.collect_list(F.struct("part", "text"))).alias("parts")
    )
    joined = parts.select("path", "block", F.lit(1 << 62).alias("n"), F.array_join(F.col("parts.text"), "\n").alias("text"))
    return whole.unionByName(joined)


def read_records(
    spark: SparkSession, paths: str | list[str], row_order: str | None = None
) -> DataFrame:
    """All-string rows of CSV files with a header line each; missing values are empty text.

    Names come from the header of the first file. ``row_order`` names a sortable column with the file
    order of the rows. Records end at ``\\n`` or ``\\r\\n``; empty lines are no records. The task
    count follows ``spark.sql.files.maxPartitionBytes``, not the number of files.
    """
    header = spark.read.csv(paths, header=True, inferSchema=False, **OPTIONS)
    names = header.columns
    lines = split_lines(spark, paths)
    inside = starts_inside(quote_parity(lines))
    records = logical_records(lines, inside)
    # The header is the first record of each file: block 0, line 0, or all of it across a border.
    first = records.filter("block = 0").groupBy("path").agg(F.min("n").alias("_head"))
    heads = {r.path: r._head for r in first.filter("_head > 0").collect()} if inside else {}
    is_head = (F.col("block") == 0) & (F.col("n") == 0)
    for path, n in heads.items():
        is_head = is_head | ((F.col("path") == path) & (F.col("block") == 0) & (F.col("n") == n))
    text = F.regexp_replace("text", r"\r$", "")
    body = records.filter(~is_head).withColumn("text", text).filter(F.length("text") > 0)
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in OPTIONS.items()}
    parsed = body.select(
        F.struct("path", "block", "n").alias("_order"), F.from_csv("text", schema, options).alias("_row")
    )
    columns = [F.coalesce(F.col("_row")[f"c{i}"], F.lit("")).alias(name) for i, name in enumerate(names)]
    if row_order is not None:
        columns.append(F.col("_order").alias(row_order))
    return parsed.select(*columns)
