"""JSON arrays in one large file, read by many tasks (S-5).

The file is read in pieces that end at commas, so no row is larger than an element, and a file has as many
tasks as splits. A comma ends an element if it lies outside strings and inside one bracket, which depends on
everything before it. The first pass sums up each split for both cases, that it starts inside a string or
outside: quotes, brackets, commas by depth. Folding these gives the state and the element number at
each split's start. The second pass cuts the elements; one that crosses the border of a split
is joined from its pieces in a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import ship

ship(__name__)

_ESCAPED = re.compile(r"\\.", re.S)
_TOKENS = re.compile(r"[\[\]{}]|[^\[\]{}\s]+")
_NONE = 1 << 30
CHUNK = 4096
_SUMMARY = (
    "path string, block bigint, odd int, first string, texts boolean, "
    "delta array<int>, low array<int>, early array<int>, depths array<array<int>>, counts array<array<bigint>>"
)


def split_pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, block, value``: the text between commas, the pieces of a split in order in one task."""
    return spark.read.option("lineSep", ",").text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
    )


def segments(piece: str) -> list[str]:
    """The parts of a piece between unescaped quotes."""
    return (_ESCAPED.sub("", piece) if "\\" in piece else piece).split('"')


@dataclass
class Summary:
    """What a split does to the state, for a start outside (0) and inside (1) of a string."""

    odd: int = 0
    first: str = ""
    texts: bool = False
    delta: list[int] = field(default_factory=lambda: [0, 0])
    #: Least depth behind a closing bracket, and behind one that more text follows.
    low: list[int] = field(default_factory=lambda: [_NONE, _NONE])
    early: list[int] = field(default_factory=lambda: [_NONE, _NONE])
    commas: list[Counter] = field(default_factory=lambda: [Counter(), Counter()])

    def add(self, piece: str) -> None:
        for i, part in enumerate(segments(piece)):
            if i:
                self.odd ^= 1
                self.early, self.texts = list(self.low), True
                self.first = self.first or '"'
            if not part or part.isspace():
                continue
            self.texts = True
            self.first = self.first or part.lstrip("\ufeff \t\r\n")[:1]
            # The part lies outside strings for the start that agrees with the quotes so far.
            h = self.odd
            for token in _TOKENS.findall(part):
                self.early[h] = self.low[h]
                if token in "[{":
                    self.delta[h] += 1
                elif token in "]}":
                    self.delta[h] -= 1
                    self.low[h] = min(self.low[h], self.delta[h])
        self.commas[self.odd][self.delta[self.odd]] += 1


@dataclass
class Start:
    """The state at the start of a split, and the number of the element that is open there."""

    inside: int
    depth: int
    element: int


@dataclass
class File:
    first: str
    single: bool
    last: int


def fold(found: Iterable[tuple[str, int, Summary]]) -> tuple[dict[tuple[str, int], Start], dict[str, File]]:
    """States at the starts of all splits, and the shape of each file."""
    starts: dict[tuple[str, int], Start] = {}
    shapes: dict[str, File] = {}
    by_path: dict[str, list[tuple[int, Summary]]] = {}
    for path, block, s in found:
        by_path.setdefault(path, []).append((block, s))
    for path, splits in by_path.items():
        now, ended, early, first, outer = Start(0, 0, 0), False, False, "", 0
        for block, s in sorted(splits, key=lambda x: x[0]):
            starts[path, block] = Start(now.inside, now.depth, now.element)
            h = now.inside
            first = first or s.first
            early = early or (ended and s.texts) or now.depth + s.early[h] <= 0
            ended = ended or now.depth + s.low[h] <= 0
            outer += s.commas[h][-now.depth]
            now = Start(h ^ s.odd, now.depth + s.delta[h], now.element + s.commas[h][1 - now.depth])
        # The end of the file counts as a comma; no other may lie outside all brackets.
        single = ended and not early and now.depth == 0 and not now.inside and outer == 1
        shapes[path] = File(first, single, now.element)
    return starts, shapes


def summaries(pieces: DataFrame) -> list[tuple[str, int, Summary]]:
    """One row for each split, which the driver has planned itself."""

    def run(batches):
        at, s = None, Summary()

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([
                dict(path=p, block=b, odd=int(x.odd), first=x.first, texts=x.texts, delta=x.delta, low=x.low,
                     early=x.early, depths=[list(c) for c in x.commas], counts=[list(c.values()) for c in x.commas])
                for (p, b), x in rows
            ], schema=pa.schema([
                ("path", pa.string()), ("block", pa.int64()), ("odd", pa.int32()), ("first", pa.string()),
                ("texts", pa.bool_()), ("delta", pa.list_(pa.int32())), ("low", pa.list_(pa.int32())),
                ("early", pa.list_(pa.int32())), ("depths", pa.list_(pa.list_(pa.int32()))),
                ("counts", pa.list_(pa.list_(pa.int64()))),
            ]))

        for batch in batches:
            done = []
            for path, block, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (path, block) != at:
                    if at is not None:
                        done.append((at, s))
                    at, s = (path, block), Summary()
                s.add(value)
            yield out(done)
        yield out([(at, s)] if at is not None else [])

    rows = pieces.mapInArrow(run, _SUMMARY).collect()
    return [
        (r.path, r.block, Summary(r.odd, r.first, r.texts, r.delta, r.low, r.early, [
            Counter(dict(zip(d, n, strict=True))) for d, n in zip(r.depths, r.counts, strict=True)]))
        for r in rows
    ]


def cut(
    pieces: Iterable[tuple[str, int, str]], starts: dict[tuple[str, int], Start]
) -> Iterator[tuple[str, int, int, str, bool]]:
    """(path, element, block, text, whole): elements, and pieces of those at a split's ends."""
    at, held, inside, depth, element, whole = None, [], 0, 0, 0, False
    for path, block, piece in pieces:
        if (path, block) != at:
            if held:
                yield at[0], element, at[1], ",".join(held), False
            at, held, whole = (path, block), [], False
            inside, depth, element = starts[at].inside, starts[at].depth, starts[at].element
        held.append(piece)
        for i, part in enumerate(segments(piece)):
            inside ^= i > 0
            if not inside:
                depth += part.count("[") + part.count("{") - part.count("]") - part.count("}")
        if depth == 1 and not inside:
            yield path, element, block, ",".join(held), whole
            held, whole, element = [], True, element + 1
    if held:
        yield at[0], element, at[1], ",".join(held), False


def elements(pieces: DataFrame, starts: dict[tuple[str, int], Start], shapes: dict[str, File]) -> DataFrame:
    """``path, pos, value``: the elements of each file's array as they stand there."""

    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def chunk(found: list) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            columns = zip(*found, strict=True) if found else [()] * len(kinds)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["path", "pos", "block", "value", "whole"],
            )

        found: list = []
        for one in cut(rows(), starts):
            found.append(one)
            if len(found) == CHUNK:
                yield chunk(found)
                found = []
        yield chunk(found)

    cuts = pieces.mapInArrow(run, "path string, pos bigint, block bigint, value string, whole boolean")
    parts = cuts.filter("NOT whole").groupBy("path", "pos").agg(
        F.array_sort(F.collect_list(F.struct("block", "value"))).alias("parts")
    )
    joined = parts.select("path", "pos", F.array_join(F.col("parts.value"), ",").alias("value"))
    every = cuts.filter("whole").select("path", "pos", "value").unionByName(joined)
    last = every.sparkSession.createDataFrame([(p, f.last) for p, f in shapes.items()], "path string, last bigint")
    value = F.when(F.col("pos") == 0, F.regexp_replace("value", r"^\s*﻿?\s*\[", "")).otherwise(F.col("value"))
    closed = every.join(last, "path").withColumn("value", value).withColumn(
        "value", F.when(F.col("pos") == F.col("last"), F.regexp_replace("value", r"\]\s*$", "")).otherwise(F.col("value"))
    )
    empty = (F.col("pos") == 0) & (F.col("last") == 0) & ~F.col("value").rlike(r"\S")
    return closed.filter(~empty).select("path", F.col("pos").cast("int").alias("pos"), "value")
