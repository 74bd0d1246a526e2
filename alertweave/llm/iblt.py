"""Document fingerprints by invertible Bloom lookup tables.

A text's paragraphs become 64-bit digests, and each digest goes to one cell of each of three
subtables: a count, the xor of the digests and the xor of their checks. The tables of two
versions subtract cell by cell, so what both hold cancels. A cell with a single digest is pure;
taking that digest out of its other cells makes new pure cells, until the table is empty and all
differing digests are known. If that fails, the pair is tried again with a larger table.

Everything is DataFrame code. Cells are rows, and a round of peeling is an explode and an
aggregate by pair, which need no shuffle once the pairs are hash-partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SUBTABLES = 3
#: Cells of the fingerprint that stands for a text, whatever its length.
FIXED_CELLS = 12
#: First table of a pair, as cells for each digest of both versions, and growth after a failure.
FIRST_CELLS = 0.75
GROWTH = 2
SWEEPS = 3
_MOST_TRIES = 40


def paragraphs(text: Column) -> Column:
    """The distinct digests of the non-empty lines of a text; null counts as empty."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x != "")
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def check_of(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit("check"))


def place_of(digest: Column, subtable: int, size: Column, salt: int) -> Column:
    """The cell of a digest in a subtable of ``size`` cells, counted over all subtables."""
    return F.pmod(F.xxhash64(digest, F.lit(salt * SUBTABLES + subtable)), size) + subtable * size


def fingerprint(digests: Column, cells: int = FIXED_CELLS) -> Column:
    """The fixed-size table of a set of digests as hexadecimal text, cell by cell."""
    size = F.lit(cells // SUBTABLES).cast("bigint")

    def cell(i: Column) -> Column:
        own = F.filter(
            digests,
            lambda d: (place_of(d, 0, size, 0) == i) | (place_of(d, 1, size, 0) == i)
            | (place_of(d, 2, size, 0) == i),
        )
        xor = lambda values: F.aggregate(values, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseXOR(b))
        parts = [
            F.lpad(F.hex(F.size(own)), 4, "0"),
            F.lpad(F.hex(xor(own)), 16, "0"),
            F.lpad(F.hex(xor(F.transform(own, check_of)).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"),
        ]
        return F.lower(F.concat(*parts))

    each = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(cells - 1).cast("bigint")), cell)
    return F.array_join(each, "")


def _cells(pairs: DataFrame, tries: int) -> DataFrame:
    """The table of each pair's first version less that of its second, empty cells left out."""
    total = F.size("x") + F.size("y")
    ratio = FIRST_CELLS * GROWTH**tries / SUBTABLES
    size = (F.ceil(total * F.lit(ratio)) + 2).cast("bigint")
    signed = F.concat(
        F.transform("x", lambda d: F.struct(d.alias("d"), F.lit(1).cast("bigint").alias("s"))),
        F.transform("y", lambda d: F.struct(d.alias("d"), F.lit(-1).cast("bigint").alias("s"))),
    )
    each = pairs.repartition("pair").select("pair", size.alias("size"), F.explode(signed).alias("e"))
    spots = F.array(*[place_of(F.col("e.d"), t, F.col("size"), tries) for t in range(SUBTABLES)])
    rows = each.select(
        "pair", "size", F.explode(spots).alias("cell"), F.lit(0).cast("bigint").alias("found"),
        F.col("e.s").alias("count"), F.col("e.d").alias("digest"), check_of(F.col("e.d")).alias("check"),
        F.lit(0).cast("bigint").alias("n"),
    )
    return _summed(rows)


def _summed(rows: DataFrame) -> DataFrame:
    cells = rows.groupBy("pair", "size", "cell", "found").agg(
        F.sum("count").alias("count"), F.bit_xor("digest").alias("digest"),
        F.bit_xor("check").alias("check"), F.sum("n").alias("n"),
    )
    return cells.filter("n > 0 or count <> 0 or digest <> 0 or check <> 0")


def _peeled(cells: DataFrame, subtable: int, tries: int, keep: bool) -> DataFrame:
    """Take the digests of all pure cells of one subtable out of the other subtables.

    A digest has one cell in a subtable, so it is taken out once. Digests that were found go
    to cell -1: one row for each pair, or with ``keep`` one for each digest.
    """
    count, digest, check, size = (F.col(c) for c in ("count", "digest", "check", "size"))
    pure = (
        (F.col("cell") >= 0) & (F.abs(count) == 1) & (check == check_of(digest))
        & (F.floor(F.col("cell") / size) == subtable)
        & (F.col("cell") == place_of(digest, subtable, size, tries))
    )
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def row(cell, found, c, d, k, n) -> Column:
        return F.struct(
            cell.alias("cell"), found.alias("found"), c.alias("count"), d.alias("digest"),
            k.alias("check"), n.alias("n"),
        )

    taken = [
        row(place_of(digest, t, size, tries), zero, -count, digest, check, zero)
        for t in range(SUBTABLES) if t != subtable
    ]
    # With ``keep`` the digest is part of the key and the sign is kept as the count.
    taken.append(
        row(-one, digest if keep else zero, count if keep else zero, zero, zero, one)
    )
    same = row(F.col("cell"), F.col("found"), count, digest, check, F.col("n"))
    rows = cells.select("pair", "size", F.inline(F.when(pure, F.array(*taken)).otherwise(F.array(same))))
    return _summed(rows)


def _peel(pairs: DataFrame, tries: int, keep: bool) -> DataFrame:
    cells = _cells(pairs, tries)
    for _ in range(SWEEPS):
        for subtable in range(SUBTABLES):
            cells = _peeled(cells, subtable, tries, keep)
    return cells


def difference_sizes(pairs: DataFrame) -> DataFrame:
    """(pair, differ): how many digests are in one of ``x`` and ``y`` only.

    ``pairs`` has a unique ``pair`` and arrays of distinct digests. The number is that of the
    digests that peeling recovers; pairs that fail are tried again with tables twice as large.
    """
    open_pairs, done = pairs, None
    for tries in range(_MOST_TRIES):
        cells = _peel(open_pairs, tries, keep=False)
        by_pair = cells.groupBy("pair").agg(
            F.sum("n").alias("differ"), F.count_if(F.col("cell") >= 0).alias("left")
        )
        solved = materialize(by_pair, "peeled")
        ended = solved.filter("left = 0").select("pair", "differ")
        done = ended if done is None else done.unionByName(ended)
        failed = solved.filter("left > 0").select("pair")
        if failed.isEmpty():
            return done  # pairs without a row do not differ
        open_pairs = materialize(open_pairs.join(failed, "pair", "left_semi"), "retried")
    raise ValueError(f"digests were not recovered in {_MOST_TRIES} tries")


def differing_digests(pairs: DataFrame) -> DataFrame:
    """(pair, digest, side): the recovered digests; side 1 is in ``x`` only, -1 in ``y`` only."""
    open_pairs, done = pairs, None
    for tries in range(_MOST_TRIES):
        cells = materialize(_peel(open_pairs, tries, keep=True), "peeled")
        failed = cells.filter("cell >= 0").select("pair").distinct()
        found = cells.filter("cell < 0").join(failed, "pair", "left_anti").select(
            "pair", F.col("found").alias("digest"), F.col("count").cast("int").alias("side")
        )
        done = found if done is None else done.unionByName(found)
        if failed.isEmpty():
            return done
        open_pairs = materialize(open_pairs.join(failed, "pair", "left_semi"), "retried")
    raise ValueError(f"digests were not recovered in {_MOST_TRIES} tries")


def likeness(x: Column, y: Column, differ: Column) -> Column:
    """Shared digests as a part of all digests of both; 1 if both have none."""
    total = F.size(x) + F.size(y)
    return F.when(total == 0, F.lit(1.0)).otherwise((total - differ) / (total + differ))


# --- documents and their neighbours -----------------------------------------------------


def next_ids(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) for distinct ids: the next lower id; the highest after the lowest.

    Ids are range-partitioned. Each partition is solved alone, and one row for each partition
    carries the highest id across its border.
    """
    ranged = materialize(
        ids.repartitionByRange("doc_id").select("doc_id", F.spark_partition_id().alias("part")), "ranged"
    )
    inside = F.lag("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    tops = ranged.groupBy("part").agg(F.max("doc_id").alias("top"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    border = F.coalesce(F.lag("top").over(Window.orderBy("part")), F.max("top").over(every))
    carried = tops.select("part", border.alias("border"))  # one row for each partition
    return ranged.withColumn("inside", inside).join(F.broadcast(carried), "part").select(
        "doc_id", F.coalesce("inside", "border").alias("next_id")
    )


def versions(documents: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256``, digests ``own``, ``edited``, ``following``, ``row``.

    The edited text has the last third of a text replaced by as much of the next document's
    beginning. Rows with equal ids are edited alike; as a next document one of them stands
    for all, the same for every row. A null id has no next document.
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = docs.filter("doc_id is not null")
    third = F.floor(F.length("text") / 3).cast("int")
    sizes = known.select("doc_id", third.alias("third"))
    ids = materialize(sizes.groupBy("doc_id").agg(F.max("third").alias("third"), F.count("*").alias("n")), "ids")
    link = next_ids(ids.select("doc_id")).join(ids.select("doc_id", "third"), "doc_id")
    link = materialize(link.select(F.col("doc_id").alias("to_id"), "next_id", "third"), "links")
    source = known
    if not ids.filter("n > 1").isEmpty():
        source = known.groupBy("doc_id").agg(F.min("text").alias("text"))
    heads = source.join(link.hint("shuffle_hash"), F.col("doc_id") == F.col("next_id")).select(
        "to_id", F.expr("substring(text, 1, third)").alias("head"), paragraphs(F.col("text")).alias("following")
    )
    joined = known.join(heads, F.col("doc_id") == F.col("to_id")).select(
        "doc_id", "text", "head", "following"
    )
    alone = docs.filter("doc_id is null").select(
        "doc_id", "text", F.lit("").alias("head"), F.array().cast("array<bigint>").alias("following")
    )
    n = F.length("text")
    edited = F.concat(
        F.substring("text", F.lit(1), n - third), F.substring("head", F.lit(1), third)
    )
    both = joined.unionByName(alone).select(
        "doc_id", n.cast("bigint").alias("n_chars"), "text", "following", edited.alias("edited_text")
    )
    return materialize(
        both.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars",
            F.sha2("edited_text", 256).alias("edited_sha256"), paragraphs(F.col("text")).alias("own"),
            paragraphs(F.col("edited_text")).alias("edited"), "following",
        ),
        "versions",
    )


def report(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, and how alike they and the next are."""
    v = versions(documents)
    side = F.explode(
        F.array(
            F.struct((F.col("row") * 2).alias("pair"), F.col("own").alias("x"), F.col("edited").alias("y")),
            F.struct((F.col("row") * 2 + 1).alias("pair"), F.col("own").alias("x"), F.col("following").alias("y")),
        )
    )
    pairs = materialize(v.select(side.alias("p")).select("p.*"), "pairs")
    differ = difference_sizes(pairs).select(
        F.shiftright("pair", 1).alias("row"), (F.col("pair") % 2).alias("which"), "differ"
    )
    by_row = materialize(
        differ.groupBy("row").agg(
            F.sum(F.when(F.col("which") == 0, F.col("differ"))).alias("d_edited"),
            F.sum(F.when(F.col("which") == 1, F.col("differ"))).alias("d_next"),
        ),
        "differences",
    )
    zero = F.lit(0)
    return v.join(by_row, "row", "left").select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited"), F.coalesce("d_edited", zero)).alias("near_edited"),
        likeness(F.col("own"), F.col("following"), F.coalesce("d_next", zero)).alias("near_next"),
    )
