"""Line dedup with two Bloom filters.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. One pass
builds two filters over the hashes of all keys: one of hashes seen in a document, one of hashes
seen in a second. Tasks fill their own pair; pairs merge by position, where a bit that two
tasks set once counts as seen twice. The second filter therefore misses no repeat. Only keys
that it suspects are shuffled, as digests, to confirm them exactly and to find the smallest
document that holds them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import ship
from .common import add_columns, materialize, texts_of, tidy, unused

ship(__name__)

SPACE = b" \t\n\x0b\x0c\r"
SHORTEST = 10
BITS_PER_LINE = 16
#: Size bound of the broadcast filter: 64 MB. A fuller filter suspects more keys, and exact
#: confirmation sorts them out, so the bound never changes a result.
MOST_BITS = 1 << 29
_FLUSH = 1 << 21


def line_key(line: str) -> bytes:
    return line.encode("utf-8", "surrogatepass").strip(SPACE).lower()


def long_enough(key: bytes) -> bool:
    n = len(key)
    return n >= SHORTEST and (n >= 4 * SHORTEST or len(key.decode("utf-8", "surrogatepass")) >= SHORTEST)


def keys_of(text: str) -> set[bytes]:
    return {k for k in map(line_key, text.split("\n")) if long_enough(k)}


def _hashes(keys: set[bytes]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(k) for k in keys]


def positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each hash in a filter of ``bits`` bits (a power of two)."""
    mask = np.uint64(bits - 1)
    return (hashes & mask).astype("u4"), ((hashes >> np.uint64(32)) & mask).astype("u4")


def filter_size(lines: int) -> int:
    wanted = 1 << max(16, (max(lines, 1) * BITS_PER_LINE - 1).bit_length())
    return min(wanted, MOST_BITS)


def _sparse_filters(df: DataFrame, bits: int, shards: int) -> DataFrame:
    """Rows (shard, once, twice): set positions of each task's filters, by range of positions."""
    span = bits // shards

    def pieces(hashes: list[int]) -> Iterator[pa.RecordBatch]:
        h, n = np.unique(np.array(hashes, "u8"), return_counts=True)
        once = np.unique(np.concatenate(positions(h, bits)))
        twice = np.unique(np.concatenate(positions(h[n > 1], bits)))
        edges = np.arange(shards + 1, dtype="u8") * np.uint64(span)
        a, b = np.searchsorted(once, edges), np.searchsorted(twice, edges)
        for s in range(shards):
            if a[s] < a[s + 1]:
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([s], pa.int32()),
                    "once": [(once[a[s] : a[s + 1]] - s * span).astype("u4").tobytes()],
                    "twice": [(twice[b[s] : b[s + 1]] - s * span).astype("u4").tobytes()],
                })

    def run(batches):
        found: list[int] = []
        for batch in batches:
            for text in texts_of(batch):
                found += _hashes(keys_of(text))
            if len(found) >= _FLUSH:
                yield from pieces(found)
                found = []
        yield from pieces(found)

    return df.select("text").mapInArrow(tidy(run), "shard int, once binary, twice binary")


def twice_seen(df: DataFrame) -> tuple[bytes, int]:
    """The merged filter of hashes in two or more documents, and its number of bits."""
    lines = df.select(F.sum(F.size(F.split("text", "\n"))).cast("bigint")).first()[0] or 0
    bits = filter_size(lines)
    # A shard's positions and its bits both stay small, whatever the input.
    shards = 1 << min(12, max(4, (lines // 500_000).bit_length()))
    span = bits // shards

    def merge(batches):
        shard, once, twice = None, None, None

        def done():
            packed = np.packbits(twice, bitorder="little").tobytes()
            return pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "bits": [packed]}
            )

        for batch in batches:
            for s, one, two in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    if shard is not None:
                        yield done()
                    shard, once, twice = s, np.zeros(span, bool), np.zeros(span, bool)
                p = np.frombuffer(one, "u4")
                twice[p[once[p]]] = True
                once[p] = True
                twice[np.frombuffer(two, "u4")] = True
        if shard is not None:
            yield done()

    merged = (
        _sparse_filters(df, bits, shards)
        .repartition(shards, "shard")
        .sortWithinPartitions("shard")
        .mapInArrow(tidy(merge), "shard int, bits binary")
    )
    out = bytearray(bits // 8)
    for r in merged.collect():
        out[r.shard * span // 8 : (r.shard + 1) * span // 8] = r.bits
    return bytes(out), bits


def suspects(df: DataFrame, packed: bytes, bits: int) -> DataFrame:
    """Rows (doc_id, digest) of the keys that the filter takes for repeats."""
    shared = df.sparkSession.sparkContext.broadcast(packed)

    def run(batches):
        seen = np.frombuffer(shared.value, "u1")

        def in_filter(p: np.ndarray) -> np.ndarray:
            return (seen[p >> 3] >> (p & 7).astype("u1")) & 1 == 1

        for batch in batches:
            ids, digests = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                keys = list(keys_of(text))
                a, b = positions(np.array(_hashes(keys), "u8"), bits)
                for i in np.flatnonzero(in_filter(a) & in_filter(b)):
                    ids.append(doc_id)
                    digests.append(hashlib.sha256(keys[i]).digest())
            yield pa.RecordBatch.from_pydict(
                {"doc_id": pa.array(ids, pa.int64()), "digest": pa.array(digests, pa.binary())}
            )

    rows = df.select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(tidy(run), "doc_id bigint, digest binary")


def lost_lines(df: DataFrame) -> DataFrame:
    """Rows (doc_id, lost): digests of the keys that a document loses."""
    packed, bits = twice_seen(df)
    found = materialize(suspects(df, packed, bits), "suspects")
    # Combined before the shuffle, so a line of a third of all documents is one row per task.
    repeats = found.groupBy("digest").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last"))
    repeats = materialize(repeats.filter("_first < _last").drop("_last"), "repeats")
    lost = found.join(repeats, "digest").filter(F.col("doc_id") > F.col("_first"))
    return lost.groupBy("doc_id").agg(F.collect_set("digest").alias("_lost"))


def dedup_lines(df: DataFrame) -> DataFrame:
    """Drop repeated lines from ``text``; adds ``n_lines`` (before) and ``n_dropped``.

    Keys of at least ten code points that two or more documents hold lose all their lines
    except in the smallest ``doc_id``. A null or empty text is one empty line and comes out
    empty. Rows with equal ids are one document; rows with a null id are kept whole and do
    not count as holders. Other columns pass through, whatever their names, but for ``n_lines``
    and ``n_dropped``, which are replaced.
    """
    gone_name, id_name = unused(df, "lost"), unused(df, "id")
    lost = materialize(lost_lines(df), "lost").select(
        F.col("doc_id").alias(id_name), F.col("_lost").alias(gone_name)
    )
    joined = df.join(
        lost.hint("shuffle_hash"), F.col("doc_id").cast("bigint") == F.col(id_name), "left"
    ).drop(id_name)

    def make():
        def fn(batch: pa.RecordBatch) -> dict:
            kept, lines, dropped = [], [], []
            for text, gone in zip(texts_of(batch), batch.column(gone_name).to_pylist(), strict=True):
                parts = text.split("\n")
                lines.append(len(parts))
                if gone:
                    gone = set(gone)
                    parts = [
                        p for p in parts
                        if not (long_enough(k := line_key(p)) and hashlib.sha256(k).digest() in gone)
                    ]
                dropped.append(lines[-1] - len(parts))
                kept.append("\n".join(parts))
            return {"text": pa.array(kept, pa.string()), "n_lines": pa.array(lines, pa.int64()),
                    "n_dropped": pa.array(dropped, pa.int64())}

        return fn

    return add_columns(joined, make, "text string, n_lines bigint, n_dropped bigint").drop(gone_name)


def digests(documents: DataFrame) -> DataFrame:
    return dedup_lines(documents.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM docs
), keyed AS (
  SELECT doc_id, line, pos,
    translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeats AS (
  SELECT key, min(doc_id) AS first_id FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING min(doc_id) < max(doc_id)
), marked AS (
  SELECT k.doc_id, k.line, k.pos, r.key IS NOT NULL AND k.doc_id > r.first_id AS gone
  FROM keyed k LEFT JOIN repeats r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
