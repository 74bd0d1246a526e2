"""The stages of the corpus pipeline: operators with the decisions they lead to.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, line_dedup as lines, quality, simhash
from .common import materialize, table
from .decontaminate import shared


def _packed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and all other columns in one, so that their names meet no others."""
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *rest).alias("rest"))


def _unpacked(packed: DataFrame, docs: DataFrame, new: Sequence[str] = ()) -> DataFrame:
    """The columns of ``docs`` again, without those that the columns ``new`` replace, and these."""
    return packed.select(*[
        F.col(c) if c in ("doc_id", "text") else F.col("rest")[f"c{i}"].alias(c)
        for i, c in enumerate(docs.columns)
        if c not in new
    ], *new)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier, fitted on the labelled documents, does not reject.

    Each row is judged by its own text, a null one as empty; repeated rows and null ids are kept
    or dropped alike. No labels or no rows: all stay.
    """
    return _unpacked(quality.keep_good(_packed(docs), table(spark, sf_dir, "labels")), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop repeated lines; documents stay, with the text and length that remain.

    A null text comes out empty. Rows with equal ids are one document, rows with a null id keep
    all their lines.
    """
    kept = _unpacked(lines.dedup_lines(_packed(docs)).select("doc_id", "text", "rest"), docs)
    length = F.length("text").cast("bigint")
    return kept.select(*[length.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row, that of the smallest id, of each group of near copies.

    Near copies have a Jaccard similarity of 0.8 or more between their sets of five-word
    shingles, or are linked by others that have. Rows without an id come after all others, and
    of rows with the same id that of the smallest XXH64 of the text stays; if id and text are
    repeated, the smallest row. So a group without any id keeps one row too.
    """
    packed = _packed(docs)
    names = packed.columns
    classes = materialize(simhash.jaccard_classes(packed), "near-copies")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    copies = materialize(classes.filter(~stays).select("doc_id", "key").distinct(), "copies")
    twice = classes.filter(stays).groupBy("doc_id", "key").count().filter("count > 1").select("doc_id", "key")
    twice = shared(materialize(twice, "repeated"))
    same = lambda other: F.col("d.doc_id").eqNullSafe(other["doc_id"]) & (F.col("d._key") == other["key"])
    keyed = packed.withColumn("_key", F.xxhash64(F.coalesce("text", F.lit("")))).alias("d")
    copies = shared(copies)
    kept = keyed.join(copies, same(copies), "left_anti").alias("d")
    once = kept.join(twice, same(twice), "left_anti").select(*names)
    one = kept.join(twice, same(twice), "left_semi").groupBy("doc_id", "_key").agg(
        F.min(F.struct(*names)).alias("row")
    )
    return _unpacked(once.unionByName(one.select("row.*")), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item.

    Each row is judged by its own text, whatever its id: rows with null or repeated ids too.
    """
    hits = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    found = shared(materialize(hits, "hits"))
    same = decontaminate.text_digest(F.col("text")) == found["digest"]
    return _unpacked(_packed(docs).join(found, same, "left_anti"), docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the decoded bytes.

    Null counts as empty. Input columns named ``ids``, ``ids_sha256`` and ``decoded_sha256`` are
    replaced.
    """
    new = ["ids", "ids_sha256", "decoded_sha256"]
    texts = bpe.round_trip(_packed(docs), ids="ids")
    return _unpacked(texts, docs, new)
