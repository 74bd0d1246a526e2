"""Registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    bpe,
    decontaminate,
    iblt,
    language_id,
    line_dedup,
    pii,
    quality,
    secrets,
    simhash,
    spelling,
    token_counts,
    warc,
    whitening,
)
from .common import prepare, shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


@query
def op1_language_id(spark, sf_dir):
    return language_id.predictions(table(spark, sf_dir, "documents"))


@query
def op2_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


ORACLE["op2_warc"] = warc.ORACLE


@query
def op3_line_dedup(spark, sf_dir):
    return line_dedup.digests(table(spark, sf_dir, "documents"))


ORACLE["op3_line_dedup"] = line_dedup.ORACLE


@query
def op4_bpe_round_trip(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"))


@query
def op5_simhash(spark, sf_dir):
    return simhash.document_classes(table(spark, sf_dir, "documents"))


@query
def op6_token_counts(spark, sf_dir):
    """A new cache for each call, so each call counts every distinct text."""
    cache = f"{shared_folder(spark)}/token-cache-{uuid.uuid4().hex}"
    return token_counts.document_counts(table(spark, sf_dir, "documents"), cache)


@query
def op7_decontamination(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op7_decontamination"] = decontaminate.ORACLE


@query
def op8_fingerprints(spark, sf_dir):
    return iblt.report(table(spark, sf_dir, "documents"))


@query
def op9_pii(spark, sf_dir):
    return pii.summary(table(spark, sf_dir, "documents"))


@query
def op10_quality(spark, sf_dir):
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_spelling_variants(spark, sf_dir):
    return spelling.report(table(spark, sf_dir, "documents"))


@query
def op12_secret_scan(spark, sf_dir):
    """A new ledger for each call, so each call scans every distinct text."""
    ledger = f"{shared_folder(spark)}/blob-ledger-{uuid.uuid4().hex}"
    return secrets.report(table(spark, sf_dir, "documents"), ledger)


ORACLE["op12_secret_scan"] = secrets.ORACLE


@query
def op13_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
