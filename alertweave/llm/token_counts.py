"""Token counts behind a digest cache.

A text is known by the digest of its normalised content and of the tokenizer file. Counts
that the cache table holds are joined; each distinct text that it lacks is encoded once and
appended to the table.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import ship
from .common import add_columns, materialize, texts_of

ship(__name__)

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens bigint"
#: Word counts kept per task; the store starts anew beyond it. It never changes a result.
REMEMBERED = 300_000
#: Texts and words that are handled at once; the library's encodings take much memory.
TEXTS, WORDS = 128, 4096
#: At most so many missing digests are sent to the texts, so that texts with a known count stay.
SHARED_ROWS = 200_000
_UNSURE = re.compile(r" \s|\s ")


def normalised(text: Column) -> Column:
    """The form in which texts are compared: null is the empty text, all else stays.

    Case, accents and white space change token counts, so nothing else may be folded.
    """
    return F.coalesce(text, F.lit(""))


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


class WordCounter:
    """Counts of the library's tokens, remembering words already seen.

    The pre-tokenizer never joins a space and the character before it. A text in which no
    space touches other white space, and which holds no added token, therefore falls into
    words with their space; the library counts each new word once per task. Every other text,
    and every text of a tokenizer of another kind, goes to the library whole.
    """

    def __init__(self, definition: str):
        # A task has one core; threads of the library would only take memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.known: dict[str, int] = {}
        form = json.loads(definition)
        split = form.get("pre_tokenizer") or {}
        self.by_word = (
            form.get("normalizer") is None
            and split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split.get("add_prefix_space", True)
        )

    def _library(self, texts: list[str]) -> list[int]:
        out = []
        for at in range(0, len(texts), WORDS):
            part = texts[at : at + WORDS]
            out += [len(e) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def count(self, texts: list[str]) -> list[int]:
        parts = (texts[at : at + TEXTS] for at in range(0, len(texts), TEXTS))
        return [n for part in parts for n in self._count(part)]

    def _count(self, texts: list[str]) -> list[int]:
        words, whole = {}, []
        for i, text in enumerate(texts):
            if not self.by_word or _UNSURE.search(text) or self.added.search(text):
                whole.append(i)
            else:
                first, *rest = text.split(" ")
                words[i] = ([first] if first else []) + [f" {w}" for w in rest]
        out = dict(zip(whole, self._library([texts[i] for i in whole]), strict=True))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set().union(*words.values()) - self.known.keys()) if words else []
        self.known.update(zip(new, self._library(new), strict=True))
        get = self.known.__getitem__
        out.update((i, sum(map(get, w))) for i, w in words.items())
        return [out[i] for i in range(len(texts))]


def add_counts(df: DataFrame, definition: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add the number of tokens of ``text``; null counts as empty."""
    shared = df.sparkSession.sparkContext.broadcast(definition)

    def make():
        counter = WordCounter(shared.value)
        return lambda batch: {out: pa.array(counter.count(texts_of(batch, text)), pa.int64())}

    return add_columns(df, make, f"`{out}` bigint")


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(folder)


def count_tokens(
    df: DataFrame, cache: str, definition: str, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Key, content digest, bytes and token count of every row; misses join the cache.

    ``cache`` is a Parquet folder, made if it is missing. Rows with equal texts are encoded
    once, whatever their keys; repeated rows and rows with null keys keep one result row each.
    """
    spark = df.sparkSession
    version = hashlib.sha256(definition.encode()).hexdigest()
    rows = df.select(key, normalised(F.col(text)).alias("_text")).withColumn(
        "content_digest", content_digest(F.col("_text"))
    )
    known = _of_version(spark, cache, version)
    digests = materialize(
        rows.select(
            key, "content_digest", F.octet_length("_text").cast("bigint").alias("n_bytes")
        ),
        "digests",
    )
    wanted = materialize(
        digests.select("content_digest").distinct().join(known, "content_digest", "left_anti"),
        "misses",
    )
    lacking = wanted.count()
    if lacking:
        texts = rows.select("content_digest", "_text")
        if lacking <= SHARED_ROWS:
            texts = texts.join(F.broadcast(wanted), "content_digest", "left_semi")
        # Copies meet on the map side, so a text that is everywhere moves once per task.
        misses = texts.dropDuplicates(["content_digest"])
        if lacking > SHARED_ROWS:
            misses = misses.join(wanted, "content_digest", "left_semi")
        add_counts(misses, definition, "_text").select(
            "content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens"
        ).write.mode("append").option("compression", "zstd").parquet(cache)
    # A run repeated after a failure may have stored a count twice.
    counts = _of_version(spark, cache, version).groupBy("content_digest").agg(
        F.min("n_tokens").alias("n_tokens")
    )
    return digests.join(materialize(counts, "counts"), "content_digest", "left").select(
        key, "content_digest", "n_bytes", "n_tokens"
    )


def _of_version(spark: SparkSession, cache: str, version: str) -> DataFrame:
    return read_cache(spark, cache).filter(F.col("tokenizer_digest") == version)


def document_counts(documents: DataFrame, cache: str, limit: int = 1024) -> DataFrame:
    """Bytes and tokens of every document, and whether it exceeds ``limit`` tokens."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    return count_tokens(documents, cache, definition).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
