"""Knowledge search by token overlap and runbook texts (J-10, W-3, P-32, P-33).

The score of an entry is the number of query tokens that occur in it as substrings,
so no equality key exists between the two sides. Entries are never paired with
queries as rows: each task keeps only the best k entries per query while it streams
over its entries, and one ranking per query merges those short lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions.staging import ship
from ..functions.text import PY_SPACE, empty_to_null, py_lines, py_strip

ship(__name__)

BLOCK_BYTES = 16 * 1024 * 1024
_PARTIAL = "query_id {id}, pos bigint, score int"
_MATRIX_BYTES = 32 * 1024 * 1024


def tokens(query: Column) -> Column:
    parts = F.split(F.lower(query), f"[{PY_SPACE}]+")
    return F.filter(parts, lambda t: t != "")


def haystack(entries: DataFrame) -> Column:
    tags = F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")
    return F.lower(
        F.concat(
            F.coalesce("title", F.lit("untitled")), F.lit(" "),
            F.coalesce("content", F.lit("")), F.lit(" "), tags,
        )
    )


def first_line(content: Column) -> Column:
    """First non-blank line, trimmed; empty when there is none."""
    lines = F.filter(F.transform(py_lines(content), py_strip), lambda x: x != "")
    return F.coalesce(F.get(lines, F.lit(0)), F.lit(""))


class _Best:
    """The k best (score, position) pairs per query seen so far in one task, scores above 0."""

    def __init__(self, queries: list[tuple[object, list[str]]], k: int):
        import ahocorasick

        self.ids = [q[0] for q in queries]
        self.k = k
        self.asks: dict[str, list[int]] = {}  # token -> queries, one entry per occurrence
        for q, (_, words) in enumerate(queries):
            for word in words:
                self.asks.setdefault(word, []).append(q)
        self.finder = ahocorasick.Automaton()
        for word, asking in self.asks.items():
            self.finder.add_word(word, (word, np.array(asking)))
        if self.asks:
            self.finder.make_automaton()
        self.score = [np.empty(0, dtype=np.int64) for _ in queries]
        self.pos = [np.empty(0, dtype=np.int64) for _ in queries]

    def _scores(self, text: str) -> np.ndarray:
        found = {word: asking for _, (word, asking) in self.finder.iter(text)}
        asking = np.concatenate([*found.values(), np.empty(0, dtype=np.int64)]).astype(np.int64)
        return np.bincount(asking, minlength=len(self.ids))

    def add(self, positions: np.ndarray, texts: list[str]) -> None:
        if not self.asks:
            return
        step = max(1, _MATRIX_BYTES // (8 * len(self.ids)))
        for start in range(0, len(texts), step):
            part = positions[start : start + step]
            scores = np.array([self._scores(t) for t in texts[start : start + step]])
            for q in np.flatnonzero(scores.any(axis=0)):
                hit = scores[:, q] > 0
                s = np.concatenate([self.score[q], scores[hit, q]])
                p = np.concatenate([self.pos[q], part[hit]])
                keep = np.lexsort((p, -s))[: self.k]
                self.score[q], self.pos[q] = s[keep], p[keep]

    def frame(self) -> pd.DataFrame:
        counts = [len(p) for p in self.pos]
        return pd.DataFrame(
            {
                "query_id": np.repeat(np.array(self.ids, dtype=object), counts),
                "pos": np.concatenate(self.pos) if self.pos else np.empty(0, dtype=np.int64),
                "score": np.concatenate(self.score) if self.score else np.empty(0, dtype=np.int64),
            }
        )


def _scan(entries: DataFrame, rows: list[tuple[object, list[str]]], k: int, schema: str) -> DataFrame:
    """One narrow pass over the entries for one block of queries."""
    shared = entries.sparkSession.sparkContext.broadcast(rows)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Best(shared.value, k)
        for batch in batches:
            best.add(batch["pos"].to_numpy(dtype=np.int64), batch["hay"].tolist())
        yield best.frame()

    return entries.mapInPandas(scan, schema)


def _blocks(asked: DataFrame, most: int) -> Iterator[list[tuple[object, list[str]]]]:
    """The queries in blocks of about ``most`` bytes; the driver holds one at a time."""
    block, size = [], 0
    for r in asked.toLocalIterator():
        block.append((r["query_id"], list(r["tokens"])))
        size += 64 + sum(len(t.encode()) + 8 for t in r["tokens"])
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(
    queries: DataFrame, entries: DataFrame, k: int = 5, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``query_id, pos, score, rank`` of the k best entries per query.

    ``queries`` has ``query_id`` and ``query``; ``entries`` has a unique integer ``pos``
    (the entry order), ``title``, ``content`` and ``tags``. Ties keep entry order. A query
    without tokens, or one nothing matches, gets the first k entries at score 0.

    Entries are never moved: each block of queries goes to them as a broadcast of a fixed
    size. A task gives at most k rows per query, and none for a query it has no match for.
    """
    asked = queries.select("query_id", tokens(F.col("query")).alias("tokens"))
    texts = entries.select(F.col("pos").cast("bigint").alias("pos"), haystack(entries).alias("hay"))
    schema = _PARTIAL.format(id=asked.schema["query_id"].dataType.simpleString())
    partial = texts.sparkSession.createDataFrame([], schema)
    for block in _blocks(asked, block_bytes):
        partial = partial.unionByName(_scan(texts, block, k, schema))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")
    top = partial.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    first = [r["pos"] for r in texts.select("pos").orderBy("pos").limit(k).collect()]
    missed = asked.select("query_id").join(top.select("query_id").distinct(), "query_id", "left_anti")
    places = F.array(*[F.lit(p).cast("bigint") for p in first]).cast("array<bigint>")
    rest = missed.select("query_id", F.posexplode(places).alias("at", "pos")).select(
        "query_id", "pos", F.lit(0).alias("score"), (F.col("at") + 1).alias("rank")
    )
    return top.unionByName(rest)


def runbooks(topics: DataFrame, entries: DataFrame, k: int = 5) -> DataFrame:
    """Script text per topic.

    ``topics`` has ``query_id`` and ``query`` and optionally ``language``,
    ``script_name``, ``extra_commands`` (array), ``threat`` (struct of ``severity``,
    ``description``, ``commands``) and ``last_rule_xml``.
    """

    def opt(name: str, ddl: str) -> Column:
        return F.col(name) if name in topics.columns else F.lit(None).cast(ddl)

    threat_ddl = "struct<severity:int,description:string,commands:array<string>>"
    topic = topics.select(
        "query_id",
        "query",
        F.coalesce(opt("language", "string"), F.lit("bash")).alias("_asked"),
        F.coalesce(opt("script_name", "string"), F.lit("automation-script")).alias("_script"),
        F.coalesce(opt("extra_commands", "array<string>"), F.array()).cast("array<string>")
        .alias("_extra"),
        opt("threat", threat_ddl).cast(threat_ddl).alias("_threat"),
        opt("last_rule_xml", "string").alias("_rule_xml"),
    )
    title = F.coalesce("title", F.lit("untitled"))
    detail = entries.select(
        "pos",
        title.alias("title"),
        F.coalesce(empty_to_null(first_line(F.coalesce("content", F.lit("")))), title).alias(
            "line"
        ),
        F.coalesce("commands", F.array()).cast("array<string>").alias("commands"),
    )
    # At most k entries per topic, so the list below stays short.
    chosen = (
        search(topics, entries, k)
        .join(detail, "pos")
        .groupBy("query_id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("rank", "title", "line", "commands"))
            ).alias("_entries")
        )
    )

    def tidy(commands: Column) -> Column:
        return F.filter(F.transform(commands, py_strip), lambda c: c != "")

    joined = topic.join(chosen, "query_id", "left").withColumn(
        "_entries",
        F.coalesce(
            "_entries",
            F.array().cast(
                "array<struct<rank:int,title:string,line:string,commands:array<string>>>"
            ),
        ),
    )
    threat = F.col("_threat")
    threat_commands = F.when(F.size(threat["commands"]) > 0, threat["commands"]).otherwise(
        F.array(
            F.concat(
                F.lit('echo "Handling threat: '),
                F.coalesce(threat["description"], F.lit("unknown threat")),
                F.lit('"'),
            )
        )
    )
    known = F.concat(
        F.flatten(F.transform("_entries", lambda e: e["commands"])), F.col("_extra")
    )
    fallback = F.array_compact(
        F.array(
            F.when(
                F.col("_rule_xml").isNotNull(),
                F.concat(
                    F.lit('echo "Referencing previous rule: '),
                    F.substring("_rule_xml", 1, 80),
                    F.lit('"'),
                ),
            )
        )
    )
    with_commands = joined.withColumn(
        "language",
        F.when(threat.isNull(), F.col("_asked"))
        .when(
            F.coalesce(threat["severity"], F.lit(0)) >= K.THREAT_PYTHON_SEVERITY, F.lit("python")
        )
        .otherwise(F.lit("bash")),
    ).withColumn(
        "commands",
        F.when(threat.isNotNull(), tidy(threat_commands))
        .when(F.size("_entries") > 0, tidy(known))
        .otherwise(fallback),
    )
    shebang = None
    for name, line in K.SHEBANGS.items():
        branch = F.lower("language") == name
        shebang = (
            F.when(branch, F.lit(line)) if shebang is None else shebang.when(branch, F.lit(line))
        )
    shebang = shebang.otherwise(F.concat(F.lit("#!/usr/bin/env "), "language"))
    no_lines = F.array().cast("array<string>")
    lines = F.concat(
        F.array(
            shebang,
            F.concat(F.lit("# Script: "), "_script"),
            F.concat(F.lit("# Topic: "), "query"),
            F.lit(""),
        ),
        F.when(
            F.size("_entries") > 0,
            F.concat(
                F.array(F.lit(K.RUNBOOK_ENTRIES)),
                F.transform(
                    "_entries",
                    lambda e: F.concat(F.lit("# - "), e["title"], F.lit(": "), e["line"]),
                ),
                F.array(F.lit("")),
            ),
        ).otherwise(no_lines),
        F.when(
            F.size("commands") > 0, F.concat(F.array(F.lit(K.RUNBOOK_STEPS)), F.col("commands"))
        ).otherwise(F.array(F.lit(K.RUNBOOK_EMPTY))),
    )
    text = F.concat(
        F.regexp_replace(F.array_join(lines, "\n"), f"[{PY_SPACE}]+$", ""), F.lit("\n")
    )
    return with_commands.select(
        "query_id",
        F.col("query").alias("topic"),
        F.col("_script").alias("script_name"),
        "language",
        "commands",
        F.transform("_entries", lambda e: e["title"]).alias("entries"),
        text.alias("script_text"),
    )
