"""Secrets in every version of every file, by a ledger of the contents that were scanned.

A content (blob) is named by its SHA-256. The ledger is a folder of two Parquet tables: which
rule versions have been run over which blob, and what they found. A run scans the blobs and
rules that the ledger does not have, each distinct content once, appends both tables, and joins
the findings to all paths that hold the blob. A rule's version is the digest of its
definition, so a changed rule is run again over all contents and the others are not.

Everything is DataFrame code. Offsets come from the pieces between the matches: a match begins
behind the code points of all pieces and matches before it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import folder_exists, materialize

#: Blobs to scan up to which they go to the texts as a broadcast; else all meet in a shuffle.
SHARED_ROWS = 200_000


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has ``least`` code points; shorter ones are
    dropped and not tried again from another place. No match may be empty."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0

    @property
    def version(self) -> str:
        definition = "\0".join((self.kind, self.pattern, str(self.least), str(self.group)))
        return hashlib.sha256(definition.encode()).hexdigest()[:32]


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
# A run of letters that is long enough is found as a whole, so the least length of ``access`` and
# ``hex`` can stand in their patterns; ``assign`` may take the start of another assignment away.
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", "AKIA[A-Z0-9]{12,}"),
    Rule("hex", "[0-9a-f]{32,}"),
)
ADDED = (
    Rule("private_key", "-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    Rule("hosting_token", "gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + ADDED

SCANS = "blob binary, rules array<string>"
FINDINGS = "blob binary, rule string, start int, `end` int"


def _content(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    if not folder_exists(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder)


def _matches(rule: Rule) -> Column:
    """Lengths of each match of the rule: of the piece before it, itself and its group."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    return F.transform(
        F.arrays_zip(
            hits.alias("hit"),
            F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(hits)).alias("piece"),
            (F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits).alias("part"),
        ),
        lambda m: F.struct(
            F.length(m["piece"]).alias("piece"), F.length(m["hit"]).alias("hit"), F.length(m["part"]).alias("part")
        ),
    )


def find(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings (blob, rule, start, end) of (``blob``, ``text``, ``todo``: the rules to run).

    A text takes one pass by rule, and more only where the rule matches. The places of one
    rule's matches in one text are a running sum over slim rows.
    """
    runs = F.array(*[
        F.when(
            F.array_contains("todo", r.version) & F.col("text").rlike(r.pattern),
            F.struct(F.lit(r.version).alias("rule"), F.lit(r.least).alias("least"), _matches(r).alias("m")),
        )
        for r in rules
    ])
    # Outer generators do not make Spark compute the arrays a second time to filter them.
    hits = texts.select("blob", F.inline_outer(F.array_compact(runs))).filter("rule is not null")
    rows = hits.select("blob", "rule", "least", F.posexplode("m").alias("at", "m"))
    behind = Window.partitionBy("blob", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("m.piece") + F.col("m.hit")).over(behind))
    return placed.filter("m.part >= least").select(
        "blob", "rule", (F.col("end") - F.col("m.hit")).cast("int").alias("start"), F.col("end").cast("int").alias("end")
    )


def scan_versions(
    versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text"
) -> DataFrame:
    """Every row of ``versions`` without its ``text``, with ``blob`` and ``findings``.

    ``ledger`` is a folder, made if it is missing. Null texts count as empty. ``findings`` is an
    array of (kind, rule, start, end) by start, then the order of ``rules``; it is empty, never
    null, where nothing was found. Rows may repeat, have null columns or any column names; input
    columns named ``blob`` and ``findings`` are replaced. An empty table leaves the ledger as it is.
    """
    spark = versions.sparkSession
    kept = [c for c in versions.columns if c not in (text, "blob", "findings")]
    content = _content(text)
    # The paths stand in one struct, so their names meet no others.
    path = F.struct(F.lit(0).alias("0"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    rows = materialize(versions.select(path.alias("path"), blob_of(content).alias("blob")), "versions")
    names = [r.version for r in rules]
    done = _read(spark, f"{ledger}/scans", SCANS).groupBy("blob").agg(
        F.flatten(F.collect_set("rules")).alias("done")
    )
    known = F.coalesce("done", F.array().cast("array<string>"))
    todo = rows.select("blob").distinct().join(done, "blob", "left").select(
        "blob", F.array_except(F.array(*map(F.lit, names)), known).alias("todo")
    )
    todo = materialize(todo.filter(F.size("todo") > 0), "unseen")
    if not todo.isEmpty():
        texts = versions.select(content.alias("text")).withColumn("blob", blob_of(F.col("text")))
        few = todo.limit(SHARED_ROWS + 1).count() <= SHARED_ROWS
        if few:
            texts = texts.join(F.broadcast(todo.select("blob")), "blob", "left_semi")
        # Copies meet on the map side first, so a content of a third of all rows moves once per task.
        once = texts.groupBy("blob").agg(F.first("text").alias("text"))
        append = lambda df, name: df.write.mode("append").option("compression", "zstd").parquet(f"{ledger}/{name}")
        append(find(once.join(todo, "blob"), rules), "findings")
        # Written last: a run that ends in between is repeated, and readers drop its doubles.
        append(todo.select("blob", F.col("todo").alias("rules")), "scans")
    kinds = F.create_map(*[F.lit(x) for r in rules for x in (r.version, r.kind)])
    order = F.array_position(F.array(*map(F.lit, names)), F.col("rule"))
    found = _read(spark, f"{ledger}/findings", FINDINGS).filter(F.col("rule").isin(*names)).distinct()
    found = found.groupBy("blob").agg(
        F.array_sort(F.collect_list(F.struct("start", order.alias("order"), "end", "rule"))).alias("found")
    )
    found = materialize(found.select("blob", F.transform("found", lambda f: F.struct(
        kinds[f["rule"]].alias("kind"), f["rule"].alias("rule"), f["start"].alias("start"), f["end"].alias("end")
    )).alias("findings")), "found")
    empty = F.array().cast("array<struct<kind:string,rule:string,start:int,end:int>>")
    return rows.join(found, "blob", "left").select(
        *[F.col("path")[f"c{i}"].alias(c) for i, c in enumerate(kept)],
        "blob", F.coalesce("findings", empty).alias("findings"),
    )


def joined(found: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(found, one), ",")


def report(documents: DataFrame, ledger: str) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans of every row."""
    rows = scan_versions(documents.select("doc_id", "text"), ledger)
    found = F.col("findings")
    base = F.filter(found, lambda f: f["kind"].isin(*[r.kind for r in BASE]))
    count = lambda k: F.size(F.filter(found, lambda f: f["kind"] == k)).cast("bigint")
    return rows.select(
        "doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(found).alias("spans"),
    )


def _oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    # The base kinds as they are defined: any match, then the short ones dropped.
    plain = {"access": Rule("access", "AKIA[A-Z0-9]+", 16), "hex": Rule("hex", "[0-9a-f]+", 32)}
    hits = " UNION ALL ".join(
        f"SELECT k, {quoted(r.kind)} AS kind, {i} AS ord, {r.least} AS least, {str(i < len(BASE)).lower()} AS base,"
        f" string_split_regex(t, {quoted(r.pattern)}) AS pieces,"
        f" regexp_extract_all(t, {quoted(r.pattern)}, 0) AS hits,"
        f" regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS parts FROM docs"
        for i, r in enumerate(plain.get(r.kind, r) for r in RULES)
    )
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents
), hits AS ({hits}), matches AS (
  SELECT k, kind, ord, least, base, unnest(hits) AS hit, unnest(parts) AS part,
    unnest(pieces[:len(hits)]) AS piece, generate_subscripts(hits, 1) AS nth
  FROM hits WHERE len(hits) > 0
), placed AS (
  SELECT *, sum(length(piece) + length(hit)) OVER (PARTITION BY k, ord ORDER BY nth) AS stop FROM matches
), spans AS (
  SELECT k, kind, ord, base, stop - length(hit) AS start,
    kind || ':' || CAST(stop - length(hit) AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span
  FROM placed WHERE length(part) >= least
)
SELECT d.doc_id,
  {", ".join(f"count(*) FILTER (kind = {quoted(r.kind)}) AS n_{r.kind}" for r in BASE)},
  sha256(coalesce(string_agg(span, ',' ORDER BY start, ord) FILTER (base), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY start, ord), '') AS spans
FROM docs d LEFT JOIN spans s ON d.k = s.k GROUP BY d.k, d.doc_id
"""


ORACLE = _oracle()
