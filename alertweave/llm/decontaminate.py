"""Benchmark decontamination with a distributed positional inverted index.

The index holds one posting (term, doc, pos) for every corpus word that the test set uses,
and for each document one posting of the empty term behind its last word. A phrase is found
from its rarest term: each posting of that term, less the term's offset, is a candidate start.
The lists of the other terms, adjusted in the same way, must meet it there.

Everything is DataFrame code; texts are read once, to build the index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WINDOW = 10
#: Rows up to which a test-side table is broadcast; larger ones are joined by shuffles.
SHARED_ROWS = 200_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# lower() changes these too, so texts that have them take the slower way.
_OTHER_CASE = r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^A-Z]]"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(text.rlike(_OTHER_CASE), F.translate(text, UPPER, UPPER.lower())).otherwise(
        F.lower(text)
    )


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    parts = F.array_remove(F.split(lower_ascii(text), _SPLIT), "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def shared(df: DataFrame, rows: int = SHARED_ROWS) -> DataFrame:
    """A broadcast hint if ``df`` is counted and found small; else the plain table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def items(benchmark: DataFrame) -> DataFrame:
    """(item_id, words, size) of the items that have words."""
    w = benchmark.select("item_id", words(F.col("text")).alias("words"))
    return w.withColumn("size", F.size("words")).filter("size > 0")


def build_index(documents: DataFrame, vocabulary: DataFrame, name: Column | None = None) -> DataFrame:
    """Postings (term, doc, pos, name) of the words in ``vocabulary`` (one column ``term``).

    ``doc`` numbers the rows of ``documents``, so rows with equal or null ids stay apart. The
    empty term stands at position n of a document of n words, also for n = 0; there alone is
    ``name``, which tells the document (its ``doc_id`` if not given). The index is written once, and the
    numbers with it.
    """
    terms = materialize(
        vocabulary.select("term").unionByName(
            vocabulary.sparkSession.range(1).select(F.lit("").alias("term"))
        ).distinct(),
        "vocabulary",
    )
    rows = documents.select(
        F.monotonically_increasing_id().alias("doc"),
        (F.col("doc_id") if name is None else name).alias("name"), "text",
    )
    every = rows.select(
        "doc", "name", F.posexplode(F.array_append(words(F.col("text")), F.lit(""))).alias("pos", "term")
    )
    own = F.when(F.col("term") == "", F.col("name")).alias("name")
    return materialize(every.join(shared(terms), "term", "left_semi").select("term", "doc", "pos", own), "index")


def names_of(index: DataFrame) -> DataFrame:
    """(doc, name, n_words) of every row of the documents."""
    return index.filter("term = ''").select("doc", "name", F.col("pos").alias("n_words"))


def frequencies(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("n"))


def distinct_texts(tests: DataFrame) -> DataFrame:
    """(item, words, size): each distinct text of ``items()`` under a number of its own.

    Written once, so the numbers stay; items of one text share it, whatever their ids.
    """
    texts = tests.select("words", "size").distinct()
    return materialize(texts.withColumn("item", F.monotonically_increasing_id()), "item-texts")


def anchors(tests: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(term, item, at, term2, at2): the two rarest terms of every window of every text.

    Of equally rare terms the first counts. A term that the corpus lacks is rarest of all,
    and its empty list ends the search for that window. Windows of one word have no second.
    """
    each = tests.select("item", "size", F.posexplode("words").alias("at", "term"))
    rated = each.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    starts = F.sequence(
        F.greatest(F.lit(0), F.col("at") - window + 1),
        F.greatest(F.lit(0), F.least(F.col("at"), F.col("size") - window)),
    )
    by_window = rated.select("item", "at", "term", "n", F.explode(starts).alias("start"))
    # A window has at most ``window`` words, so this list is short.
    ranked = by_window.groupBy("item", "start").agg(
        F.array_sort(F.collect_list(F.struct("n", "at", "term"))).alias("r")
    )
    one, two = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    return ranked.select(
        one["term"].alias("term"), "item", one["at"].alias("at"),
        two["term"].alias("term2"), two["at"].alias("at2"),
    ).distinct()


def phrases(index: DataFrame, tests: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, item, pos): document words inside an occurrence of a window of a text.

    ``tests`` are ``distinct_texts()``. A word is given once for each text.
    """
    counts = materialize(frequencies(index), "frequencies")
    found = materialize(anchors(tests, counts, window), "anchors")
    # Where an item would begin in a document, by the rarest term of one of its windows ...
    begin = F.col("pos") - F.col("at")
    first = index.join(shared(found), "term").select(
        "doc", "item", begin.alias("begin"), "term2", (begin + F.col("at2")).alias("pos2")
    )
    first = materialize(first.distinct(), "first-lists")
    # ... and by the second rarest, whose list must have a posting at the place it gives.
    terms = found.select(F.col("term2").alias("term")).filter("term is not null").distinct()
    second = index.join(shared(materialize(terms, "second-terms")), "term", "left_semi")
    met = first.alias("a").join(
        second.alias("b"),
        (F.col("a.doc") == F.col("b.doc")) & (F.col("pos2") == F.col("pos"))
        & (F.col("term2") == F.col("term")),
        "left_semi",
    )
    line = ["doc", "item", "begin"]
    lines = met.select(*line).unionByName(first.filter("term2 is null").select(*line)).distinct()
    lines = materialize(lines, "candidates")
    # The lists of all terms of the item, adjusted by their offsets, against each candidate.
    wanted = lines.join(shared(tests), "item").select(
        *line, "size", F.posexplode("words").alias("at", "term")
    ).withColumn("at_pos", F.col("begin") + F.col("at"))
    ids = materialize(lines.select("doc").distinct(), "candidate-ids")
    postings = index.join(shared(ids), "doc", "left_semi")
    met = wanted.alias("w").join(
        postings.alias("p"),
        (F.col("w.doc") == F.col("p.doc")) & (F.col("at_pos") == F.col("pos"))
        & (F.col("w.term") == F.col("p.term")),
        "left_semi",
    )
    # Runs of neighbouring matches on one candidate line; a run as long as a window is a hit.
    run = F.col("at") - F.row_number().over(Window.partitionBy(*line).orderBy("at"))
    runs = met.withColumn("run", run).withColumn(
        "length", F.count("*").over(Window.partitionBy(*line, "run"))
    )
    hits = runs.filter(F.col("length") >= F.least(F.col("size"), F.lit(window)))
    return hits.select("doc", "item", F.col("at_pos").alias("pos")).distinct()


def near(index: DataFrame, queries: DataFrame, within: int) -> DataFrame:
    """(query_id, doc_id, first, last): spans of at most ``within`` words that hold all terms.

    ``queries`` has ``query_id`` and an array ``terms``. Only documents that hold the rarest
    term of a query are searched for its other terms. One row per end of a span; ``first`` is
    the earliest word of the query in the ``within`` words up to ``last``.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    rated = terms.join(frequencies(index), "term", "left")
    whole = Window.partitionBy("query_id")
    rated = rated.withColumn("n_terms", F.count("*").over(whole)).withColumn(
        "rank", F.row_number().over(whole.orderBy(F.coalesce("n", F.lit(0)), "term"))
    )
    rated = materialize(rated, "query-terms")
    rarest = index.join(shared(rated.filter("rank = 1")), "term").select("query_id", "doc").distinct()
    found = index.join(shared(rated), "term").join(rarest, ["query_id", "doc"], "left_semi")
    span = Window.partitionBy("query_id", "doc").orderBy("pos").rangeBetween(1 - within, 0)
    spans = (
        found.withColumn("seen", F.size(F.collect_set("term").over(span)))
        .withColumn("first", F.min("pos").over(span))
        .filter("seen = n_terms")
        .select("query_id", "doc", "first", F.col("pos").alias("last"))
    )
    return spans.join(names_of(index), "doc").select("query_id", F.col("name").alias("doc_id"), "first", "last")


def vocabulary(tests: DataFrame) -> DataFrame:
    return tests.select(F.explode("words").alias("term")).distinct()


def text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The distinct ``digest`` of the texts in which a window occurs.

    Whether one does depends on the text alone, so rows with equal or null ids need no key.
    """
    texts = distinct_texts(items(benchmark))
    index = build_index(documents, vocabulary(texts), text_digest(F.col("text")))
    found = materialize(phrases(index, texts, window).select("doc").distinct(), "contaminated")
    return names_of(index).join(found, "doc", "left_semi").select(F.col("name").alias("digest")).distinct()


def report(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Words, hit words and items of every row of ``documents``.

    Rows with equal or null ids are documents of their own. Null and empty texts have no words; items
    without words never occur. An item counts once, however many rows and texts it has; a null
    ``item_id`` counts as one item and has no part in the digest. Other columns are not read.
    """
    tests = items(benchmark)
    texts = distinct_texts(tests)
    index = build_index(documents, vocabulary(texts))
    hits = materialize(phrases(index, texts, window), "hits")
    ids = materialize(
        tests.join(texts, "words").select("item", F.col("item_id").cast("string").alias("item_id")).distinct(),
        "item-ids",
    )
    held = hits.select("doc", "item").distinct().join(shared(ids), "item").groupBy("doc").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"),
        F.max(F.col("item_id").isNull().cast("int")).alias("n_null"),
    )
    by_doc = hits.groupBy("doc").agg(F.count_distinct("pos").alias("n_hit")).join(held, "doc")
    none = F.array().cast("array<string>")
    rows = names_of(index).join(by_doc, "doc", "left").withColumn("item_ids", F.coalesce("item_ids", none))
    return rows.select(
        F.col("name").alias("doc_id"),
        F.col("n_words").cast("bigint").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        (F.size("item_ids") + F.coalesce("n_null", F.lit(0))).cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH doc_words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), item_words AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k,
    array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i
        FROM item_words WHERE len(w) > 0)
), grams AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
        FROM doc_words, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
), found AS (
  SELECT doc_id, item_id, i, g.k FROM grams g JOIN windows w ON g.gram = w.gram AND g.k = w.k
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM found) GROUP BY doc_id
), held AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit USING (doc_id) LEFT JOIN held USING (doc_id)
"""
