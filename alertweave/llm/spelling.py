"""Spelling variants: words one edit apart, found by pairs of trie nodes, and the form each stands for.

The words are kept in two tries, one of the words and one of the reversed words, whose nodes
are numbered. A word with one position skipped is a pair of integers: the node of what stands
before the position and the reversed node of what stands behind it. Two words that meet in
such a pair differ by one replaced code point; a word whose skipped pair is the pair around a
gap of another word has one code point more. No other pairs of words are one edit apart, so
the neighbours are exact and no strings are compared.

A node that one word alone passes leads to no neighbour, so only shared nodes are paired. A
pair of nodes holds at most one word without a skip and, for each letter, one word with it, so
its group is never larger than the alphabet.

Numbering runs over sorted words in buckets of adjacent words: a word opens the nodes below
the prefix it shares with the word before. A prefix that goes over the border of two buckets
is numbered by the first border it crosses, from the first and last word of each bucket.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staging import ship
from .common import give_back, materialize, texts_of, tidy

ship(__name__)

#: Shortest word, fewest occurrences, and how many times as common a form must be.
SHORTEST, FEWEST, TIMES = 7, 2, 10
#: Words in a bucket of the sorted order; most buckets; words sampled for each border. The
#: sample decides how even the buckets are and nothing else.
BUCKET, MOST_BUCKETS, SAMPLED = 50_000, 2048, 16
#: Different words that a counting task holds before it passes their counts on, and how many
#: it passes on at once.
HELD, PASSED = 200_000, 20_000

_PLAIN = re.compile(rb"[a-z]+")
# U+00C0 to U+00FF are the byte C3 and one more in UTF-8.
_WIDE = re.compile(rb"(?:[a-z]++|(?:\xc3[\x80-\xbf])++)+")

Swaps = Callable[[object, list[bytes]], list[tuple[bytes, str]]]


def letter_runs(text: str) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8, only A-Z lower-cased."""
    low = text.encode("utf-8", "surrogatepass").lower()
    return (_WIDE if b"\xc3" in low else _PLAIN).findall(low)


def count_words(
    df: DataFrame, text: str = "text", swaps: Swaps | None = None,
    shortest: int = SHORTEST, fewest: int = FEWEST,
) -> DataFrame:
    """``word, n``: letter runs of at least ``shortest`` code points that occur ``fewest`` times.

    Null and empty texts have no words; repeated rows count each time. ``swaps`` gets the
    ``doc_id`` of a row and its runs, and names occurrences to count as another word. Tasks
    count before the shuffle, so a word of a third of all rows is a few rows per task.
    """
    columns = [text] if swaps is None else ["doc_id", text]

    def emit(counts: Counter) -> Iterator[pa.RecordBatch]:
        kept = (
            (w, n) for w, n in counts.items()
            if n > 0 and len(w) >= shortest and (w.isascii() or len(w.decode()) >= shortest)
        )
        while part := list(islice(kept, PASSED)):
            yield pa.RecordBatch.from_pydict({
                "word": pa.array([w.decode() for w, _ in part], pa.string()),
                "n": pa.array([n for _, n in part], pa.int64()),
            })

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist() if swaps else [None] * batch.num_rows
            for doc_id, value in zip(ids, texts_of(batch, text), strict=True):
                runs = letter_runs(value)
                counts.update(runs)
                for old, new in swaps(doc_id, runs) if swaps else ():
                    counts[old] -= 1
                    counts[new.encode()] += 1
                if len(counts) > HELD:
                    yield from emit(counts)
                    counts = Counter()
                    give_back()
        yield from emit(counts)

    parts = df.select(*columns).mapInArrow(tidy(run), "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= fewest)


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


class Borders:
    """First and last word of each bucket, and who numbers the prefixes across a border."""

    def __init__(self, ends: Iterable[tuple[int, str, str]]):
        ends = sorted(ends)
        self.at = {bucket: i for i, (bucket, _, _) in enumerate(ends)}
        self.last = [last for _, _, last in ends]
        first = [first for _, first, _ in ends]
        #: Code points that the words on both sides of border i (behind bucket i) share.
        self.shared = [common_prefix(a, b) for a, b in zip(self.last, first[1:], strict=False)]
        #: The number of the node of each depth at border i.
        self.nodes: list[list[int]] = []
        for i, depth in enumerate(self.shared):
            # A prefix of the whole bucket i that also crossed the border before it.
            old = min(self.shared[i - 1], common_prefix(first[i], self.last[i])) if i else -1
            nodes = self.nodes[i - 1][: old + 1] if i else []
            own = [-1 - (i << 32 | d) for d in range(len(nodes), depth + 1)]
            self.nodes.append((nodes + own)[: depth + 1])


def number_nodes(words: Iterable[tuple[int, str]], borders: Borders) -> Iterator[list[int]]:
    """The nodes of each (bucket, word) by depth, down to the last that another word shares.

    Words come sorted by bucket and word; all words of a bucket come together.
    """
    rows = iter(words)
    now, before = next(rows, None), None
    nodes: list[int] = []
    opened = 0
    while now is not None:
        then = next(rows, None)
        bucket, word = now
        i = borders.at[bucket]
        border = borders.shared[i] if i < len(borders.shared) else -1
        if before is None or before[0] != bucket:
            old = borders.shared[i - 1] if i else -1
            nodes, opened = list(borders.nodes[i - 1]) if i else [], 0
        else:
            old = common_prefix(before[1], word)
        new = common_prefix(word, then[1]) if then is not None and then[0] == bucket else border
        del nodes[old + 1 :]
        # Prefixes of the bucket's last word that go on behind the border are numbered there.
        across = common_prefix(word, borders.last[i][:border]) if border > old else -1
        for depth in range(old + 1, max(old, new) + 1):
            if depth <= across or (depth == 0 and border >= 0):
                nodes.append(borders.nodes[i][depth])
            else:
                nodes.append(bucket << 40 | opened)
                opened += 1
        yield list(nodes)
        now, before = then, now


def _cuts(words: DataFrame, word: Column, buckets: int) -> list[str]:
    """Borders between buckets: even steps through the sample of smallest hashes."""
    sample = words.select(word.alias("w")).orderBy(F.xxhash64("w"), "w").limit(buckets * SAMPLED)
    found = sorted(r.w for r in sample.collect())
    return found[SAMPLED::SAMPLED]


def _in_buckets(words: DataFrame, cuts: list[str], back: list[str]) -> DataFrame:
    """Add ``bucket`` of the word and ``back``, that of the reversed word."""

    def run(batches):
        for batch in batches:
            w = batch.column("word").to_pylist()
            yield pa.RecordBatch.from_pydict({
                "word": batch.column("word"), "n": batch.column("n"),
                "bucket": pa.array([bisect_right(cuts, x) for x in w], pa.int32()),
                "back": pa.array([bisect_right(back, x[::-1]) for x in w], pa.int32()),
            })

    return words.select("word", "n").mapInArrow(tidy(run), "word string, n bigint, bucket int, back int")


def _ends(words: DataFrame, bucket: str, word: Column) -> Borders:
    ends = words.groupBy(bucket).agg(F.min(word).alias("first"), F.max(word).alias("last"))
    return Borders(map(tuple, ends.collect()))


def _lists(rows: list[list], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype("i4")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array([x for r in rows for x in r], kind))


def _walk(batches, borders: Borders, size: int = 8192):
    """Chunks of (buckets, words, counts, nodes) in order."""
    counts: list[int] = []
    words: list[tuple[int, str]] = []

    def rows():
        for batch in batches:
            for bucket, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts.append(n)
                words.append((bucket, word))
                yield bucket, word

    nodes: list[list[int]] = []
    for found in number_nodes(rows(), borders):
        nodes.append(found)
        if len(nodes) == size:
            yield words[:size], counts[:size], nodes
            del words[:size], counts[:size]
            nodes = []
    yield words[: len(nodes)], counts[: len(nodes)], nodes


def trie_words(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``word, n``: (``no, word, n``) and (``no, n, size, before, starts, behind``).

    ``no`` follows the order of the words. ``before[i]`` is the node of the first i code points,
    ``behind[j]`` the reversed node of the last j, each as deep as another word shares it, and
    ``starts[i]`` tells whether code point i differs from the one before.
    """
    words = materialize(words, "words")
    buckets = min(MOST_BUCKETS, max(1, words.count() // BUCKET + 1))
    reverse = F.reverse("word")
    cuts, back = _cuts(words, F.col("word"), buckets), _cuts(words, reverse, buckets)
    dealt = materialize(_in_buckets(words, cuts, back), "dealt")
    fore_ends, back_ends = _ends(dealt, "bucket", F.col("word")), _ends(dealt, "back", reverse)

    def fore(batches):
        at = (None, 0)
        for words, counts, nodes in _walk(batches, fore_ends):
            numbers, starts = [], []
            for (bucket, word), shared in zip(words, nodes, strict=True):
                at = (bucket, at[1] + 1 if at[0] == bucket else 0)
                numbers.append(bucket << 32 | at[1])
                starts.append([i == 0 or word[i] != word[i - 1] for i in range(min(len(shared), len(word)))])
            yield pa.RecordBatch.from_pydict({
                "no": pa.array(numbers, pa.int64()),
                "word": pa.array([w for _, w in words], pa.string()),
                "n": pa.array(counts, pa.int64()),
                "size": pa.array([len(w) for _, w in words], pa.int32()),
                "before": _lists(nodes, pa.int64()),
                "starts": _lists(starts, pa.bool_()),
            })

    def backward(batches):
        for words, _, nodes in _walk(batches, back_ends):
            yield pa.RecordBatch.from_pydict({
                "reversed": pa.array([w for _, w in words], pa.string()), "behind": _lists(nodes, pa.int64()),
            })

    one = (
        dealt.select("bucket", "word", "n").repartition(buckets, "bucket")
        .sortWithinPartitions("bucket", "word")
        .mapInArrow(tidy(fore), "no bigint, word string, n bigint, size int, before array<bigint>, starts array<boolean>")
    )
    one = materialize(one, "numbered")
    two = (
        dealt.select("back", reverse.alias("reversed"), "n").repartition(buckets, "back")
        .sortWithinPartitions("back", "reversed")
        .mapInArrow(tidy(backward), "reversed string, behind array<bigint>")
    )
    # A word that shares nothing but the root on one side has no pair of shared nodes but its ends.
    both = one.join(two, F.reverse("word") == F.col("reversed")).drop("reversed", "word")
    return one.select("no", "word", "n"), both


def near_words(nodes: DataFrame) -> DataFrame:
    """``no, n_near, best_n, best``: the number of near words of each word that has any, and of
    these the commonest (ties: the smallest number)."""
    size, before, behind = F.col("size"), F.col("before"), F.col("behind")
    fore, back = F.size(before) - 1, F.size(behind) - 1

    def pair(i: Column, j: Column, gap: bool, first: Column) -> Column:
        return F.struct(
            F.get(before, i).alias("p"), F.get(behind, j).alias("s"), F.lit(gap).alias("gap"), first.alias("first")
        )

    skips = F.when(F.least(fore, size - 1) >= F.greatest(F.lit(0), size - 1 - back), F.transform(
        F.sequence(F.greatest(F.lit(0), size - 1 - back), F.least(fore, size - 1)),
        lambda i: pair(i, size - 1 - i, False, F.get("starts", i)),
    ))
    gaps = F.when(F.least(fore, size) >= F.greatest(F.lit(0), size - back), F.transform(
        F.sequence(F.greatest(F.lit(0), size - back), F.least(fore, size)),
        lambda i: pair(i, size - i, True, F.lit(True)),
    ))
    none = F.array().cast("array<struct<p:bigint,s:bigint,gap:boolean,first:boolean>>")
    every = F.concat(F.coalesce(skips, none), F.coalesce(gaps, none))
    # An outer generator: an inner one would compute the arrays once more to filter by size.
    entered = nodes.select("no", "n", F.inline_outer(every)).filter(F.col("p").isNotNull())
    members = entered.groupBy("p", "s").agg(F.collect_list(F.struct("no", "n", "gap", "first")).alias("m"))

    def others(me: Column) -> Column:
        # Of a run of equal letters only the first is skipped for a word with a letter less.
        near = lambda x: (x["no"] != me["no"]) & (
            F.when(me["gap"], x["first"] & ~x["gap"]).otherwise(~x["gap"] | me["first"])
        )
        return F.transform(F.filter("m", near), lambda x: F.struct((-x["n"]).alias("less"), x["no"].alias("no")))

    found = members.filter(F.size("m") > 1).select(F.inline_outer(F.transform("m", lambda me: F.struct(
        me["no"].alias("no"), others(me).alias("near")
    )))).filter(F.size("near") > 0)
    best = found.select("no", F.size("near").alias("n_near"), F.array_min("near").alias("best"))
    best = best.groupBy("no").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return best.select("no", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.no").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``no, root``: the end of the path of each ``no`` of ``forms`` (``no, form``).

    Every round follows twice the distance, so paths of length k take log k rounds. A form is
    many times as common as its word, so paths are short and have no cycles.
    """
    now = materialize(forms.select("no", F.col("form").alias("root")), "forms")
    while True:
        ahead = now.select(F.col("no").alias("at"), F.col("root").alias("further"))
        step = now.join(ahead, F.col("root") == F.col("at"), "left")
        moved = materialize(step.select("no", F.coalesce("further", "root").alias("root"),
                                        F.col("at").isNotNull().alias("moved")), "roots")
        now = moved.select("no", "root")
        if moved.filter("moved").isEmpty():
            return now


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each of ``words`` (``word, n``, words distinct).

    Near words differ by one inserted, deleted or replaced code point. The form is the near word
    of largest ``n`` (ties: the smallest in code-point order) if that is at least ``times`` the
    word's; else it is null. The root follows forms to the last. No words give no rows.
    """
    named, nodes = trie_words(words)
    near = materialize(near_words(nodes), "near")
    counted = materialize(named.join(near, "no", "left"), "counted")
    forms = counted.filter(F.col("best_n") >= times * F.col("n")).select(
        "no", F.col("best").alias("form"), F.col("best_n").alias("form_n")
    )
    forms = materialize(forms, "forms")
    name = lambda no, word: named.select(F.col("no").alias(no), F.col("word").alias(word))
    ends = forms.join(roots(forms), "no").join(name("form", "form_word"), "form").join(name("root", "root_word"), "root")
    ends = materialize(ends.select("no", "form_word", "root_word", "form_n"), "ends")
    return counted.join(ends, "no", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"),
        "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n",
    )


def damaged(doc_id: object, runs: list[bytes]) -> list[tuple[bytes, str]]:
    """The occurrences that the query misspells: those whose crc32 of ``doc_id:run`` is a
    multiple of 31 lose code point ``crc32 % length``. A null id counts as an empty one."""
    start, out = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), []
    for run in runs:
        h = zlib.crc32(run, start)
        if h % 31 == 0:
            word = run.decode()
            at = h % len(word)
            out.append((run, word[:at] + word[at + 1 :]))
    return out


def report(documents: DataFrame) -> DataFrame:
    return variants(count_words(documents, swaps=damaged))
