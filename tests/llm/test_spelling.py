import random
import zlib
from collections import Counter

import pytest

from alertweave.llm import spelling


def edits(a, b):
    """Whether one inserted, deleted or replaced code point makes ``b`` of ``a``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def plain(counts):
    """All pairs of words, compared one by one."""
    near = {w: [x for x in counts if edits(w, x)] for w in counts}
    best = {w: min(near[w], key=lambda x: (-counts[x], x), default=None) for w in counts}
    form = {w: b if b is not None and counts[b] >= 10 * counts[w] else None for w, b in best.items()}
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        f = form[w]
        out.add((w, f, root, counts[w], len(near[w]), None if f is None else counts[f]))
    return out


def words_of(rows):
    counts = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
            run = ""
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def rows_of(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def random_words(seed, number, letters="abé", least=7, most=9):
    pick = random.Random(seed)
    return {"".join(pick.choices(letters, k=pick.randint(least, most))) for _ in range(number)}


@pytest.mark.parametrize("bucket", [spelling.BUCKET, 20])
def test_near_words_equal_a_comparison_of_all_pairs(corpus, monkeypatch, bucket):
    monkeypatch.setattr(spelling, "BUCKET", bucket)
    pick = random.Random(bucket)
    counts = {w: pick.choice([2, 3, 30, 31, 400, 5000]) for w in random_words(bucket, 250)}
    words = corpus.createDataFrame(list(counts.items()), "word string, n bigint")
    assert rows_of(spelling.variants(words)) == plain(counts)


def test_prefixes_across_many_borders(corpus, monkeypatch):
    monkeypatch.setattr(spelling, "BUCKET", 1)
    monkeypatch.setattr(spelling, "SAMPLED", 1)
    counts = {"a" * k: 10 ** (k % 5) + 1 for k in range(7, 22)} | {"a" * 9 + "b" * k: 5 for k in range(1, 6)}
    words = corpus.createDataFrame(list(counts.items()), "word string, n bigint")
    assert rows_of(spelling.variants(words)) == plain(counts)


def test_nodes_are_numbered_by_their_strings():
    """Equal prefixes get equal numbers, different ones different numbers, in all bucketings."""
    words = sorted(random_words(1, 120, "ab", 1, 8))
    for step in (1, 2, 3, 10, 500):
        dealt = [(i // step * 2, w) for i, w in enumerate(words)]
        ends = {}
        for bucket, w in dealt:
            ends.setdefault(bucket, [w, w])[1] = w
        borders = spelling.Borders((b, f, t) for b, (f, t) in ends.items())
        # Each bucket may be walked by another task.
        number = {}
        for bucket in ends:
            mine = [x for x in dealt if x[0] == bucket]
            for (_, w), nodes in zip(mine, spelling.number_nodes(mine, borders), strict=True):
                shared = max((spelling.common_prefix(w, x) for x in words if x != w), default=-1)
                assert len(nodes) == shared + 1
                for d, node in enumerate(nodes):
                    assert number.setdefault(w[:d], node) == node
        assert len(set(number.values())) == len(number)


def test_report_equals_a_plain_count(docs):
    pick = random.Random(5)
    base = sorted(random_words(3, 60, "abcdeÀß×÷", 7, 10))
    rows = [(i, " ".join(pick.choices(base[:20] * 20 + base, k=200)).title()) for i in range(60)]
    rows += [(5, None), (6, ""), (7, "1234 - Āſ ß"), (None, "abcdefgh " * 40), (61, "x" * 30000 + " " + "x" * 29999),
             (62, "x" * 30000), (63, "Y" + "x" * 29999), (64, "Y" + "x" * 29999), (65, "x" * 29999)]
    rows += rows[:3]
    assert rows_of(spelling.report(docs(rows, clash=["word", "n", "no", "form"]))) == plain(words_of(rows))


def test_counts_pass_on_before_a_task_is_full(docs, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 2)
    rows = [(i, "hundred thousands hundreds HUNDRED thousand") for i in range(300)]
    assert rows_of(spelling.report(docs(rows))) == plain(words_of(rows))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "alphabet")], [(1, "alphabet alphabet")]])
def test_few_or_no_words(docs, rows):
    assert rows_of(spelling.report(docs(rows))) == plain(words_of(rows))


def test_a_path_of_forms_ends_at_its_last(corpus):
    counts = {"aaaaaaa": 10**6, "aaaaaab": 10**5, "aaaaabb": 10**4, "aaaabbb": 10**3, "aaabbbb": 100, "aabbbbb": 10}
    words = corpus.createDataFrame(list(counts.items()), "word string, n bigint")
    found = rows_of(spelling.variants(words))
    assert found == plain(counts) and {r[2] for r in found} == {"aaaaaaa"}


def test_a_counting_task_passes_its_counts_on_in_parts(corpus, monkeypatch):
    words = sorted(random_words(5, 2000))
    rows = [(i, " ".join(words[i * 100 : i * 100 + 100] * 2)) for i in range(20)]
    docs = corpus.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    monkeypatch.setattr(spelling, "PASSED", 64)
    sizes = []

    def look(batch_iter):
        import pyarrow as pa

        for batch in batch_iter:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    plain = type(docs).mapInArrow

    def spied(df, run, schema, *args):
        parts = plain(df, lambda batches: look(run(batches)), "n bigint")
        sizes.extend(r.n for r in parts.collect())
        return plain(df, run, schema, *args)

    monkeypatch.setattr(type(docs), "mapInArrow", spied)
    got = {(r.word, r.n) for r in spelling.count_words(docs).collect()}
    assert got == {(w, 2) for w in words if len(w) >= 7}
    assert max(sizes) <= 64 and sum(sizes) == len(got)
