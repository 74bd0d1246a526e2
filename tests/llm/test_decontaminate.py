import hashlib
import random
import re

import pytest

from alertweave.llm import decontaminate as dec

ITEM = "item_id bigint, text string"


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=10):
    out = {}
    for i, t in docs:
        w = words(t)
        hit, held = set(), set()
        for item, text in items:
            q = words(text)
            k = min(window, len(q))
            grams = {tuple(q[a : a + k]) for a in range(len(q) - k + 1)} if q else set()
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in grams:
                    hit |= set(range(a, a + k))
                    held.add(str(item))
        digest = hashlib.sha256(",".join(sorted(held)).encode()).hexdigest()
        out[i] = (len(w), len(hit), len(held), digest, bool(hit))
    return out


def result(docs_df, items_df):
    return {
        r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
        for r in dec.report(docs_df, items_df).collect()
    }


def test_random_texts(docs, corpus):
    random.seed(8)
    vocabulary = [f"w{i}" for i in range(12)] + ["Éa", "ǅx", "Ⅷ", "ÑO", "İi", "Σσς"]
    some = lambda n: [random.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(random.choice([1, 2, 3, 9, 10, 11, 25])))) for i in range(25)]
    items += [(100, None), (101, "..."), (102, items[3][1]), (103, "never seen words at all here")]
    rows = []
    for i in range(60):
        w = some(random.randint(0, 30))
        q = words(random.choice(items)[1])
        at = random.randint(0, len(q))
        w[len(w) // 2 : len(w) // 2] = q[at : at + random.choice([9, 10, 30])]
        rows.append((i, random.choice([" ", ", ", "\n"]).join(w).upper() if i % 7 == 0 else " ".join(w)))
    rows += [(70, None), (71, ""), (72, " ;; "), (73, "filler " * 20_000 + (items[5][1] or ""))]
    got = result(docs(rows, clash=("pos", "term", "item_id")), corpus.createDataFrame(items, ITEM))
    assert got == brute(rows, items)


def test_repeated_ids_and_null_ids(docs, corpus):
    """Each row is a document of its own; no hit goes over from one to another."""
    items = corpus.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta")], ITEM)
    rows = [(1, "alpha beta gamma x"), (1, "alpha beta gamma x"), (None, "alpha beta gamma"), (None, "alpha z z z"),
            (3, "alpha z"), (3, "q beta"), (3, None)]
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items) for r in dec.report(docs(rows), items).collect())
    assert got == [("1", 4, 3, 2), ("1", 4, 3, 2), ("3", 0, 0, 0), ("3", 2, 0, 0), ("3", 2, 0, 0), ("None", 3, 3, 2), ("None", 4, 0, 0)]


@pytest.mark.parametrize("rows,items", [([], [(1, "a b")]), ([(1, "a b")], []), ([], [])])
def test_empty_tables(docs, corpus, rows, items):
    got = result(docs(rows), corpus.createDataFrame(items, ITEM))
    assert got == brute(rows, items)


def test_shuffled_joins_give_the_same(docs, corpus, monkeypatch):
    monkeypatch.setattr(dec, "shared", lambda df, rows=0: df)
    items = [(1, "one two three four five six seven eight nine ten eleven")]
    rows = [(1, "x one two three four five six seven eight nine ten y"), (2, "one two")]
    assert result(docs(rows), corpus.createDataFrame(items, ITEM)) == brute(rows, items)


def test_proximity(docs, corpus):
    rows = [(1, "red x x blue"), (2, "red x x x x blue"), (3, "blue red"), (4, "red red"), (5, None)]
    queries = corpus.createDataFrame([(7, ["red", "blue"]), (8, ["absent", "red"])], "query_id bigint, terms array<string>")
    index = dec.build_index(docs(rows), queries.selectExpr("explode(terms) as term"))
    got = sorted((r.query_id, r.doc_id, r.first, r.last) for r in dec.near(index, queries, 4).collect())
    assert got == [(7, 1, 0, 3), (7, 3, 0, 1)]


def test_no_python_in_the_plan(docs, corpus):
    df = dec.report(docs([(1, "a b")]), corpus.createDataFrame([(1, "a")], ITEM))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Cartesian" not in text


def test_repeated_varied_and_null_item_ids(docs, corpus):
    text = "one two three four five six seven eight nine ten eleven"
    items = [(1, text), (1, text), (2, text), (3, "red green blue"), (3, "red green blue"), (3, "red black blue"),
             (None, "sun moon star"), (None, "sun moon star"), (None, "only here"), (4, "sun moon star"), (5, "a b c d")]
    rows = [(1, "x " + text + " y"), (2, "red green blue z"), (3, "red black blue z"), (4, "red green blue red black blue"),
            (5, "sun moon star"), (6, "only here"), (7, "red moon star"), (8, "a b c d and a b c d"), (None, "only here")]
    want = brute(rows, items)
    # A null item counts, and is no part of the digest.
    null = lambda t: hashlib.sha256(t).hexdigest()
    want[5], want[6] = (3, 3, 2, null(b"4"), True), (2, 2, 1, null(b""), True)
    want[None] = want[6]
    assert result(docs(rows), corpus.createDataFrame(items, ITEM)) == want
    hit = dec.contaminated(docs(rows), corpus.createDataFrame(items, ITEM))
    texts = {hashlib.sha256(t.encode()).hexdigest() for i, t in rows if i != 7}
    assert {r.digest for r in hit.collect()} == texts
