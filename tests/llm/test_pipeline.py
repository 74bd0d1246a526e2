"""Registered corpus queries against their SQL, and the pipeline against plain Python."""

import hashlib

import compare
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from alertweave.llm import bpe, common, line_dedup, queries

SF = "/root/testdata/sf0.001"
BATCH = [
    (1, "A line that is in many documents\n" + "alpha beta gamma delta " * 20),
    (2, "A line that is in many documents\nshort"),
    (3, None), (4, ""), (5, " ".join(f"w{i}" for i in range(300))), (6, " ".join(f"w{i}" for i in range(300)) + " end"),
    (7, "the leaked test item one two three four five six seven eight nine ten in a text"),
]


def test_all_queries_are_registered():
    names = set(entry.queries())
    assert {f"op{i}_" for i in range(1, 14)} == {n.split("_")[0] + "_" for n in names if n.startswith("op") and n[2].isdigit()}
    assert "pipeline" in names and set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_oracle(spark, name):
    want = compare.oracle_rows(compare.connect(SF), queries.ORACLE[name])
    got = compare.spark_rows(queries.QUERIES[name](spark, SF))
    assert compare.differences(got, want) == []


def stages():
    return dict(corpus_pipeline.STAGES)


def test_order_of_the_stages():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "byte-level BPE"]


def test_line_dedup_stage_keeps_documents_and_lengths(corpus, docs):
    df = docs(BATCH)
    got = {r.doc_id: r for r in stages()["line dedup"](corpus, df, SF).collect()}
    assert len(got) == len(BATCH) and got[2].text == "short" and got[2].n_chars == 5 and got[1].text == BATCH[0][1]
    assert got[3].text == "" and got[3].n_chars == 0


def test_near_dedup_stage_keeps_one_of_each_group(corpus, docs):
    df = docs(BATCH)
    got = stages()["SimHash near-dedup"](corpus, df, SF)
    assert got.columns == df.columns and {r.doc_id for r in got.collect()} == {1, 2, 3, 5, 7}


def test_decontamination_stage_drops_hit_documents(corpus, docs, tmp_path):
    items = [(1, "one two three four five six seven eight nine ten"), (2, "short never")]
    corpus.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = docs(BATCH)
    got = stages()["benchmark decontamination"](corpus, df, str(tmp_path))
    assert got.columns == df.columns and {r.doc_id for r in got.collect()} == {1, 2, 3, 4, 5, 6}


@pytest.mark.parametrize("name", ["line dedup", "SimHash near-dedup", "benchmark decontamination", "byte-level BPE", "quality classifier"])
def test_stages_of_an_empty_table(corpus, docs, name):
    df = docs([])
    out = stages()[name](corpus, df, SF)
    assert out.count() == 0
    if name != "byte-level BPE":
        assert out.columns == df.columns


def _shingle_set(text):
    w = text.encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_run_equals_a_plain_pipeline(spark):
    """All stages after the classifier, in plain Python on what the classifier kept."""
    from test_decontaminate import brute as leaks

    spark_ = common.prepare(spark)
    docs = common.table(spark_, SF, "documents")
    kept = stages()["quality classifier"](spark_, docs, SF)
    rows = sorted((r.doc_id, r.text or "") for r in kept.collect())
    quality = {r.doc_id: r.quality for r in common.table(spark_, SF, "labels").collect()}
    assert {i for i, _ in rows} == {r.doc_id for r in docs.select("doc_id").collect() if quality.get(r.doc_id, 1)} or len(rows) > 150
    holders = {}
    for i, t in rows:
        for k in line_dedup.keys_of(t):
            holders.setdefault(k, []).append(i)
    lost = lambda i, p: line_dedup.long_enough(k := line_dedup.line_key(p)) and min(holders[k]) != i
    rows = [(i, "\n".join(p for p in t.split("\n") if not lost(i, p))) for i, t in rows]
    sets = {i: _shingle_set(t) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and (a == b or 5 * len(a & b) >= 4 * len(a | b)) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    rows = [(i, t) for i, t in rows if find(i) == i]
    items = [(r.item_id, r.text) for r in common.table(spark_, SF, "benchmark").collect()]
    dirty = leaks(rows, items)
    rows = [(i, t) for i, t in rows if not dirty[i][4]]
    encoder = bpe.TextEncoder(bpe.Bpe(bpe.read_ranks(bpe.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))), bpe.public_tokenizers.PATTERN)
    want = {i: (t, bpe.np.frombuffer(encoder.encode(t), "<i4").tolist()) for i, t in rows}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(want)
    for i, (text, ids) in want.items():
        assert got[i].text == text and got[i].ids == ids
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_near_dedup_stage_finds_copies_from_similarity_08(corpus, docs):
    import random

    from test_simhash import _pair, _shingles

    rng = random.Random(5)
    pairs = [_pair(rng, j) for j in (0.8, 0.85, 0.9) for _ in range(15)]
    similar = [5 * len(_shingles(a) & _shingles(b)) >= 4 * len(_shingles(a) | _shingles(b)) for a, b in pairs]
    rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    kept = {r.doc_id for r in stages()["SimHash near-dedup"](corpus, docs(rows), SF).collect()}
    assert {i for i, _ in rows if i % 2 == 0} <= kept
    lost = [2 * i + 1 not in kept for i in range(len(pairs))]
    assert sum(lost) <= sum(similar) and not any(x > y for x, y in zip(lost, similar, strict=True))
    assert sum(lost) >= 0.97 * sum(similar)


def test_near_dedup_stage_with_repeated_and_null_ids(corpus, docs):
    text = lambda k, n=60: " ".join(f"{k}{i}" for i in range(n))
    rows = [(1, text("a")), (1, text("a")), (2, text("a", 61)), (None, text("b")), (None, text("b")), (None, text("b", 61)),
            (None, text("c")), (9, text("c")), (2, text("d")), (5, text("e")), (5, text("e", 61))]
    got = [(r.doc_id, r.text) for r in stages()["SimHash near-dedup"](corpus, docs(rows), SF).collect()]
    firsts = sorted((str(i), t.split()[0]) for i, t in got)
    assert firsts == [("1", "a0"), ("2", "d0"), ("5", "e0"), ("9", "c0"), ("None", "b0")]


CLASH = ["_id", "_lost", "_key", "_features", "_score", "lost", "key", "rest", "ids", "n_lines", "n_dropped", "n_tokens", "digest",
         "item", "pos", "doc", "hits", "decoded_sha256"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_of_any_name(corpus, docs, name):
    rows = BATCH + [(5, BATCH[4][1]), (None, None), (None, BATCH[6][1])]
    df = docs(rows, clash=CLASH)
    out = stages()[name](corpus, df, SF)
    kept = [c for c in df.columns if name != "byte-level BPE" or c not in ("ids", "ids_sha256", "decoded_sha256")]
    assert [c for c in out.columns if c in kept] == kept and (name == "byte-level BPE" or out.columns == df.columns)
    found = common.materialize(out, "clash").collect()
    assert found and all(r[c] == "x" for r in found for c in CLASH if c in kept)


def test_decontamination_stage_with_repeated_and_null_ids(corpus, docs, tmp_path):
    items = [(1, "one two three four five six seven eight nine ten")]
    corpus.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, items[0][1]), (1, "clean"), (None, items[0][1] + " more"), (None, None), (None, "clean"), (2, "one two three"), (2, "four five six")]
    got = stages()["benchmark decontamination"](corpus, docs(rows), str(tmp_path)).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == [
        ("1", "clean"), ("2", "four five six"), ("2", "one two three"), ("None", "None"), ("None", "clean")]


def test_a_worker_gives_memory_back_when_its_task_ends(monkeypatch):
    from alertweave.llm import common

    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    run = common.tidy(lambda batches: (b + 1 for b in batches))
    some = run(iter([1, 2]))
    assert next(some) == 2 and not calls
    assert list(some) == [3] and len(calls) == 1
    cut = run(iter([1, 2]))
    next(cut)
    cut.close()
    assert len(calls) == 2


def test_workers_of_all_stages_give_memory_back():
    import inspect
    import re

    from alertweave.llm import common, line_dedup, quality, simhash

    for module in (common, line_dedup, quality, simhash):
        text = inspect.getsource(module)
        assert re.findall(r"\.mapInArrow\((\w+)", text) == ["tidy"] * text.count(".mapInArrow(")
