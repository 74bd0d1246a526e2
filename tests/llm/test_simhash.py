import random

import numpy as np
import pytest
import xxhash

from alertweave.llm import simhash


def brute_print(text, words=4):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def brute_components(prints, most):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= most and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_fingerprints_are_the_definition():
    for text in ("", "one", "one two three", "One TWO\tthree\x0bfour É é", "a " * 500, "  x\x1cy"):
        assert simhash.fingerprint(simhash.shingle_hashes(text, 4)) == brute_print(text), text


@pytest.mark.parametrize("most,groups", [(4, 2), (8, 3), (2, 1)])
def test_near_fingerprints_always_share_a_cell(most, groups):
    random.seed(most)
    for _ in range(400):
        a = random.getrandbits(64)
        b = a
        for bit in random.sample(range(64), random.randint(0, most)):
            b ^= 1 << bit
        cells = [set(simhash.grid_cells(np.array([x], "u8").view("i8"), groups)[1].tolist()) for x in (a, b)]
        assert cells[0] & cells[1], (hex(a), hex(b))


@pytest.mark.parametrize("most,groups", [(4, 2), (8, 3)])
def test_links_and_components_equal_brute_force(corpus, most, groups):
    random.seed(11)
    prints = [random.getrandbits(64) for _ in range(40)]
    for _ in range(260):  # chains, stars and dense groups of near copies
        x = random.choice(prints[:12] + prints[-20:])
        for bit in random.sample(range(64), random.randint(0, most + 2)):
            x ^= 1 << bit
        prints.append(x)
    prints = list(dict.fromkeys([*prints, 0, 2**64 - 1, 15, 31]))
    signed = {simhash._signed(p): p for p in prints}
    rows = [(s, s, []) for s in signed]
    df = corpus.createDataFrame(rows, "node bigint, fp bigint, wide array<bigint>")
    edges = simhash.links(df, most, groups, 0)
    assert all((signed[r.a] ^ signed[r.b]).bit_count() <= most for r in edges.collect())
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    want = brute_components(signed, most)
    groups_of = lambda names: {frozenset(k for k in names if names[k] == v) for v in names.values()}
    assert groups_of({s: roots.get(s, s) for s in signed}) == groups_of(want)


def test_long_chain_contracts(corpus):
    edges = corpus.createDataFrame([(i, i + 1) for i in range(300)], "a bigint, b bigint")
    got = simhash.components(edges).collect()
    assert len(got) == 301 and len({r.root for r in got}) == 1


def test_a_large_cell_gives_a_forest():
    center = random.Random(2).getrandbits(64)
    fps = [center] + [center ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)]
    edges = simhash.cell_forest(np.array(fps, "u8").view("i8")[:, None], 4, 0)
    assert len(edges) == len(fps) - 1


def test_documents(docs):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (3, base + " more"), (9, base), (1, "quite another text with words"), (7, None), (8, ""),
            (2, " \n"), (None, base), (3, base + " more"), (11, "x " * 100_000)]
    got = simhash.document_classes(docs(rows, clash=("fp", "component_id", "wide"))).collect()
    assert len(got) == len(rows)
    prints = {}
    for i, t in rows:
        prints[i] = brute_print(t)
    want = brute_components({i: p for i, p in prints.items() if i is not None}, 4)
    for r in got:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}"
        assert r.component_id == (want[5] if r.doc_id is None else want[r.doc_id])
    assert simhash.document_classes(docs([])).count() == 0


def test_wide_fingerprints_must_agree(docs):
    random.seed(4)
    base = [random.choice("abcdefgh") + str(random.randint(0, 999)) for _ in range(600)]
    near = base.copy()
    near[300] = "changed"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(reversed(base)))]
    kw = dict(words=5, most=8, groups=3, extra=2)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(rows), wide_most=20, **kw).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(rows), wide_most=0, **kw).collect()}
    assert got[2] == 2


def _pair(rng, jaccard, words=400):
    """Two texts of ``words`` words whose sets of five-word shingles have about this similarity."""
    a = [f"w{rng.randrange(10**9)}" for _ in range(words)]
    b, at = a.copy(), 2
    n = words - 4
    while True:
        sa, sb = ({tuple(x[i : i + 5]) for i in range(n)} for x in (a, b))
        similarity = len(sa & sb) / len(sa | sb)
        if similarity <= jaccard + 0.012 or at >= words:
            return " ".join(a), " ".join(b)
        b[at] = f"x{rng.randrange(10**9)}"
        at += 5


def _shingles(text):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_copies_as_brute_force_jaccard(docs):
    rng = random.Random(11)
    rows = []
    for jaccard in (0.7, 0.78, 0.8, 0.85, 0.9):
        for _ in range(20):
            rows += [(len(rows) + i, t) for i, t in enumerate(_pair(rng, jaccard))]
    # Repeats count once: these sets are far apart or equal, unlike the counts of their shingles.
    rows += [(1000, "a b c d e " * 300 + rows[0][1]), (1001, "a b c d e " * 300 + rows[2][1])]
    rows += [(1002, rows[4][1] + " " + rows[4][1]), (1003, " ".join(rows[4][1].split() * 3)), (1004, None), (1005, " ")]
    sets = {i: _shingles(t or "") for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    true = []
    for i, x in sets.items():
        for j, y in sets.items():
            if i < j and 5 * len(x & y) >= 4 * len(x | y):
                true.append((i, j))
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert len(true) > 50
    got = {r.doc_id: r.component_id for r in simhash.jaccard_classes(docs(rows)).collect()}
    assert all(find(got[i]) == find(i) for i in sets)  # nothing links that should not
    linked = sum(got[i] == got[j] for i, j in true)
    assert linked / len(true) >= 0.97


def test_pairs_of_a_large_cell_in_several_batches(corpus):
    rng = random.Random(12)
    fp = simhash._signed(rng.getrandbits(64))
    rows = [(i, i // 2, fp, [fp ^ (1 << i % 60)]) for i in range(300)]
    nodes = corpus.createDataFrame(rows, "node bigint, root bigint, fp bigint, wide array<bigint>").coalesce(1)
    old = corpus.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    corpus.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        got = {(r.a, r.b) for r in simhash.close_pairs(nodes, 0, 1, 3, 2).collect()}
        one = {(r.a, r.b) for r in simhash.close_pairs(nodes, 0, 1, 3, 1).collect()}
    finally:
        corpus.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == {(i, j) for i in range(300) for j in range(i + 1, 300) if i // 2 != j // 2}
    assert one == {(i, j) for i, j in got if i % 60 == j % 60}


def test_forests_connect_what_all_pairs_do_with_few_rows(corpus):
    rng = random.Random(13)
    rows = []
    for group in range(3):
        fp = simhash._signed(rng.getrandbits(64))
        rows += [(len(rows) + i, len(rows) + i, fp, [fp ^ (1 << i % 40)]) for i in range((300, 60, 2)[group])]
    nodes = corpus.createDataFrame(rows, "node bigint, root bigint, fp bigint, wide array<bigint>").coalesce(2)
    every = simhash.close_pairs(nodes, 0, 1, 3, 2)
    few = simhash.close_pairs(nodes, 0, 1, 3, 2, forests=True)
    assert every.count() > 40_000
    assert few.count() <= 3 * len(rows)
    assert few.exceptAll(every).isEmpty()
    roots = [{(r.node, r.root) for r in simhash.components(x).collect()} for x in (every, few)]
    assert roots[0] == roots[1] and len(roots[0]) == len(rows)


def test_groups_of_candidates_in_one_block_and_in_many(docs, monkeypatch):
    rng = random.Random(14)
    base = [f"w{rng.randrange(10**9)}" for _ in range(300)]
    rows = []
    for i in range(60):  # about 0.9 like the base, about 0.8 like each other
        text = base.copy()
        for at in rng.sample(range(300), 3):
            text[at] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(text)))
    rows += [(100 + i, t) for i, t in enumerate(_pair(rng, 0.85))]
    sets = {i: _shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, x in sets.items():
        for j, y in sets.items():
            if i < j and 5 * len(x & y) >= 4 * len(x | y):
                root[max(find(i), find(j))] = min(find(i), find(j))
    want = {i: find(i) for i in sets}
    monkeypatch.setattr(simhash, "links", lambda nodes, *_: nodes.selectExpr("node a", "node b").limit(0))
    for block in (2048, 7):
        monkeypatch.setattr(simhash, "BLOCK", block)
        assert {r.doc_id: r.component_id for r in simhash.jaccard_classes(docs(rows)).collect()} == want
