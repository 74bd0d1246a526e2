import hashlib
import random

import pytest
from pyspark.sql import functions as F

from alertweave.llm import iblt


def brute(rows):
    """By id: (n_chars, edited sha, near_edited, near_next), from the definition."""
    first = {}
    for i, t in rows:
        if i is not None:
            first[i] = min(t or "", first.get(i, t or ""))
    ids = sorted(first, reverse=True)
    par = lambda t: {x for x in t.split("\n") if x}
    like = lambda a, b: len(par(a) & par(b)) / len(par(a) | par(b)) if par(a) | par(b) else 1.0
    out = []
    for i, t in rows:
        t = t or ""
        following = first[ids[(ids.index(i) + 1) % len(ids)]] if i is not None else ""
        third = len(t) // 3
        edited = t[: len(t) - third] + following[:third]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        out.append((i, len(t), sha, round(like(t, edited), 9), round(like(t, following), 9)))
    return sorted(out, key=repr)


def result(df):
    rows = df.collect()
    return sorted(
        ((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows), key=repr
    )


def lines(n, seed):
    rng = random.Random(seed)
    return "\n".join(f"line {rng.randint(0, 60)} é\U0001f600" for _ in range(n))


ROWS = [
    (1, None), (2, ""), (5, lines(3, 1)), (6, lines(40, 2)), (7, lines(40, 2)), (9, "\n\n"), (12, "one"),
    (20, lines(900, 3)), (21, "\n".join(f"own {i}" for i in range(1500))), (6, lines(40, 2)), (None, lines(4, 4)), (30, lines(9, 5)),
]


def test_documents(docs):
    df = iblt.report(docs(ROWS, clash=("row", "pair", "size", "head", "third")))
    assert result(df) == brute(ROWS)
    prints = {r.doc_id: r.fingerprint for r in df.collect()}
    assert prints[6] == prints[7] and prints[1] == prints[2] and prints[5] != prints[6]


@pytest.mark.parametrize("rows", [[], [(1, "alone\nhere and there")], [(None, "a\nb\nc")], [(1, "a"), (1, "a")]])
def test_small_tables(docs, rows):
    assert result(iblt.report(docs(rows))) == brute(rows)


def test_all_differing_digests_are_recovered(corpus):
    rng = random.Random(6)
    rows, want = [], {}
    for pair, (n, m, both) in enumerate([(0, 0, 0), (1, 0, 0), (0, 1, 5), (3, 2, 100), (400, 300, 50), (1, 1, 0), (0, 0, 9)]):
        x, y, s = ([rng.getrandbits(63) for _ in range(k)] for k in (n, m, both))
        rows.append((pair, x + s, s + y))
        want |= {(pair, d): 1 for d in x} | {(pair, d): -1 for d in y}
    df = corpus.createDataFrame(rows, "pair bigint, x array<bigint>, y array<bigint>")
    got = iblt.differing_digests(df).collect()
    assert {(r.pair, r.digest): r.side for r in got} == want and len(got) == len(want)
    sizes = {r.pair: r.differ for r in iblt.difference_sizes(df).collect()}
    assert {p: sizes.get(p, 0) for p, *_ in rows} == {p: len(set(x) ^ set(y)) for p, x, y in rows}


def test_a_table_that_is_too_small_is_tried_again(corpus, monkeypatch):
    monkeypatch.setattr(iblt, "FIRST_CELLS", 0.01)
    df = corpus.createDataFrame([(0, list(range(200)), list(range(500, 560)))], "pair bigint, x array<bigint>, y array<bigint>")
    assert iblt.difference_sizes(df).first().differ == 260


def test_fingerprint_is_the_table(corpus):
    df = corpus.createDataFrame([([5, 9, 12],), ([],)], "d array<bigint>").select(iblt.fingerprint(F.col("d")).alias("f"))
    full, empty = (r.f for r in df.collect())
    cells = [full[i : i + 28] for i in range(0, len(full), 28)]
    assert len(cells) == iblt.FIXED_CELLS and sum(int(c[:4], 16) for c in cells) == 3 * iblt.SUBTABLES
    for subtable in range(iblt.SUBTABLES):
        xor = 0
        for c in cells[subtable * 4 : subtable * 4 + 4]:
            xor ^= int(c[4:20], 16)
        assert xor == 5 ^ 9 ^ 12
    assert set(empty) == {"0"}


def test_no_python_in_the_plan(docs):
    text = iblt.report(docs([(1, "a\nb"), (2, "c")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Cartesian" not in text
