import math
import random

import numpy as np
import pytest

from alertweave.llm import whitening


def table(corpus, rows, clash=""):
    schema = f"vec_id bigint, embedding array<float>, label int{clash}"
    return corpus.createDataFrame([(*r, 0, *(["x"] * clash.count(","))) for r in rows], schema)


def vectors(seed, n, dims, decay=1.0):
    pick = np.random.default_rng(seed)
    scale = np.linspace(1, 0.3, dims) ** decay
    return (pick.standard_normal((n, dims)) * scale * 0.3 + 0.2).astype("f4")


def check(df, rows, components=32):
    """Against the whole covariance matrix and exact sums of Python integers."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows], object)
    n, total = len(x), x.sum(0)
    c = (x * n - total).astype("f8") / n
    values, vecs = np.linalg.eigh(c.T @ c / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    out = df.collect()
    by_key = {}
    for r in out:
        by_key.setdefault(r.vec_id, {})[r.component] = r
    wanted = min(components, int((values > values[0] * 1e-12).sum()))
    assert len(out) == n * wanted
    signs = None
    for i, (key, _) in enumerate(rows):
        mine = by_key[key]
        assert sorted(mine) == list(range(1, wanted + 1))
        y = np.array([mine[k].whitened for k in sorted(mine)])
        want = c[i] @ vecs[:, :wanted] / np.sqrt(values[:wanted])
        if signs is None:
            signs = np.sign(y * want)
        assert np.allclose(y, want * signs, atol=1e-7)
        assert {r.deviation for r in mine.values()} == {int(((x[i] * n - total) ** 2).sum())}
        assert {r.n for r in mine.values()} == {n}
    some = by_key[rows[0][0]]
    got = np.array([some[k].explained for k in sorted(some)])
    assert np.allclose(got, (values / values.sum())[:wanted], rtol=1e-9)
    assert len({r.identity_error for r in out}) == 1 and out[0].identity_error < 1e-8 and out[0].residual < 1e-9


def test_whitened_vectors_equal_those_of_the_whole_covariance(corpus, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 37)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(1, 300, 60))]
    check(whitening.whiten(table(corpus, rows, ", n string, x string, keys string, component string")), rows)


@pytest.mark.parametrize("dims, components", [(1, 32), (5, 32), (40, 4), (60, 60)])
def test_few_dimensions_or_components(corpus, dims, components):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(dims, 120, dims))]
    check(whitening.whiten(table(corpus, rows), components), rows, components)


def test_vectors_that_cannot_be_used_are_left_out(corpus):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(2, 90, 6))]
    bad = [(200, None), (201, [None] * 6), (202, [0.1] * 5 + [math.nan]), (203, [math.inf] + [0.0] * 5), (204, []),
           (205, [-math.inf] * 6), (206, [0.5] * 7), (207, [0.5] * 5 + [None])]
    check(whitening.whiten(table(corpus, rows + bad)), rows)


def test_repeated_rows_and_null_keys_count_each(corpus):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(3, 50, 3))]
    out = whitening.whiten(table(corpus, rows + rows[:5] + [(None, rows[0][1])])).collect()
    assert len(out) == 56 * 3 and {r.n for r in out} == {56} and sum(r.vec_id is None for r in out) == 3


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 4])
def test_no_variance_gives_no_rows(corpus, rows):
    df = whitening.whiten(table(corpus, rows))
    assert df.columns[:7] == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert df.collect() == []


def test_very_large_entries_do_not_end_the_run(corpus):
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0]), (4, [1.0, 3.0])]
    out = whitening.whiten(table(corpus, rows)).collect()
    assert {r.vec_id for r in out if r.deviation is None} == {1, 2} and {r.n for r in out} == {4}


def test_deviations_by_both_ways():
    pick = random.Random(1)
    for far in (10, 10**9, 10**12):
        x = np.array([[pick.randint(-far, far) for _ in range(3)] for _ in range(20)])
        total = [int(t) for t in x.sum(0)]
        exact = [sum((20 * int(a) - t) ** 2 for a, t in zip(row, total)) for row in x]
        want = [e if e < 1 << 63 else None for e in exact]
        assert whitening.deviations(x, 20, total).to_pylist() == want


def spectrum(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return q @ np.diag(values) @ q.T, q


@pytest.mark.parametrize("values", [
    np.linspace(2, 1, 200), 1 / np.arange(1, 201) ** 2, np.r_[100, 90, np.linspace(7, 6, 198)],
    np.r_[np.full(10, 5.0), np.full(190, 1.0)], np.r_[[3.0, 2, 1], np.zeros(197)], np.r_[1e6, np.linspace(2, 1.9, 199)],
])
def test_eigenpairs_of_many_spectra(values):
    a, q = spectrum(values)
    passes = []

    def product(block):
        passes.append(block.shape[1])
        return a @ block

    found, vectors, error = whitening.eigenpairs(product, 200, 32)
    kept = min(32, int((values > 1e-12).sum()))
    assert len(found) == kept and error <= 1e-9
    assert np.allclose(found, values[:kept], rtol=1e-9, atol=values[0] * 1e-12)
    assert np.allclose(vectors.T @ vectors, np.eye(kept), atol=1e-12)
    assert np.abs(a @ vectors - vectors * found).max() <= 1e-8 * values[0]
    assert len(passes) < 400


def test_the_filter_damps_its_interval_and_keeps_what_lies_above():
    values = np.linspace(2, 0.5, 31)
    a, q = spectrum(values)
    out = whitening.filtered(lambda b: a @ b, q, a @ q, 0.5, 1.5, 2.0, 12)
    size = np.abs(np.diag(q.T @ out))
    assert np.isclose(size[0], 1) and size[values < 1.5].max() < 1e-6 and size[values > 1.5].min() > size[values < 1.5].max()
