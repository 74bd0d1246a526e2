import random
import zlib

import numpy as np

from alertweave.llm import quality

LABELS = "doc_id bigint, quality int, toxic int, text string"


def make(n, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(rng.randint(20, 200))]
        good = rng.random() < 0.8
        if not good:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [w + " |" for w in words]
        rows.append((i, " ".join(words).capitalize() + "."))
        labels.append((i, int(good), 0, "clash"))
    return rows, labels


def test_held_out_accuracy_and_edge_rows(docs, corpus):
    rows, labels = make(400)
    rows += [(900, None), (901, ""), (902, "I A B"), (903, "word " * 200_000), (None, "some text"), (0, rows[0][1])]
    labels += [(901, None, 0, ""), (902, 7, 0, ""), (None, 1, 0, ""), (0, labels[0][1], 1, "")]
    got = quality.scored(docs(rows, clash=("features", "label", "score")), corpus.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {i: q for i, q, _, _ in labels[:400]}
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97


def test_one_class_or_no_rows(docs, corpus):
    rows, labels = make(30)
    ones = corpus.createDataFrame([(i, 1, 0, "") for i, *_ in labels], LABELS)
    assert {r.score for r in quality.scored(docs(rows), ones).collect()} == {0.5}
    assert quality.scored(docs([]), ones).count() == 0
    none = corpus.createDataFrame([], LABELS)
    assert quality.keep_good(docs(rows), none).count() == 30


def test_scores_are_the_density_difference(corpus):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, quality.WIDTH)) * rng.uniform(0.5, 2, quality.WIDTH)
    y = (rng.random(200) < 0.4).astype(int)
    x[y == 1] += 0.7
    df = corpus.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(y, x, strict=True))],
                                "doc_id bigint, label int, features array<double>")
    model = quality.fit(df.repartition(5))
    cov = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum(c * (y == k).mean() for k, c in enumerate(cov))
    density = []
    for k in (0, 1):
        c = (1 - quality.TO_POOLED) * cov[k] + quality.TO_POOLED * pooled
        c = (1 - quality.TO_DIAGONAL) * c + quality.TO_DIAGONAL * np.diag(np.diag(c)) + quality.FLOOR * np.eye(len(c))
        d = x - x[y == k].mean(0)
        density.append(np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(c)[1]
                       - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    want = 1 / (1 + np.exp(density[0] - density[1]))
    assert np.allclose(model.score(x), want, atol=1e-6)


def test_keep_good_returns_documents(docs, corpus):
    rows, labels = make(300)
    df = docs(rows)
    kept = quality.keep_good(df, corpus.createDataFrame(labels, LABELS))
    assert kept.columns == df.columns
    good = {i for i, q, *_ in labels if q}
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids & good) > 0.97 * len(good) and len(ids - good) <= 3


def test_statistics_of_any_text():
    for text in ("", "\n", "I", "\x00�", "a" * 100_000, "中文", "|||"):
        v = quality.statistics(text)
        assert len(v) == quality.WIDTH and np.isfinite(v).all(), text
