"""Quality classifier: regularised quadratic discriminant on document statistics.

Each text becomes a vector of transformed statistics. For each class the mean and covariance
are summed over all labelled rows in the cluster; the covariance is shrunk towards the one
that both classes share and towards its own diagonal. A score is the logistic of the
difference of the two log densities: log priors, log determinants and squared Mahalanobis
distances, which come from Cholesky factors computed once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staging import ship
from .common import add_columns, crc_of_id, materialize, texts_of, tidy, unused

ship(__name__)

#: Weight of the covariance shared by the classes, and of the plain diagonal.
TO_POOLED = 0.3
TO_DIAGONAL = 0.1
FLOOR = 1e-3

_WORD = re.compile(r"[^\W\d_]+")
_MARKS = "|#$%&*!?<>{}[]\\^~=+_@"

NAMES = (
    "log_chars", "log_words", "log_lines", "word_chars", "word_spread", "long_words",
    "letters", "upper", "digits", "spaces", "marks", "other", "stops", "commas",
    "capital_words", "marked_words", "distinct_words", "distinct_lines", "line_words",
    "sentence_words", "top_word", "entropy",
)
WIDTH = len(NAMES)
_CLASS = np.full(256, 5, "u1")  # letters (other bytes of UTF-8 count as letters)
for _b in range(128):
    _c = chr(_b)
    _CLASS[_b] = (
        5 if _c.islower() else 0 if _c.isupper() else 1 if _c.isdigit() else 2 if _c.isspace()
        else 3 if _c in _MARKS else 4
    )


def _logit(x: float) -> float:
    """Shares as log odds, bounded at both ends."""
    x = min(max(float(x), 0.0), 1.0)
    return float(np.log((x + 0.005) / (1.005 - x)))


def statistics(text: str) -> list[float]:
    """The vector of one whole text; an empty text has a vector too."""
    data = np.frombuffer(text.encode("utf-8", "replace"), "u1")
    n = max(len(data), 1)
    counts = np.bincount(data, minlength=256)
    by_class = np.bincount(_CLASS, weights=counts, minlength=6) / n
    p = counts[counts > 0] / n
    words, lines = text.split(), text.split("\n")
    w = max(len(words), 1)
    sizes = np.fromiter(map(len, words), "i4", len(words)) if words else np.zeros(1, "i4")
    seen: dict[str, int] = {}
    for word in words:
        seen[word] = seen.get(word, 0) + 1
    starts = sum(map(str.istitle, words))
    shouted = sum(map(str.isupper, words))
    marked = sum(word[-1] in _MARKS for word in words)
    stops = counts[46] + counts[33] + counts[63]
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), float(np.log1p(len(lines))),
        float(np.log1p(sizes.mean())), float(np.log1p(sizes.std())), _logit((sizes > 15).mean()),
        _logit(by_class[5]), _logit(by_class[0]), _logit(by_class[1]), _logit(by_class[2]),
        _logit(by_class[3]), _logit(by_class[4]), _logit(stops / n), _logit(counts[44] / n),
        _logit((starts + shouted) / w), _logit(marked / w), _logit(len(seen) / w),
        _logit(len(set(lines)) / len(lines)), float(np.log1p(w / len(lines))),
        float(np.log1p(w / (1 + stops))), _logit(max(seen.values(), default=0) / w),
        float(-(p * np.log(p)).sum()),
    ]


def add_statistics(df: DataFrame, text: str = "text", out: str = "features") -> DataFrame:
    """Add the statistics of ``text``; null counts as empty."""

    def make():
        def fn(batch: pa.RecordBatch) -> dict:
            rows = [statistics(x) for x in texts_of(batch, text)]
            return {out: pa.array(rows, pa.list_(pa.float64()))}

        return fn

    return add_columns(df, make, f"`{out}` array<double>")


@dataclass
class Discriminant:
    """Per class (0, 1): log prior, mean, inverse Cholesky factor, half the log determinant."""

    prior: np.ndarray
    mean: np.ndarray
    whiten: np.ndarray
    half_log_det: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        density = []
        for k in (0, 1):
            z = (x - self.mean[k]) @ self.whiten[k].T
            density.append(self.prior[k] - self.half_log_det[k] - 0.5 * (z * z).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def fit(vectors: DataFrame, label: str = "label", features: str = "features") -> Discriminant | None:
    """Sums over all rows with label 0 or 1: a count, a vector and a matrix for each class.

    Every task sends one such set, so the driver gets a fixed number of bytes for each task's
    group. None if a class has no rows; rows with other or null labels are ignored.
    """
    usable = vectors.filter(F.col(label).isin(0, 1)).select(F.col(label).cast("int"), features)

    def sums(batches):
        total = np.zeros((2, 1 + WIDTH + WIDTH * WIDTH))
        for batch in batches:
            y = batch.column(0).to_numpy()
            x = np.asarray(batch.column(1).flatten()).reshape(-1, WIDTH)
            for k in (0, 1):
                part = x[y == k]
                total[k] += np.concatenate([[len(part)], part.sum(0), (part.T @ part).ravel()])
        yield pa.RecordBatch.from_pydict({
            "k": np.repeat([0, 1], total.shape[1]),
            "i": np.tile(np.arange(total.shape[1]), 2),
            "v": total.ravel(),
        })

    # One row per class and matrix cell after the sum, whatever the number of tasks.
    parts = usable.mapInArrow(tidy(sums), "k bigint, i bigint, v double")
    total = np.zeros((2, 1 + WIDTH + WIDTH * WIDTH))
    for r in parts.groupBy("k", "i").agg(F.sum("v").alias("v")).collect():
        total[r.k, r.i] = r.v
    n = total[:, 0]
    if n.min() < 1:
        return None
    mean = total[:, 1 : 1 + WIDTH] / n[:, None]
    square = total[:, 1 + WIDTH :].reshape(2, WIDTH, WIDTH)
    own = square / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    pooled = (own * n[:, None, None]).sum(0) / n.sum()
    whiten, half = [], []
    for k in (0, 1):
        c = (1 - TO_POOLED) * own[k] + TO_POOLED * pooled
        c = (1 - TO_DIAGONAL) * c + TO_DIAGONAL * np.diag(np.diag(c)) + FLOOR * np.eye(WIDTH)
        factor = np.linalg.cholesky(c)
        whiten.append(np.linalg.inv(factor))
        half.append(np.log(np.diag(factor)).sum())
    return Discriminant(np.log(n / n.sum()), mean, np.array(whiten), np.array(half))


def add_scores(vectors: DataFrame, model: Discriminant | None, features: str = "features",
               out: str = "score") -> DataFrame:
    """Add the probability of class 1; 0.5 where no model could be fitted."""

    def make():
        def fn(batch: pa.RecordBatch) -> dict:
            x = np.asarray(batch.column(features).flatten()).reshape(-1, WIDTH)
            return {out: pa.array(model.score(x) if model else np.full(len(x), 0.5))}

        return fn

    return add_columns(vectors, make, f"`{out}` double")


def held_out() -> Column:
    return F.coalesce(F.pmod(crc_of_id(), F.lit(3)) == 1, F.lit(False))


def _labelled(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """Vectors with the label of their document; a document with two labels counts twice."""
    known = labels.select("doc_id", F.col("quality").alias("label")).distinct()
    return vectors.join(known, "doc_id")


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows that are not held out, then score every document.

    Texts are read once: their vectors are kept in a table, which is all that fitting and
    scoring read.
    """
    vectors = materialize(add_statistics(documents.select("doc_id", "text")).drop("text"), "vectors")
    model = fit(_labelled(vectors.filter(~held_out()), labels))
    return add_scores(vectors, model).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with all their columns.

    Fits like ``scored``. Texts are read a second time for their scores, so none is shuffled.
    """
    vectors = materialize(add_statistics(documents.select("doc_id", "text")).drop("text"), "vectors")
    model = fit(_labelled(vectors.filter(~held_out()), labels))
    features, score = unused(documents, "features"), unused(documents, "score")
    scores = add_scores(add_statistics(documents, out=features), model, features, score)
    return scores.filter(F.col(f"`{score}`") >= 0.5).select(*[F.col(f"`{c}`") for c in documents.columns])
