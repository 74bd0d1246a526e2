"""Language identification with string kernels.

The blended-spectrum presence kernel of two texts counts the distinct character n-grams of
all lengths 1 to 3 that both hold, divided by the root of the product of their own counts.
Nystroem landmarks turn it into a vector: kernel values against a fixed set of landmark texts,
times the inverse root of the landmarks' own kernel matrix. One ridge regression per language
(one against the rest) works on these vectors. Texts are scored in batches, presence matrix
times landmark matrix.

N-grams run over the lower-cased letters of any script; a run of anything else is one separator.
An n-gram is hashed to a number below SIZE, so a text of any length gives a fixed-size presence
vector and no letter is left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staging import ship
from .common import add_columns, crc_of_id, texts_of

ship(__name__)

UNDETERMINED = "und"
#: Bound of the training sample: rows kept for each language, chosen by a hash of the id.
SAMPLE_PER_LANGUAGE = 256
LANDMARKS_PER_LANGUAGE = 24
_BITS = 18
SIZE = 1 << _BITS
_FACTOR = 0x9E3779B1
_SEPARATOR = 0x20
RIDGE = 1e-3
_ROWS = 32


@cache
def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or the separator."""
    out = np.full(0x110000, _SEPARATOR, "u4")
    for c in range(0x110000):
        letter = chr(c)
        if letter.isalpha():
            low = letter.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


class Grams:
    """Texts as sets of n-gram numbers."""

    def __init__(self):
        self.code = _letters()

    def fill(self, text: str, row: np.ndarray) -> None:
        """Set the numbers of the n-grams of a text in a boolean row of SIZE."""
        c = self.code[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), "u4")]
        c = c[np.concatenate([[True], (c[1:] != _SEPARATOR) | (c[:-1] != _SEPARATOR)])]
        # Hashes are taken modulo 2 ** 32; the upper bits are the number.
        grams = c * np.uint32(_FACTOR)
        row[grams[c != _SEPARATOR] >> (32 - _BITS)] = True  # the separator alone says nothing
        for n in (1, 2):
            grams = ((grams[:-1] ^ (grams[:-1] >> 15)) + c[n:]) * np.uint32(_FACTOR)
            row[grams >> (32 - _BITS)] = True

    def of(self, text: str) -> np.ndarray:
        row = np.zeros(SIZE, bool)
        self.fill(text, row)
        return np.flatnonzero(row).astype("i4")


@dataclass
class Model:
    languages: list[str]
    column: np.ndarray  # n-gram number -> column of `marks`, or -1
    marks: np.ndarray  # distinct n-grams of the landmarks x landmarks, scaled
    weights: np.ndarray  # landmarks x languages, Nystroem map included

    def kernel(self, grams: Grams, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.marks.shape[1]), "f4")
        used = np.flatnonzero(self.column >= 0)
        order = used[np.argsort(self.column[used])]
        rows = np.zeros((_ROWS, SIZE), bool)
        for start in range(0, len(texts), _ROWS):
            part = texts[start : start + _ROWS]
            rows[:] = False
            for row, text in zip(rows, part, strict=False):
                grams.fill(text, row)
            norm = np.sqrt(np.maximum(np.count_nonzero(rows, axis=1), 1))
            product = rows[:, order].astype("f4") @ self.marks
            out[start : start + len(part)] = (product / norm[:, None])[: len(part)]
        return out


def has_letters(text: str) -> bool:
    return any(map(str.isalpha, text))


def training_sample(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """At most ``per_language`` ids of each language: the smallest in each of so many hash bins.

    One aggregate with a small state per language; a language with a third of all rows costs
    no more than another one.
    """
    bins = F.pmod(F.xxhash64("doc_id"), F.lit(per_language))
    return (
        labelled.groupBy("lang", bins.alias("_bin")).agg(F.min("doc_id").alias("doc_id")).drop("_bin")
    )


def fit(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE,
        landmarks: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> Model | None:
    """Fit on ``doc_id, text, lang`` rows; rows without id, text, letters or language are ignored.

    The sample's ids are bounded (``per_language`` for each language), so they are broadcast,
    and what the driver gets is n-gram numbers below ``SIZE`` of the landmarks and one kernel
    row per sampled text. None if nothing can be learned from. Rows of the same id and
    language give one training text, the smallest with letters, so the bound holds for rows too.
    """
    usable = labelled.select("doc_id", "text", "lang").dropna()
    ids = training_sample(usable.select("doc_id", "lang"), per_language).collect()
    if not ids:
        return None
    spark = labelled.sparkSession
    by_language: dict[str, list[int]] = {}
    for r in sorted(ids, key=lambda r: (r.lang, r.doc_id)):
        by_language.setdefault(r.lang, []).append(r.doc_id)
    languages = sorted(by_language)
    chosen = [(i, lang) for lang in languages for i in by_language[lang][:landmarks]]
    picked = _rows_of(usable, chosen)
    wanted = [(i, lang) for lang in languages for i in by_language[lang]]

    def make_grams():
        grams = Grams()
        kind = pa.list_(pa.int32())
        return lambda batch: {"grams": pa.array([grams.of(x) for x in texts_of(batch)], kind)}

    sets = add_columns(picked, make_grams, "grams array<int>").drop("text").collect()
    sets = sorted((r.lang, r.doc_id, r.grams) for r in sets if r.grams)
    if not sets:
        return None
    used = np.unique(np.concatenate([np.array(g, "i4") for _, _, g in sets]))
    column = np.full(SIZE, -1, "i4")
    column[used] = np.arange(len(used))
    marks = np.zeros((len(used), len(sets)), "f4")
    for j, (_, _, g) in enumerate(sets):
        marks[column[np.array(g, "i4")], j] = 1 / np.sqrt(len(g))
    own = marks.astype("f8").T @ marks.astype("f8")
    values, vectors = np.linalg.eigh(own)
    good = values > 1e-6 * values[-1]
    to_nystroem = vectors[:, good] / np.sqrt(values[good])
    model = Model(languages, column, marks, np.zeros((len(sets), len(languages))))
    shared = spark.sparkContext.broadcast(model)

    def make_kernel():
        grams = Grams()

        def fn(batch: pa.RecordBatch) -> dict:
            texts = texts_of(batch)
            rows = list(shared.value.kernel(grams, texts))
            return {"k": pa.array([r if has_letters(t) else None for r, t in zip(rows, texts, strict=True)],
                                  pa.list_(pa.float32()))}

        return fn

    rows = add_columns(_rows_of(usable, wanted), make_kernel, "k array<float>").drop("text")
    rows = sorted((r.lang, r.doc_id, r.k) for r in rows.filter("k is not null").collect())
    if not rows:
        return None
    x = np.array([r[2] for r in rows], "f8") @ to_nystroem
    x = np.c_[x, np.ones(len(x))]
    y = np.where(np.array([r[0] for r in rows])[:, None] == np.array(languages)[None], 1.0, -1.0)
    penalty = ridge * len(x) * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-9
    w = np.linalg.solve(x.T @ x + penalty, x.T @ y)
    # The constant goes to a last row that score() adds.
    model.weights = np.r_[to_nystroem @ w[:-1], w[-1:]]
    return model


def _rows_of(usable: DataFrame, ids: list[tuple[int, str]]) -> DataFrame:
    wanted = usable.sparkSession.createDataFrame(ids, "doc_id bigint, lang string")
    rows = usable.join(F.broadcast(wanted), ["doc_id", "lang"], "left_semi")
    least = F.min(F.struct(~F.rlike("text", F.lit(r"\p{L}")), "text"))
    return rows.groupBy("doc_id", "lang").agg(least["text"].alias("text"))


def classify(df: DataFrame, model: Model | None, text: str = "text",
             lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language of ``text`` and a score from 0 to 1.

    ``und`` with score 0 for null texts, texts without letters, and where no model could be
    fitted. Equal margins go to the language that comes first in the alphabet.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        grams = Grams()

        def fn(batch: pa.RecordBatch) -> dict:
            texts = texts_of(batch, text)
            if m is None:
                return {lang: pa.array([UNDETERMINED] * len(texts)), score: pa.array([0.0] * len(texts))}
            margin = m.kernel(grams, texts).astype("f8") @ m.weights[:-1] + m.weights[-1]
            best = margin.argmax(axis=1)
            value = np.clip((margin.max(axis=1) + 1) / 2, 0, 1)
            known = [has_letters(x) for x in texts]
            return {
                lang: pa.array([m.languages[b] if k else UNDETERMINED
                                for b, k in zip(best, known, strict=True)]),
                score: pa.array(np.where(known, value, 0.0)),
            }

        return fn

    return add_columns(df, make, f"`{lang}` string, `{score}` double")


def held_out() -> Column:
    return F.pmod(crc_of_id(), F.lit(4)) == 2


def predictions(documents: DataFrame) -> DataFrame:
    """Fit on the rows that are not held out, then predict every row."""
    model = fit(documents.filter(~F.coalesce(held_out(), F.lit(False))))
    return classify(documents.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
