"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Vectors become whole numbers, so their sums and squared deviations are exact. The covariance is
never formed: all that is asked of it is its product with a few columns Q, one pass over the
rows in which every task adds up Xc'(Xc Q) of its blocks (Xc: rows centred before they are
multiplied). A Chebyshev polynomial of the covariance, whose recurrence takes one pass a
degree, damps the part of the spectrum below the wanted one; QR and a Rayleigh-Ritz step follow, until
the residuals of all wanted eigenpairs certify them. The interval to damp ends at the smallest
value of the subspace and begins at a lower bound of the spectrum, from Lanczos steps that ride on the
passes of the first filter as one more column.

What reaches the driver is the size of Q (dimensions x columns), whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.staging import ship
from .common import materialize

ship(__name__)

COMPONENTS = 32
#: Columns beyond the wanted ones; they only make the iteration converge faster.
SPARE = 16
SCALE, SHIFT = 64, 1_000_000
#: Rows in a block.
BLOCK = 4096
#: Residual of an eigenpair over its eigenvalue, and the most rounds to reach it.
TOLERANCE, ROUNDS = 1e-13, 40
#: Share of the largest eigenvalue that a residual is measured against at least: products carry
#: rounding errors in proportion to the largest.
FLOOR = 1e-4
#: The least that counts as certified when rounding stops the progress.
CERTIFIED = 1e-9
FIRST_DEGREE, MOST_DEGREE = 10, 40
#: The largest ratio by which a filter may treat two wanted directions differently.
SPREAD = 1e11
MOST_LONG = (1 << 63) - 1


def whole(vector: np.ndarray) -> np.ndarray:
    """``floor(64 c) + 1000000`` as long; what no long can hold takes the nearest one."""
    x = np.floor(SCALE * vector)
    edge = float(1 << 62)
    return np.clip(x, -edge, edge).astype("i8") + SHIFT


def vector_blocks(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``keys, x``: blocks of rows as the array of their keys and the matrix of their longs.

    Rows whose vector is null or holds null, NaN or infinite entries are left out, and so are
    those that have not the commonest length (ties: the longest), and empty vectors. Null and
    repeated keys stay.
    """
    values = F.col(f"`{vector}`").cast("array<double>")
    rows = df.select(F.col(f"`{key}`").alias("key"), values.alias("v")).filter(
        (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    )
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = sizes.size if sizes else 0
    rows = rows.filter(F.size("v") == size)
    kind = T.ArrayType(rows.schema["key"].dataType)

    def run(batches):
        keys, parts, held = [], [], 0

        def block():
            return pa.RecordBatch.from_pydict({
                "keys": pa.array([[k for part in keys for k in part.to_pylist()]], pa.list_(keys[0].type)),
                "x": pa.array([np.concatenate(parts).astype("<i8").tobytes()], pa.binary()),
            })

        for batch in batches:
            x = whole(np.asarray(batch.column("v").flatten(), "f8").reshape(batch.num_rows, size))
            for start in range(0, len(x), BLOCK):
                part = x[start : start + BLOCK]
                if held + len(part) > BLOCK:
                    yield block()
                    keys, parts, held = [], [], 0
                keys.append(batch.column("key").slice(start, len(part)))
                parts.append(part)
                held += len(part)
        if held:
            yield block()

    schema = T.StructType([T.StructField("keys", kind), T.StructField("x", T.BinaryType())])
    blocks = materialize(rows.mapInArrow(run, schema), "blocks")
    return blocks.withColumn("dims", F.lit(size))


def _matrices(batches, dims: int):
    for batch in batches:
        for packed in batch.column("x").to_pylist():
            yield np.frombuffer(packed, "<i8").reshape(-1, dims)


def sums(blocks: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension."""

    def run(batches):
        n, total = 0, [0] * dims
        for x in _matrices(batches, dims):
            n += len(x)
            # Two halves of each number, so a block's sum fits a long.
            high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
            total = [t + (int(h) << 32) + int(w) for t, h, w in zip(total, high, low, strict=True)]
        # In parts of 32 bits, which Spark adds as longs without loss.
        rows = [(i, n if i == 0 else 0, t >> 64, t >> 32 & 0xFFFFFFFF, t & 0xFFFFFFFF) for i, t in enumerate(total)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["i", "n", "a", "b", "c"]
        )

    parts = blocks.select("x").mapInArrow(run, "i bigint, n bigint, a bigint, b bigint, c bigint")
    found = parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in "nabc"]).collect()
    by_dim = {r.i: r for r in found}
    n = by_dim[0].n if by_dim else 0
    return n, [(r.a << 64) + (r.b << 32) + r.c for r in (by_dim[i] for i in range(dims))] if n else [0] * dims


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """Rows less the mean: subtracted in whole numbers where they fit, then divided."""
    whole_mean = np.array([t // n for t in total], "i8")
    rest = np.array([(t % n) / n for t in total])
    return (x - whole_mean).astype("f8") - rest


def _summed(blocks: DataFrame, dims: int, width: int, height: int, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``make(x)`` (height x width) over all blocks; combined by row in Spark."""

    def run(batches):
        total = np.zeros((height, width))
        for x in _matrices(batches, dims):
            total += make(x)
        columns = {"i": pa.array(np.arange(height), pa.int32())}
        yield pa.RecordBatch.from_pydict(columns | {f"c{j}": pa.array(total[:, j]) for j in range(width)})

    names = [f"c{j}" for j in range(width)]
    parts = blocks.select("x").mapInArrow(run, "i int, " + ", ".join(f"{c} double" for c in names))
    out = np.zeros((height, width))
    for r in parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out[r.i] = r[1:]
    return out


def filtered(
    product: Callable[[np.ndarray], np.ndarray], q: np.ndarray, first: np.ndarray,
    low: float, high: float, top: float, degree: int,
) -> np.ndarray:
    """The Chebyshev polynomial of the operator, small on [low, high] and 1 at ``top``, of ``q``.

    ``first`` is the operator's product with ``q``.
    """
    half, middle = (high - low) / 2, (high + low) / 2
    sigma = half / (top - middle)
    tau = 2 / sigma
    before, now = q, (first - middle * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (tau - sigma)
        before, now = now, (product(now) - middle * now) * (2 * after / half) - sigma * after * before
        sigma = after
    return now


class Riding:
    """Lanczos steps whose products are one more column of other products."""

    def __init__(self, product: Callable[[np.ndarray], np.ndarray], dims: int, seed: int = 7):
        self.product = product
        start = np.random.default_rng(seed).standard_normal(dims)
        self.basis, self.diagonal, self.beside = [start / np.linalg.norm(start)], [], []

    def __call__(self, q: np.ndarray) -> np.ndarray:
        if len(self.diagonal) == len(self.basis):  # the space is used up
            return self.product(q)
        both = self.product(np.column_stack([q, self.basis[-1]]))
        left = both[:, -1].copy()
        self.diagonal.append(float(self.basis[-1] @ left))
        for _ in range(2):
            for v in self.basis:
                left -= (v @ left) * v
        norm = float(np.linalg.norm(left))
        self.beside.append(norm)
        if norm > 1e-10 * max(abs(d) for d in self.diagonal) and len(self.basis) < len(left):
            self.basis.append(left / norm)
        return both[:, :-1]

    def lower_bound(self) -> float:
        inner = self.beside[: len(self.diagonal) - 1]
        t = np.diag(self.diagonal) + np.diag(inner, 1) + np.diag(inner, -1)
        return max(0.0, float(np.linalg.eigvalsh(t)[0]) - self.beside[-1])


def eigenpairs(
    product: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, spare: int = SPARE, seed: int = 11
) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``wanted`` largest eigenvalues of a covariance, their unit vectors as columns, and
    the largest residual over the eigenvalue (or ``FLOOR`` of the largest).

    ``product`` multiplies the covariance with columns. Fewer pairs come back if its rank, as far as
    rounding tells, is less. Vectors of equal eigenvalues are any basis of their space.
    """
    wanted = min(wanted, dims)
    columns = min(dims, wanted + spare)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, columns)))[0]
    image, low, best = product(q), 0.0, None
    stalled, lanczos = 0, Riding(product, dims)
    for turn in range(ROUNDS):
        inside = q.T @ image
        values, turnings = np.linalg.eigh((inside + inside.T) / 2)
        values, turnings = values[::-1], turnings[:, ::-1]
        q, image = q @ turnings, image @ turnings
        top = max(values[0], 0.0)
        residual = np.linalg.norm(image - q * values, axis=0)[:wanted]
        errors = residual / np.maximum(values[:wanted], FLOOR * top) if top else np.zeros(wanted)
        error = float(errors.max())
        stalled = 0 if best is None or error < best[2] / 2 else stalled + 1
        if best is None or error < best[2]:
            best = values[:wanted].copy(), q[:, :wanted].copy(), error
        if best[2] <= TOLERANCE or columns == dims or (stalled >= 2 and best[2] <= CERTIFIED):
            break
        if stalled >= 4:  # the lower bound may have been none
            low, stalled = 0.0, 0
        # Leading pairs that are certified stay as they are and out of the filter, whose degree
        # the largest of them would keep low.
        done = int(np.argmax(errors > TOLERANCE))
        still, moving = q[:, :done], q[:, done:]

        def beside(block: np.ndarray) -> np.ndarray:
            return block - still @ (still.T @ block)  # noqa: B023 - used in this turn only

        ask = lanczos if turn == 0 else product
        high = max(float(values[-1]), top * 1e-12)
        low = min(low, high * 0.999)
        reach = [np.arccosh(max(1.0, 2 * (v - low) / (high - low) - 1)) for v in (values[done], values[wanted - 1])]
        widest = int(np.log(SPREAD) / max(reach[0] - reach[1], 1e-3))
        degree = FIRST_DEGREE if turn == 0 else max(2, min(MOST_DEGREE, widest))
        middle = (low + high) / 2

        def damped(block: np.ndarray) -> np.ndarray:
            # For the filter, what is certified has the eigenvalue that it damps most.
            return beside(ask(block)) + middle * (block - beside(block))  # noqa: B023

        moving = filtered(
            damped, moving, beside(image[:, done:]), low, high,
            max(float(values[done]), high * 1.001), degree,
        )
        moving = np.linalg.qr(beside(np.linalg.qr(beside(moving))[0]))[0]
        q, image = np.column_stack([still, moving]), np.column_stack([image[:, :done], product(moving)])
        if turn == 0:
            low = lanczos.lower_bound()
    values, vectors, error = best
    kept = values > max(values[0], 0.0) * dims * np.finfo("f8").eps * 4
    if error > CERTIFIED:
        raise ArithmeticError(f"the eigenpairs are only known to {error:.1e}")
    return values[kept], vectors[:, kept], error


def whiten(
    df: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """One row per vector that can be used and component, largest eigenvalue first.

    ``<key>, component, n, deviation, whitened, explained, identity_error, residual``: ``deviation``
    is the exact squared distance from the mean times n squared (null if no long can hold it),
    ``explained`` the share of the variance, ``identity_error`` how far the covariance of
    ``whitened``, measured over all rows, is from the identity, ``residual`` the certificate of the
    eigenpairs. Components without variance have no rows, so equal vectors, a single one or
    none give no rows. Which rows are left out: see ``vector_blocks``.
    """
    blocks = vector_blocks(df, key, vector)
    first = blocks.select("dims").first()
    dims = first.dims if first else 0
    n, total = sums(blocks, dims) if dims else (0, [])
    blocks = blocks.drop("dims")
    if n:
        def product(q: np.ndarray) -> np.ndarray:
            def part(x: np.ndarray) -> np.ndarray:
                c = centred(x, n, total)
                return c.T @ (c @ q)

            return _summed(blocks, dims, q.shape[1], dims, part) / n

        def squares(x: np.ndarray) -> np.ndarray:
            return (centred(x, n, total) ** 2).sum(0)[:, None]

        trace = float(_summed(blocks, dims, 1, dims, squares).sum() / n)
        values, vectors, error = eigenpairs(product, dims, components)
    else:
        trace, values, vectors, error = 0.0, np.zeros(0), np.zeros((dims, 0)), 0.0
    scaled = vectors / np.sqrt(values)
    if len(values):
        def outer(x: np.ndarray) -> np.ndarray:
            y = centred(x, n, total) @ scaled
            return y.T @ y

        spread = _summed(blocks, dims, len(values), len(values), outer) / n
        off = float(np.abs(spread - np.eye(len(values))).max())
    kind = blocks.schema["keys"].dataType.elementType
    schema = T.StructType([T.StructField(key, kind)] + T.StructType.fromDDL(
        "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, residual double"
    ).fields)

    def run(batches):
        k = len(values)
        for batch in batches if k else ():
            for keys, packed in zip(batch.column("keys"), batch.column("x").to_pylist(), strict=True):
                x = np.frombuffer(packed, "<i8").reshape(-1, dims)
                y, away = centred(x, n, total) @ scaled, deviations(x, n, total)
                rows = len(x)
                repeat = lambda v: pa.array(np.full(rows * k, v))
                yield pa.RecordBatch.from_arrays([
                    keys.values.take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                    repeat(np.int64(n)),
                    away.take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(y.ravel()),
                    pa.array(np.tile(values / trace, rows)),
                    repeat(off), repeat(error),
                ], names=schema.names)

    return blocks.mapInArrow(run, schema)


def deviations(x: np.ndarray, n: int, total: list[int]) -> pa.Array:
    """Sum over dimensions of (n x - S) squared, in whole numbers; null beyond a long."""
    low, high = x.min(0), x.max(0)
    far = max(max(abs(n * int(a) - t), abs(n * int(b) - t)) for a, b, t in zip(low, high, total, strict=True))
    if far * far * len(total) <= MOST_LONG and n * int(max(abs(low).max(), abs(high).max())) <= MOST_LONG:
        d = x * np.int64(n) - np.array(total, "i8")
        return pa.array((d * d).sum(1))
    exact = ((x.astype(object) * n - np.array(total, object)) ** 2).sum(1)
    return pa.array([int(v) if v <= MOST_LONG else None for v in exact], pa.int64())
