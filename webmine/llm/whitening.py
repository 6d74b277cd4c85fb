"""Whitening by principal components from Golub-Kahan-Lanczos bidiagonalisation.

Vectors become whole numbers, and each different vector counts once in the fit. With X the centred distinct vectors, the
bidiagonalisation alternates u = X v and v = X' u, both made orthogonal to all earlier ones, until X V = U B with a
small bidiagonal B; the singular values of B, over the root of n, are the deviations along the components V Q.

The left vectors are as long as the table and are never stored: each is X c for a vector c of as many numbers as the
table has dimensions, which the driver keeps. So one distributed pass per step gives all that a step needs: X v, its
products with all earlier u (for the full reorthogonalisation), its norm and X' of it. A pass reads the checkpointed
distinct vectors, sums per task and adds the tasks' sums up in two levels, so what reaches the driver is a few hundred
numbers from each of a bounded number of tasks, and a lost executor costs a step's tasks only. Rows are centred before anything is multiplied.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .vectors import is_finite, matrix, per_length, whole

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
#: Steps before convergence can end the iteration; up to so many dimensions it runs through all of them.
LEAST_STEPS = 128
#: A task of a pass reads at least so many bytes of vectors, where there are as many: the passes are short and many.
TASK_BYTES = 1 << 22
#: From more tasks than this on, their sums are added up by tasks before the driver adds the rest.
DIRECT_ROWS = 64
#: A direction whose variance is below this share of the largest is constant up to rounding.
RANK_SHARE = 1e-12
#: A step whose norm is below this share of the largest has left the range of X.
_BREAK = 1e-11
_TOLERANCE = 1e-14

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Centre:
    """The exact mean S / n of whole vectors, as quotient and remainder, so that centring loses nothing."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.quotient, self.remainder = n, np.array([s // n for s in sums], dtype=np.int64), np.array([s % n for s in sums], dtype=np.int64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S / n in double precision."""
        return (x - self.quotient) - self.remainder / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - S)^2, exact; None where it needs more than 64 bits."""
        y = x - self.quotient
        if (int(np.abs(y).max(initial=0)) + 1) ** 2 * self.n**2 * max(x.shape[1], 1) < 1 << 62:
            return ((self.n * y - self.remainder) ** 2).sum(axis=1).tolist()
        y = self.n * y.astype(object) - self.remainder.astype(object)
        return [s if s < 1 << 63 else None for s in (int(s) for s in (y * y).sum(axis=1))]


def _packed(rows: DataFrame, width: int) -> DataFrame:
    """``(n, kind, x)``: each different vector once, some thousand to a row, as bytes of the narrowest kind that holds them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"), width) - SHIFT
                kind = next(k for k in ("<i2", "<i4", "<i8") if k == "<i8" or np.abs(x).max(initial=0) <= np.iinfo(k).max)
                yield pa.RecordBatch.from_pydict({
                    "n": pa.array([len(x)], pa.int64()), "kind": [kind], "x": pa.array([x.astype(kind).tobytes()], pa.binary()),
                })

    return rows.select("x").distinct().mapInArrow(pack, "n long, kind string, x binary")


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for row in batch.to_pylist():
            yield np.frombuffer(row["x"], row["kind"]).reshape(row["n"], width).astype(np.int64) + SHIFT


def _summed(
    packed: DataFrame, tasks: int, width: int, of_block: Callable[[np.ndarray], np.ndarray], size: int, dtype: type = np.float64
) -> np.ndarray:
    """The sum of ``of_block`` (an array of ``size`` numbers) over all blocks. Each of at most ``tasks`` tasks gives one
    row; where these are many, a second level of tasks, the root of their number, adds them up."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=dtype)
        for batch in batches:
            for part in batch.column("s").to_pylist():
                total += np.frombuffer(part, dtype)
        yield pa.RecordBatch.from_pydict({"s": pa.array([total.tobytes()], pa.binary())})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=dtype)
        for x in _blocks(batches, width):
            total += of_block(x)
        yield pa.RecordBatch.from_pydict({"s": pa.array([total.tobytes()], pa.binary())})

    sums = packed.mapInArrow(work, "s binary")
    if tasks > DIRECT_ROWS:
        sums = sums.repartition(math.ceil(math.sqrt(tasks))).mapInArrow(add, "s binary")
    return sum((np.frombuffer(r.s, dtype) for r in sums.collect()), np.zeros(size, dtype=dtype))


def _orthogonal(r: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """``r`` without its parts along ``basis``, taken out twice."""
    for _ in range(2):
        if basis:
            v = np.stack(basis)
            r = r - v.T @ (v @ r)
    return r


def bidiagonal_components(
    product: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, float, np.ndarray]], width: int, wanted: int
) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, components as columns) of X, the largest ``wanted`` first.

    ``product(C, c)`` gives, for w = X c and U = X C: U'w, w'w and X'w.
    """
    rng = np.random.default_rng(12345)

    def fresh() -> np.ndarray:
        r = _orthogonal(rng.standard_normal(width), basis)
        return r / np.linalg.norm(r)

    basis: list[np.ndarray] = []
    alphas, betas, left, back = [], [], [], []
    v, beta, scale = fresh(), 0.0, 0.0
    while True:
        basis.append(v)
        c = v - beta * left[-1] if left else v.copy()
        u = np.array(left).T if left else np.zeros((width, 0))
        along, square, z = product(u, c)
        rest = square - float(along @ along)
        c, z = c - u @ along, z - (np.array(back).T @ along if back else 0)
        alpha = float(np.sqrt(max(rest, 0.0)))
        scale = max(scale, alpha, beta)
        if alpha <= _BREAK * scale:
            alpha, c, z = 0.0, np.zeros(width), np.zeros(width)
        else:
            c, z = c / alpha, z / alpha
        alphas.append(alpha)
        left.append(c)
        back.append(z)
        k = len(alphas)
        small = np.diag(alphas) + (np.diag(betas, 1) if betas else 0)
        p, sigma, qt = np.linalg.svd(small)
        if k == width:
            break
        r = _orthogonal(z - alpha * v, basis)
        beta = float(np.linalg.norm(r))
        settled = beta * np.abs(p[-1, :wanted]).max() <= _TOLERANCE * max(sigma[0], 1e-300)
        if k >= LEAST_STEPS and k >= 2 * wanted and settled:
            break
        if beta <= _BREAK * scale:
            v, beta = fresh(), 0.0
        else:
            v = r / beta
        betas.append(beta)
    return sigma[:wanted], (np.array(basis).T @ qt.T)[:, :wanted]


def whiten_vectors(
    vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT,
    id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` for every usable row and component.

    ``component``: from 1, by falling variance. ``whitened``: the row's centred vector along the component over its
    deviation. ``explained``: the component's share of the whole variance. ``n``: different vectors of the fit.
    ``deviation``: squared distance from the mean times n^2, exact (NULL where that needs more than 64 bits).
    ``identity_error``: the largest entry of the whitened fit's covariance minus the identity.

    Vectors that are NULL or hold NULL or non-finite components are dropped; all other rows stay, also rows with equal
    or NULL ids. Equal vectors count once in the fit. Directions without variance (below RANK_SHARE of the largest)
    are no components, so a table of one different vector has no rows, nor has an empty one. Equal variances: any
    basis of their space, the same for all rows. Vectors of another length are a collection of their own. Other
    columns are not read.
    """
    v = F.col(vec_col)
    kept = vectors.where(is_finite(v)).select(F.col(id_col).cast("long").alias("vec_id"), whole(v, scale, shift).alias("x"))
    empty = vectors.sparkSession.createDataFrame([], SCHEMA)

    def one_length(rows: DataFrame, width: int) -> DataFrame:
        packed = cut_lineage(_packed(rows, width))
        size = packed.agg(F.sum(F.octet_length("x"))).first()[0] or 0
        tasks = max(1, -(-size // TASK_BYTES))
        packed = packed.coalesce(tasks)
        moments = _summed(packed, tasks, width, lambda x: np.append(x.sum(axis=0), len(x)), width + 1, np.int64).tolist()
        n, centre = moments[-1], Centre(moments[-1], moments[:-1])

        def product(u: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
            k, stacked = u.shape[1], np.column_stack((u, c))

            def of_block(x: np.ndarray) -> np.ndarray:
                y = centre.rows(x)
                w = y @ stacked
                return np.concatenate((w.T @ w[:, -1], y.T @ w[:, -1]))

            got = _summed(packed, tasks, width, of_block, k + 1 + width)
            return got[:k], float(got[k]), got[k + 1 :]

        trace = float(_summed(packed, tasks, width, lambda x: np.array([(centre.rows(x) ** 2).sum()]), 1)[0]) / n if width else 0.0
        if trace == 0:
            return empty
        sigma, basis = bidiagonal_components(product, width, min(components, width))
        e = sigma**2 / n
        keep = e > RANK_SHARE * e[0]
        e, to = e[keep], basis[:, keep] / np.sqrt(e[keep])
        m = len(e)

        def gram(x: np.ndarray) -> np.ndarray:
            w = centre.rows(x) @ to
            return (w.T @ w).ravel()

        identity_error = float(np.abs(_summed(packed, tasks, width, gram, m * m).reshape(m, m) / n - np.eye(m)).max())
        explained = e / trace

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, size = matrix(batch.column("x"), width), batch.num_rows
                row = np.repeat(np.arange(size), m)
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").take(pa.array(row)), pa.array(np.tile(np.arange(1, m + 1), size), pa.int32()),
                    pa.array(np.full(size * m, n), pa.int64()), pa.array(centre.deviations(x), pa.int64()).take(pa.array(row)),
                    pa.array((centre.rows(x) @ to).ravel()), pa.array(np.tile(explained, size)), pa.array(np.full(size * m, identity_error)),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

        return rows.mapInArrow(project, SCHEMA)

    whitened = per_length(kept, "x", one_length)
    return empty if whitened is None else whitened
