"""Whitening of embeddings: the leading eigenvectors of their covariance, found by Jacobi-Davidson without forming it.

The driver holds a subspace (dimensions x a few dozen columns); every product with the covariance is one Spark job over
the centred vectors. A round takes Ritz pairs of the subspace, locks those whose residuals have reached double precision, and
widens it by corrections of the others: approximate solutions of (I-QQ')(V-theta I)(I-QQ')t = -r by a few MINRES steps. All
pairs of a round take their MINRES steps side by side, so that a step is one job for all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.arrow import slices
from termloom.tables import cut

#: Bytes of one block of vectors.
BLOCK_BYTES = 2_000_000
#: Residuals as a share of the greatest eigenvalue that count as double precision: rounding of a product is a few units of 2**-52.
PRECISION = 64 * 2.0**-52
#: MINRES steps of a correction, and the share of its residual at which it stops before. A step reads all vectors, as does a round, so few steps and a wide subspace take the fewest reads.
INNER_STEPS, INNER_SHARE = 2, 0.05
#: Columns of the subspace for each pair that is sought, at which it starts again.
COLUMNS_EACH = 8
#: A direction with less than this share of the whole variance counts as having none.
NO_VARIANCE = 1e-12
_EXACT, _FAR = 2**62, 2.0**52

Multiply = Callable[[np.ndarray], np.ndarray]


def whole_vectors(df: DataFrame, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """(vec_id, x array<long>): floor(scale x component) + shift, of the vectors without null or non-finite components.

    Only vectors of the commonest length take part (of lengths equally common, the greatest); empty ones never do.
    Components beyond 2**52 (scaled) count as that. Repeated rows and null ids are rows of their own.
    """
    v = F.col("embedding")
    fit = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    near = lambda c: F.greatest(F.lit(-_FAR), F.least(F.lit(_FAR), c * F.lit(float(scale))))
    rows = df.filter(fit).select("vec_id", F.transform(v, lambda c: F.floor(near(c.cast("double"))).cast("long") + F.lit(shift).cast("long")).alias("x"))
    usual = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return rows.filter(F.size("x") == (usual["width"] if usual else 0))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _sums(x: np.ndarray) -> list[int]:
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    return [int(s) for s in x.sum(axis=0)] if most * len(x) < _EXACT else [sum(map(int, c)) for c in x.T]


def differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - sums as whole numbers: longs where they fit, else Python's."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))), -(-max(map(abs, sums)) // n))
    return n * x - np.array(sums, np.int64) if 2 * n * most < _EXACT else n * x.astype(object) - np.array(sums, object)


def squares(d: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    most = max((abs(int(d.max())), abs(int(d.min()))), default=0) if d.size else 0
    whole = d if most * most * max(1, d.shape[1]) < _EXACT else d.astype(object)
    return [int(s) for s in (whole * whole).sum(axis=1)]


@dataclass(frozen=True)
class Fit:
    """The fit list in blocks (rows, data), with its size, width and per-dimension sums."""

    blocks: DataFrame
    n: int
    width: int
    sums: list[int]

    def total(self, of_block: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over all blocks of what a function makes of a block's centred vectors (an array of one shape)."""
        n, width, sums = self.n, self.width, self.sums

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                for data in batch.column("data"):
                    x = np.frombuffer(data.as_buffer(), np.int64).reshape(-1, width)
                    made = of_block(differences(x, n, sums).astype(np.float64) / n).ravel()
                    held = made if held is None else held + made
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held)), pa.int32()), pa.array(held, pa.float64())], names=["at", "value"])

        rows = self.blocks.select("data").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        out = np.zeros(len(rows))
        for r in rows:
            out[r["at"]] = r["value"]
        return out

    def multiply(self, w: np.ndarray) -> np.ndarray:
        """The covariance times the columns of w."""
        return self.total(lambda b: b.T @ (b @ w)).reshape(w.shape) / self.n

    def trace(self) -> float:
        return float(self.total(lambda b: np.array([np.sum(b * b)]))[0]) / self.n


def fit_list(vectors: DataFrame) -> Fit | None:
    """The fit list of (vec_id, x) with vectors of one length, written once in blocks; None without vectors."""
    first = vectors.select(F.size("x").alias("width")).first()
    if first is None:
        return None
    width = first["width"]
    rows = max(1, BLOCK_BYTES // (8 * width))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            x = _matrix(batch.column("x"), width)
            sums = pa.array([[Decimal(s) for s in _sums(x)]], pa.list_(pa.decimal128(38, 0)))
            yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), sums, pa.array([x.tobytes()], pa.binary())], names=["rows", "sums", "data"])

    blocks = cut(vectors.select("x").mapInArrow(pack, "rows long, sums array<decimal(38,0)>, data binary"), "white-blocks")
    n = blocks.agg(F.sum("rows")).first()[0]
    sums = blocks.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()
    return Fit(blocks, n, width, [int(s) for _, s in sorted((r["at"], r["s"]) for r in sums)])


def minres(rhs: np.ndarray, shift: float, project: Callable[[np.ndarray], np.ndarray], steps: int, share: float) -> Generator[np.ndarray, np.ndarray, np.ndarray]:
    """MINRES for P(V - shift)P t = rhs with rhs in the range of P: yields vectors, is sent V times them, returns t."""
    size = first = np.linalg.norm(rhs)
    t, v, before = np.zeros_like(rhs), rhs / (size or 1.0), np.zeros_like(rhs)
    w, w_before = np.zeros_like(rhs), np.zeros_like(rhs)
    c = c_before = 1.0
    s = s_before = beta = 0.0
    for _ in range(steps if first else 0):
        image = project((yield v) - shift * v)
        alpha = v @ image
        after = image - alpha * v - beta * before
        beta_after = np.linalg.norm(after)
        delta = c * alpha - c_before * s * beta
        rho = np.hypot(delta, beta_after)
        if rho == 0:
            break
        w, w_before = (v - s_before * beta * w_before - (s * alpha + c_before * c * beta) * w) / rho, w
        c_before, c, s_before, s = c, delta / rho, s, beta_after / rho
        t = t + c * size * w
        size = -s * size
        if abs(size) <= share * first or beta_after == 0:
            break
        before, v, beta = v, after / beta_after, beta_after
    return t


def side_by_side(solvers: list[Generator], multiply: Multiply) -> list[np.ndarray]:
    """Runs solvers that ask for products, all products of a step by one call."""
    solved: list[np.ndarray | None] = [None] * len(solvers)
    asked: dict[int, np.ndarray] = {}

    def advance(i: int, image: np.ndarray | None) -> None:
        try:
            asked[i] = solvers[i].send(image)
        except StopIteration as done:
            solved[i] = done.value
            asked.pop(i, None)

    for i in range(len(solvers)):
        advance(i, None)
    while asked:
        order = sorted(asked)
        images = multiply(np.column_stack([asked[i] for i in order]))
        for j, i in enumerate(order):
            advance(i, images[:, j])
    return solved


def _orthonormal(columns: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what the given ones add to the bases in `against`; what adds nothing is left out."""
    kept: list[np.ndarray] = []
    for c in columns.T:
        size = np.linalg.norm(c)
        for _ in range(3):  # each pass takes away what rounding left of the last
            for q in (*against, *([np.column_stack(kept)] if kept else [])):
                c = c - q @ (q.T @ c)
        if np.linalg.norm(c) > 1e-10 * size:
            kept.append(c / np.linalg.norm(c))
    return np.column_stack(kept) if kept else np.zeros((len(columns), 0))


def leading_eigenpairs(multiply: Multiply, width: int, k: int, widest: int = 0, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix that is only multiplied with.

    Pairs are sought two more than asked for, so that none that is wanted hides behind another. widest: columns of
    the subspace at which it starts again from its best Ritz vectors.
    """
    k = min(k, width)
    sought = min(width, k + 2)
    widest = min(width, widest or COLUMNS_EACH * sought)
    random = np.random.default_rng(seed)
    locked, values = np.zeros((width, 0)), []
    basis = _orthonormal(random.standard_normal((width, sought)))
    image = multiply(basis)
    for _ in range(1_000):
        theta, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        turn = turn[:, ::-1]
        theta, basis, image = theta[::-1], basis @ turn, image @ turn
        residuals = image - basis * theta
        residuals -= locked @ (locked.T @ residuals)
        sizes = np.linalg.norm(residuals, axis=0)
        enough = PRECISION * max([abs(x) for x in values[:1]] + [abs(theta[0])], default=0.0)
        done = 0
        while done < len(theta) and len(values) + done < k and sizes[done] <= enough:
            done += 1
        locked, values = np.column_stack([locked, basis[:, :done]]), [*values, *theta[:done]]
        theta, basis, image, residuals, sizes = theta[done:], basis[:, done:], image[:, done:], residuals[:, done:], sizes[done:]
        if len(values) == k:
            order = np.argsort(values)[::-1]
            return np.array(values)[order], locked[:, order]
        aims = [j for j in range(min(len(theta), sought - len(values))) if sizes[j] > enough]
        if basis.shape[1] + len(aims) > widest - len(values):
            keep = max(sought - len(values), 1)
            basis, image = basis[:, :keep], image[:, :keep]
        solvers = []
        for j in aims:
            q = np.column_stack([locked, basis[:, j]])
            project = lambda x, q=q: x - q @ (q.T @ x)
            solvers.append(minres(-project(residuals[:, j]), theta[j], project, INNER_STEPS, INNER_SHARE))
        found = side_by_side(solvers, multiply)
        new = _orthonormal(np.column_stack([*found, *random.standard_normal((0 if found else 1, width))]), locked, basis)
        if not new.shape[1]:  # the corrections add nothing: any direction that is left does
            new = _orthonormal(random.standard_normal((width, 1)), locked, basis)
        if not new.shape[1]:  # there is none: the Ritz pairs are exact, to rounding
            values, locked = [*values, *theta[: k - len(values)]], np.column_stack([locked, basis[:, : k - len(values)]])
            order = np.argsort(values)[::-1]
            return np.array(values)[order], locked[:, order]
        basis, image = np.column_stack([basis, new]), np.column_stack([image, multiply(new)])
    raise ArithmeticError("the eigenvalues did not converge")


def whiten(vectors: DataFrame, k: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of (vec_id, x) as whole_vectors makes them; other columns are ignored.

    A row for each vector and component up to k. deviation: the exact sum over dimensions of (n x - sums)^2, as
    decimal(38,0); null beyond that. whitened: the centred vector on the component's eigenvector over the root of its
    eigenvalue; explained: the eigenvalue's share of the trace; identity_error: the largest absolute entry of
    whitened's covariance minus the identity. Directions without variance (under 1e-12 of the whole) are no
    components, so equal vectors, or one alone, give no rows; nor does an empty table.
    """
    spark, kind = vectors.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    fit = fit_list(vectors)
    trace = fit.trace() if fit else 0.0
    if not trace:
        return spark.createDataFrame([], schema)
    values, vectors_of = leading_eigenpairs(fit.multiply, fit.width, k)
    real = values > NO_VARIANCE * trace
    values, vectors_of = values[real], vectors_of[:, real]
    onto, count = vectors_of / np.sqrt(values), len(values)
    mean = fit.total(lambda b: (b @ onto).sum(axis=0)) / fit.n

    def spread(b: np.ndarray) -> np.ndarray:
        y = b @ onto - mean
        return y.T @ y

    error = float(np.abs(fit.total(spread).reshape(count, count) / fit.n - np.eye(count)).max())
    explained, n, width, sums = values / trace, fit.n, fit.width, fit.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max(1, BLOCK_BYTES // (8 * width))):
            d = differences(_matrix(batch.column("x"), width), n, sums)
            projected = (d.astype(np.float64) / n) @ onto
            deviation = pa.array([Decimal(s) if s < 10**38 else None for s in squares(d)], pa.decimal128(38, 0))
            rows = np.repeat(np.arange(batch.num_rows), count)
            made = [
                batch.column("vec_id").take(pa.array(rows)), pa.array(np.tile(np.arange(1, count + 1), batch.num_rows), pa.int32()), pa.array(np.full(len(rows), n), pa.int64()), deviation.take(pa.array(rows)),
                pa.array(projected.ravel(), pa.float64()), pa.array(np.tile(explained, batch.num_rows), pa.float64()), pa.array(np.full(len(rows), error), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(made, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select("vec_id", "x").mapInArrow(run, schema)
