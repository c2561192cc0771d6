"""Whitening of embeddings from an exact scatter matrix.

Vectors are fixed-point integers x.  With n distinct ones and their sums S, the centred vectors y = n x - S are integers
too, and so is their scatter matrix.  Every partition multiplies the residues of y by several primes as matrices of
doubles, which hold such products exactly; the sums of residues are put together by the Chinese remainder theorem.  Only
the eigenvectors, of a matrix of correctly rounded doubles, are floating-point work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import materialize, trimmed, tune

#: Primes are below this: a product of two centred residues is below 2 ** 38, and a sum of ROWS of them below 2 ** 53.
PRIME_BOUND = 1 << 20
#: Rows that are multiplied at once.
ROWS = 1 << 12
_LONG = (1 << 63) - 1


def primes(product: int) -> list[int]:
    """The largest primes below PRIME_BOUND whose product exceeds ``product``."""
    out: list[int] = []
    n, whole = PRIME_BOUND - 1, 1
    while whole <= product:
        if all(n % k for k in range(3, 1025, 2)):
            out.append(n)
            whole *= n
        n -= 2
    return out


def residues(x: np.ndarray, n: int, sums: list[int], p: int) -> np.ndarray:
    """n x - S modulo p, centred at 0, as doubles."""
    y = (x % p * (n % p) - np.array([s % p for s in sums], dtype=np.int64)) % p
    return np.where(y > p // 2, y - p, y).astype(np.float64)


def remainder(parts: dict[int, np.ndarray]) -> np.ndarray:
    """The integers of least absolute value with these residues by primes, as Python integers."""
    whole = 1
    for p in parts:
        whole *= p
    out = sum(r.astype(object) * (whole // p * pow(whole // p, -1, p)) for p, r in parts.items()) % whole
    return np.where(out > whole // 2, out - whole, out)


@dataclass(frozen=True)
class Whitening:
    """What a fit knows: dimensions, number of distinct vectors and their sums (exact), eigenvalues and unit eigenvectors
    (in columns) by falling eigenvalue, the trace, and a bound of the absolute entries of n x - S."""

    dims: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    largest: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact; Python integers where 64 bits don't hold the sum of its squares."""
        if self.dims * self.largest**2 <= _LONG:
            return x * self.n - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def positive(self) -> np.ndarray:
        """Which eigenvalues are above the rounding error of the matrix."""
        return self.values > self.dims * np.finfo(np.float64).eps * max(self.trace, 0.0)

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """Projections over the root of the eigenvalue; NaN for components without variance."""
        scaled = (y / self.n).astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.positive(), scaled @ self.vectors / np.sqrt(self.values), np.nan)


def fixed_point(vector: Column, scale: int) -> Column:
    """floor(scale * c) of every entry, as long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector is there, has entries, and all of them are finite numbers."""
    infinite = F.lit(float("inf"))
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != infinite))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def moments(fit: DataFrame, dims: int) -> tuple[int, list[int], list[int], list[int]]:
    """Number, sums, least and greatest entries of the vectors; sums of high and low halves can't overflow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _rows(batch.column(0), dims)
                columns = [np.arange(dims, dtype=np.int32), np.full(dims, len(x)), (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), x.min(axis=0), x.max(axis=0)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["d", "n", "high", "low", "least", "most"])

    parts = fit.mapInArrow(trimmed(run), "d int, n long, high long, low long, least long, most long")
    found = parts.groupBy("d").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"), F.min("least").alias("least"), F.max("most").alias("most")).orderBy("d").collect()
    return (found[0].n if found else 0), [(r.high << 32) + r.low for r in found], [r.least for r in found], [r.most for r in found]


def scatter(fit: DataFrame, dims: int, n: int, sums: list[int], largest: int) -> np.ndarray:
    """Sum of y y' for y = n x - S over the vectors, exact, as Python integers: a matrix product for each prime and batch."""
    chosen = primes(2 * n * largest**2 + 1)
    upper = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {p: np.zeros((dims, dims), dtype=np.int64) for p in chosen}
        held: list[np.ndarray] = []

        def multiply() -> None:
            x = np.concatenate(held)
            held.clear()
            for at in range(0, len(x), ROWS):
                for p in chosen:
                    y = residues(x[at : at + ROWS], n, sums, p)
                    totals[p] = (totals[p] + (y.T @ y).astype(np.int64)) % p

        any_rows = False
        for batch in batches:
            if len(batch):
                any_rows = True
                held.append(_rows(batch.column(0), dims))
                if sum(map(len, held)) >= ROWS:
                    multiply()
        if held:
            multiply()
        if any_rows:
            for p, total in totals.items():
                columns = [pa.array(np.full(len(upper[0]), p)), pa.array((upper[0] * dims + upper[1]).astype(np.int64)), pa.array(total[upper])]
                yield pa.RecordBatch.from_arrays(columns, names=["p", "cell", "value"])

    cells = fit.mapInArrow(trimmed(run), "p long, cell long, value long").groupBy("p", "cell").agg((F.sum("value") % F.col("p")).alias("value"))
    found = cells.toArrow()
    of, cell, value = (found.column(k).to_numpy() for k in ("p", "cell", "value"))
    parts = {}
    for p in chosen:
        flat = np.zeros(dims * dims, dtype=np.int64)
        flat[cell[of == p]] = value[of == p]
        parts[p] = flat
    whole = remainder(parts).reshape(dims, dims)
    return np.where(np.arange(dims)[:, None] <= np.arange(dims), whole, whole.T)


def fit_whitening(fit: DataFrame, dims: int, components: int) -> Whitening | None:
    """Whitening of the distinct fixed-point vectors ``x`` of ``dims`` entries; None without vectors.

    On the driver are matrices of ``dims`` x ``dims`` only, whatever the number of vectors.
    """
    n, sums, least, most = moments(fit, dims)
    if not n:
        return None
    largest = max(max(n * m - s, s - n * k) for s, k, m in zip(sums, least, most, strict=True))
    whole = scatter(fit, dims, n, sums, largest)
    cube = n**3
    covariance = np.array([[v / cube for v in row] for row in whole.tolist()])  # correctly rounded quotients of integers
    values, vectors = np.linalg.eigh(covariance)
    trace = sum(int(whole[k, k]) for k in range(dims)) / cube
    k = min(components, dims)
    return Whitening(dims, n, sums, values[::-1][:k].copy(), np.ascontiguousarray(vectors[:, ::-1][:, :k]), trace, largest)


def identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit vectors minus the identity; components without variance are left out."""
    shared = fit.sparkSession.sparkContext.broadcast(model)
    used = np.flatnonzero(model.positive()).tolist()
    if not used:
        return None
    names = [f"w{k}" for k in used]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = shared.value.whitened(shared.value.centred(_rows(batch.column(0), shared.value.dims)))
            yield pa.RecordBatch.from_arrays([pa.array(w[:, k]) for k in used], names=names)

    made = fit.mapInArrow(trimmed(run), ", ".join(f"{x} double" for x in names))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    # covar_pop keeps running means, so that values are centred before they are multiplied.
    found = made.agg(*[F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in pairs]).first()
    return max(abs(found[f"{a}_{b}"] - (a == b)) for a, b in pairs)


_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each usable row and component.

    Rows whose vector is null, empty, or holds null or non-finite entries are left out, and so are rows of another length than most
    vectors have (of two lengths equally frequent the greater counts).  Equal vectors count once in the fit; repeated rows and null ids stay
    rows.  ``whitened`` is null for a component without variance, ``explained`` and ``identity_error`` where nothing varies, ``deviation`` where a long does not hold it.  An empty table
    gives an empty result; other columns are not looked at.
    """
    spark = vectors.sparkSession
    tune(spark)
    vector = F.col(vector_col)
    rows = vectors.filter(usable(vector)).select(F.col(id_col).cast("long").alias("vec_id"), fixed_point(vector, scale).alias("x"))
    sizes = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    empty = spark.createDataFrame([], _RESULT)
    if sizes is None:
        return empty
    dims = sizes["size"]
    rows = rows.filter(F.size("x") == dims)
    fit = materialize(rows.select("x").distinct(), "fit-vectors")
    model = fit_whitening(fit, dims, components)
    if model is None:
        return empty
    error = identity_error(fit, model)
    shared = spark.sparkContext.broadcast(model)
    names = [x.split()[0] for x in _RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.values)
        explained = (m.values / m.trace).tolist() if m.trace > 0 else [None] * k
        for batch in batches:
            if not len(batch):
                continue
            y = m.centred(_rows(batch.column(1), m.dims))
            squares = (y * y).sum(axis=1).tolist()
            w = m.whitened(y).ravel()
            size = len(y)
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(size), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                pa.array(np.full(size * k, m.n)),
                pa.array([s if s <= _LONG else None for s in squares for _ in range(k)], pa.int64()),
                pa.array(w, mask=np.isnan(w)),
                pa.array(explained * size, pa.float64()),
                pa.array([error] * (size * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(trimmed(run), _RESULT)
