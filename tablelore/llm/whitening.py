"""Whitening of embeddings by incremental eigendecomposition.

Entries become whole numbers x = floor(256 c). The fit list holds each distinct vector once. Every task keeps the spectrum
of its part of the list, the eigenvalues and eigenvectors of the scatter about the mean, and each further vector is one
centred rank-one update: the secular equation gives the new eigenvalues, equal eigenvalues and directions the vector does
not touch are deflated, and eigenvectors come from a vector refitted to the roots, so that they stay orthogonal. Spectra
are combined by rank-one updates, one per eigenpair of the smaller one and one for the means, in a tree of small groups.
One pass over the list then refines the result: the covariance in that basis, centred exactly, is summed over all tasks
and its eigenvectors (Rayleigh-Ritz) turn the basis. Another pass measures the covariance of whitened vectors.

A spectrum is d * d numbers for vectors of d entries, so neither a task nor the driver ever holds more than a few of them.

Rows whose vector is null, empty, or holds null or non-finite entries are left out, as are vectors of another length
than most distinct vectors have (the longer one, if two lengths are as frequent). Entries beyond 64 bits end at the
largest long. Where the covariance has fewer than four eigenvalues above rounding, ``whitened`` of the other components
is null; ``explained`` is null where all vectors are equal, and ``identity_error`` where no component is left. No rows
give none. Repeated rows are returned each; null ids stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablelore.session import cut_lineage, scratch

from .common import finite

#: Fixed values of the contract.
SCALE, COMPONENTS = 256, 4
#: Vectors that one task folds into its spectrum, spectra that one task combines, and rows held at once.
UPDATES, FAN, BLOCK = 4096, 16, 4096
ROUNDS = 80
_EPS = np.finfo(float).eps
SPECTRUM = "n long, mean array<double>, roots array<double>, basis array<double>"
RESULT = ("vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, "
          "identity_error double")


def secular_roots(poles: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + sum(squares / (poles - t)) for rising poles: the number of the nearest pole and the way from it.

    Each root lies between two poles, the last beyond all. A step solves the equation that has the two poles next to
    the root and the slopes of both sides; a step that leaves the bracket halves it.
    """
    size = len(poles)
    if size == 1:
        return np.zeros(1, int), squares.copy()
    every, last = np.arange(size), size - 1
    gap = np.append(np.diff(poles), squares.sum())
    middle = 1 + (squares[:, None] / ((poles[:, None] - poles) - gap / 2)).sum(axis=0)
    origin = np.where((middle >= 0) | (every == last), every, every + 1)
    away = poles[:, None] - poles[origin]
    low = np.where(origin == every, 0.0, -gap / 2)
    high = np.where(origin == every, np.where(every == last, gap, gap / 2), 0.0)
    at = np.where(middle >= 0, (low + high) / 2, np.where(every == last, 0.75 * gap, (low + high) / 2))
    one = np.minimum(every, last - 1)
    left, cols = every[:, None] <= one, every
    for _ in range(ROUNDS):
        with np.errstate(all="ignore"):
            apart, side, now = away[:, cols] - at[cols], left[:, cols], at[cols]
            terms = squares[:, None] / apart
            slopes = terms / apart
            below, above = np.where(side, terms, 0).sum(axis=0), np.where(side, 0, terms).sum(axis=0)
            rise, fall = np.where(side, slopes, 0).sum(axis=0), np.where(side, 0, slopes).sum(axis=0)
            value = 1 + below + above
            low[cols], high[cols] = np.where(value < 0, now, low[cols]), np.where(value < 0, high[cols], now)
            k = np.arange(len(cols))
            p, q = apart[one[cols], k], apart[one[cols] + 1, k]
            c = value - p * rise - q * fall
            a = (p + q) * value - p * q * (rise + fall)
            b = p * q * value
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            inner = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            outer = np.where(a >= 0, (a + root) / (2 * c), 2 * b / (a - root))
            new = now + np.where(cols == last, outer, inner)
            new = np.where((new > low[cols]) & (new < high[cols]), new, (low[cols] + high[cols]) / 2)
        going = (np.abs(value) > size * _EPS * (1 + np.abs(below) + np.abs(above))) & (new != now)
        cols = cols[going]
        at[cols] = new[going]
        if not len(cols):
            break
    return origin, at


def rank_one(roots: np.ndarray, basis: np.ndarray, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising eigenvalues and eigenvectors (columns) after adding ``vector`` times itself."""
    part = vector @ basis
    length = float(part @ part)
    if not length:
        return roots, basis
    small = 8 * _EPS * max(float(roots[-1]), length)
    same = np.flatnonzero(np.diff(roots) <= small)
    if len(same):  # turn the eigenvectors of equal eigenvalues, so that the vector touches one of them only
        basis = basis.copy()
        for run in np.split(same, np.flatnonzero(np.diff(same) > 1) + 1):
            span = slice(run[0], run[-1] + 2)
            mirror, norm = part[span].copy(), float(np.linalg.norm(part[span]))
            if norm:
                norm = norm if mirror[-1] >= 0 else -norm
                mirror[-1] += norm
                basis[:, span] -= np.outer(basis[:, span] @ mirror, 2 / (mirror @ mirror) * mirror)
                part[span] = 0
                part[run[-1] + 1] = -norm
    live = np.flatnonzero(np.abs(part) * np.sqrt(length) > small)
    if not len(live):
        return roots, basis
    poles = roots[live]
    origin, way = secular_roots(poles, part[live] ** 2)
    apart = (poles[:, None] - poles[origin]) - way
    between = poles - poles[:, None]
    size = len(live)
    shifted = np.where(np.arange(size)[:, None] > np.arange(size), between, np.roll(between, -1, axis=1))
    shifted[:, -1] = 1
    refitted = np.copysign(np.sqrt(np.abs(np.prod(-apart / shifted, axis=1))), part[live])
    turned = refitted[:, None] / apart
    turned /= np.sqrt((turned * turned).sum(axis=0))
    values, vectors = roots.copy(), basis.copy()
    values[live], vectors[:, live] = poles[origin] + way, basis[:, live] @ turned
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Of ``n`` vectors: mean, rising eigenvalues and eigenvectors of the scatter about it."""

    n: int
    mean: np.ndarray
    roots: np.ndarray
    basis: np.ndarray

    def add(self, vector: np.ndarray) -> None:
        away = vector - self.mean
        self.n += 1
        self.mean = self.mean + away / self.n
        self.roots, self.basis = rank_one(self.roots, self.basis, np.sqrt((self.n - 1) / self.n) * away)

    def join(self, other: Spectrum) -> Spectrum:
        big, small = (self, other) if self.n >= other.n else (other, self)
        roots, basis, away, n = big.roots, big.basis, small.mean - big.mean, big.n + small.n
        for root, direction in zip(small.roots, small.basis.T):
            if root > 0:
                roots, basis = rank_one(roots, basis, np.sqrt(root) * direction)
        roots, basis = rank_one(roots, basis, np.sqrt(big.n * small.n / n) * away)
        return Spectrum(n, big.mean + away * (small.n / n), roots, basis)

    def row(self) -> pa.RecordBatch:
        lists = (self.mean, self.roots, self.basis.ravel())
        return pa.RecordBatch.from_arrays([pa.array([self.n]), *(pa.array([x.tolist()]) for x in lists)], names=["n", "mean", "roots", "basis"])

    @classmethod
    def of(cls, row: dict) -> Spectrum:
        mean = np.array(row["mean"])
        return cls(row["n"], mean, np.array(row["roots"]), np.array(row["basis"]).reshape(len(mean), len(mean)))


@dataclass
class Model:
    """``n`` and exact sums of the fit list, components as columns with their eigenvalues, and what was measured."""

    n: int
    sums: list[int]
    components: np.ndarray
    roots: np.ndarray
    explained: list[float | None]
    identity_error: float | None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _blocks(batches: Iterator[pa.RecordBatch], size: int, name: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            yield part, np.asarray(part.column(name).flatten()).reshape(part.num_rows, size)


def _updates(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum(0, np.zeros(size), np.zeros(size), np.eye(size))
        for _, block in _blocks(batches, size):
            for vector in block.astype(float):
                own.add(vector)
        if own.n:
            yield own.row()
    return run


def _combined(table: pa.Table) -> pa.Table:
    spectra = [Spectrum.of(row) for row in sorted(table.to_pylist(), key=lambda r: r["part"])]
    made = pa.Table.from_batches([reduce(Spectrum.join, spectra).row()])
    return made.append_column("part", pa.array([table.column("part")[0].as_py() // FAN], pa.int64()))


def _sums(size: int, mean: np.ndarray, basis: np.ndarray):
    """Per task the sums of the products of all pairs of coordinates in the basis, and of the coordinates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = basis.shape[1]
        products, total = np.zeros((width, width)), np.zeros(width)
        for _, block in _blocks(batches, size):
            placed = (block - mean) @ basis
            products += placed.T @ placed
            total += placed.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([np.append(products.ravel(), total).tolist()])], names=["sums"])
    return run


def _covariance(fit: DataFrame, n: int, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The covariance of the fit list in the basis, summed over all tasks; the driver gets its entries."""
    parts = fit.mapInArrow(_sums(len(mean), mean, basis), "sums array<double>")
    summed = parts.select(F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value"))
    found = np.array([row.value for row in sorted(summed.collect(), key=lambda r: r["at"])])
    width = basis.shape[1]
    centre = found[width * width:] / n
    return found[:width * width].reshape(width, width) / n - np.outer(centre, centre)


def rounded(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))


def rounded_rows(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id`` and ``x`` of the rows that have a vector of finite numbers."""
    return table.filter(finite(table[vector])).select(table[vec_id].cast("bigint").alias("vec_id"), rounded(table[vector]).alias("x"))


def spectrum(fit: DataFrame, n: int, size: int) -> Spectrum:
    """The spectrum of all vectors ``x``, each of ``size`` entries."""
    tasks = -(-n // UPDATES)
    parts = fit.repartition(tasks, "x").mapInArrow(_updates(size), SPECTRUM)
    level, most = cut_lineage(parts.withColumn("part", F.spark_partition_id().cast("bigint"))), tasks - 1
    while most:
        merged = level.groupBy(F.expr(f"part div {FAN}").alias("near")).applyInArrow(_combined, f"{SPECTRUM}, part long")
        level, most = cut_lineage(merged), most // FAN
    return Spectrum.of(level.first().asDict())


def fit(rows: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The whitening of the distinct vectors of ``rounded_rows``; None if there are none."""
    with scratch(rows.sparkSession, "fit-list") as folder:
        rows.select("x").distinct().write.parquet(folder)
        distinct = rows.sparkSession.read.parquet(folder)
        lengths = distinct.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n"))
        common = lengths.orderBy(F.desc("n"), F.desc("size")).first()
        if common is None:
            return None
        size, n = common["size"], common["n"]
        distinct = distinct.filter(F.size("x") == size)
        entries = distinct.select(F.posexplode("x").alias("at", "value"))
        sums = entries.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total")).collect()
        exact = [int(row.total) for row in sorted(sums, key=lambda r: r["at"])]
        mean = np.array([s / n for s in exact])
        basis, _ = np.linalg.qr(spectrum(distinct, n, size).basis)
        inner = _covariance(distinct, n, mean, basis)
        roots, turned = np.linalg.eigh((inner + inner.T) / 2)
        roots, vectors, trace = roots[::-1][:components], (basis @ turned)[:, ::-1][:, :components], float(np.trace(inner))
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1, 1)
        live = roots > size * _EPS * max(trace, 0)
        error = None
        if live.any():
            found = _covariance(distinct, n, mean, vectors[:, live] / np.sqrt(roots[live]))
            error = float(np.abs(found - np.eye(int(live.sum()))).max())
        explained = [max(float(r), 0.0) / trace if trace > 0 else None for r in roots]
        return Model(n, exact, vectors, np.where(live, roots, 0), explained, error)


def deviations(block: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The sum of (n * x - S)^2 of each row, exactly: in 64 bits where they suffice."""
    most = n * float(np.abs(block.astype(float)).max(initial=0)) + max(map(abs, sums))
    if len(sums) * most * most < 2.0 ** 62:
        away = n * block - np.array(sums)
        return (away * away).sum(axis=1).tolist()
    return [sum((n * x - s) ** 2 for x, s in zip(row, sums)) for row in block.tolist()]


def _project(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, width = model.mean, len(model.roots)
        live = model.roots > 0
        for part, block in _blocks(batches, len(mean)):
            white = np.where(live, (block - mean) @ model.components / np.sqrt(np.where(live, model.roots, 1)), np.nan)
            ids = part.column("vec_id")
            each, rows = np.repeat(np.arange(len(block)), width), len(block) * width
            exact = pa.array([d if d < 10**38 else None for d in deviations(block, model.n, model.sums)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(block))),
                pa.array(np.full(rows, model.n)), exact.take(pa.array(each)), pa.array(white.ravel(), from_pandas=True),
                pa.array(model.explained * len(block), pa.float64()), pa.array([model.identity_error] * rows, pa.float64()),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whitened(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per usable row and component: ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    ``deviation`` is a decimal, exact up to 38 digits and null beyond.
    """
    rows = rounded_rows(table, vec_id, vector)
    model = fit(rows, components)
    if model is None:
        return table.sparkSession.createDataFrame([], RESULT)
    return rows.filter(F.size("x") == len(model.sums)).mapInArrow(_project(model), RESULT)
