"""Whitening of embeddings: exact moments, pivoted Cholesky, one-sided Jacobi.

Entries become whole numbers, so sums and products are exact and the covariance is rounded once, at
the end. Its pivoted Cholesky factor is rotated from the right until its columns are orthogonal:
their squared norms are the eigenvalues, the normalised columns the components. Only matrices as
large as the dimension reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidelog.llm.shared import written

#: Steps of an entry, and what is added to it.
STEPS, ADDED = 64, 1_000_000
COMPONENTS = 32
#: Rows whose products are summed at once.
BLOCK = 2048
#: Tasks that add up what the others have summed.
ADDERS = 32
SWEEPS = 60
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lower factor of as many columns as the rank): ``a[order][:, order] = factor @ factor.T``.

    A row counts as dependent where no more of its own diagonal is left than rounding leaves."""
    a, d = a.copy(), len(a)
    order, low, rank = np.arange(d), np.zeros((d, d)), 0
    left, least = a.diagonal().copy(), d * np.finfo(float).eps * a.diagonal()
    for k in range(d):
        free = np.where(left[k:] > least[k:], left[k:], 0.0)
        p = k + int(np.argmax(free))
        if free[p - k] <= 0:
            break
        for x in (order, left, least):
            x[[k, p]] = x[[p, k]]
        low[[k, p], :k] = low[[p, k], :k]
        low[k, k] = np.sqrt(left[k])
        low[k + 1 :, k] = (a[order[k + 1 :], order[k]] - low[k + 1 :, :k] @ low[k, :k]) / low[k, k]
        left[k + 1 :] -= low[k + 1 :, k] ** 2
        rank += 1
    return order, low[:, :rank]


def one_sided_jacobi(factor: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """``factor`` with its columns rotated until all are orthogonal, longest first.

    A round rotates disjoint pairs together; the rounds of a tournament meet every pair once."""
    x = factor.T.copy()  # a row per column
    r = len(x)
    players = np.arange(r + r % 2)
    for _ in range(sweeps):
        turned = False
        for _ in range(len(players) - 1):
            half = len(players) // 2
            i, j = players[:half], players[half:][::-1]
            real = (i < r) & (j < r)
            i, j = i[real], j[real]
            a, b, c = (x[i] ** 2).sum(1), (x[j] ** 2).sum(1), (x[i] * x[j]).sum(1)
            need = np.abs(c) > 1e-15 * np.sqrt(a * b)
            if need.any():
                turned = True
                i, j, a, b, c = i[need], j[need], a[need], b[need], c[need]
                zeta = (b - a) / (2 * c)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                cos = (1 / np.hypot(1.0, t))[:, None]
                sin = cos * t[:, None]
                x[i], x[j] = cos * x[i] - sin * x[j], sin * x[i] + cos * x[j]
            players = np.concatenate((players[:1], players[-1:], players[1:-1]))
        if not turned:
            break
    return x[np.argsort(-(x**2).sum(1), kind="stable")].T


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]  # of the whole-number entries
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # a unit component in each column
    trace: float

    @property
    def floor(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """What the means are above their floors, times n."""
        return np.array([s % self.n for s in self.sums], object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.floor).astype(float) - np.array([r / self.n for r in self.rest])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - sum)^2, exact."""
        small = x - self.floor
        most = (int(np.abs(small).max(initial=0)) + 1) * self.n
        kind = np.int64 if most * most * x.shape[1] < 1 << 62 else object
        return ((self.n * small.astype(kind) - self.rest.astype(kind)) ** 2).sum(1).tolist()


def solved(n: int, sums: list[int], products: list[int], floor: list[int], keep: int) -> Whitening:
    """From exact sums of z and z z', where z is x less the floor of its mean."""
    d = len(sums)
    z = [s - n * m for s, m in zip(sums, floor)]
    cov = np.array([[(n * products[i * d + j] - z[i] * z[j]) / (n * n) for j in range(d)] for i in range(d)])
    order, factor = pivoted_cholesky(cov)
    turned = one_sided_jacobi(factor)[:, :keep]
    values = (turned**2).sum(0)
    vectors = np.zeros_like(turned)
    vectors[order] = turned / np.sqrt(values)
    return Whitening(n, sums, values, vectors, float(np.trace(cov)))


def _rows(batch: pa.RecordBatch, d: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and whole-number entries of a batch's usable vectors, all of length ``d``."""
    c = np.asarray(batch.column("embedding").flatten().to_numpy(zero_copy_only=False), float).reshape(-1, d)
    steps = np.floor(STEPS * c)
    good = np.isfinite(c).all(1) & (np.abs(steps) < 2.0**62).all(1)
    return batch.column("vec_id").filter(pa.array(good)), steps[good].astype(np.int64) + ADDED


def _added(vectors: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], whole: bool) -> list:
    """The sum of ``of``'s flat array over all batches, in two steps that never hold more than one array.

    Arrays of whole numbers hold Python's own, so nothing overflows."""
    parse, kind = (int, object) if whole else (float, float)
    text = lambda x: " ".join(map(repr, x.tolist()))
    read = lambda s: np.array([parse(v) for v in s.split()], kind)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            found = of(batch)
            total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": [text(total)]})

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for s in batch.column("sums").to_pylist():
                total = read(s) if total is None else total + read(s)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": [text(total)]})

    parts = vectors.mapInArrow(first, "sums string").repartition(ADDERS).mapInArrow(second, "sums string")
    found = parts.repartition(1).mapInArrow(second, "sums string").collect()
    return read(found[0]["sums"]).tolist() if found else []


def fit(vectors: DataFrame, d: int, keep: int = COMPONENTS) -> Whitening | None:
    """The whitening of the usable vectors (vec_id, embedding) of length ``d``; None without any."""

    def sums(batch: pa.RecordBatch) -> np.ndarray:
        x = _rows(batch, d)[1]
        kind = np.int64 if int(np.abs(x).max(initial=0)) * max(len(x), 1) < 1 << 62 else object
        return np.append(np.array(x.astype(kind).sum(0).tolist(), object), len(x))

    found = _added(vectors, sums, True)
    if not found or not found[-1]:
        return None
    *totals, n = found
    floor = [s // n for s in totals]
    shift = np.array(floor, np.int64)

    def products(batch: pa.RecordBatch) -> np.ndarray:
        z = _rows(batch, d)[1] - shift
        total = np.zeros(d * d, object)
        for k in range(0, len(z), BLOCK):
            block = z[k : k + BLOCK]
            # a double holds whole numbers below 2^53, so the sums are exact
            exact = int(np.abs(block).max(initial=0)) ** 2 * len(block) < 1 << 53
            part = (block.T.astype(float) @ block.astype(float)).astype(np.int64) if exact else block.T.astype(object) @ block.astype(object)
            total += np.array(part.ravel().tolist(), object)
        return total

    return solved(n, totals, _added(vectors, products, True), floor, keep)


def identity_error(wide: DataFrame, n: int, r: int) -> float:
    """The largest entry, without sign, of the covariance of ``wide``'s column w minus the identity."""

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        w = batch.column("w").flatten().to_numpy(zero_copy_only=False).reshape(-1, r)
        return np.concatenate(((w.T @ w).ravel(), w.sum(0)))

    found = np.array(_added(wide.select("w"), moments, False))
    mean = found[r * r :] / n
    return float(np.abs(found[: r * r].reshape(r, r) / n - np.outer(mean, mean) - np.eye(r)).max())


def whiten(embeddings: DataFrame, keep: int = COMPONENTS) -> DataFrame:
    """A row for each vector and each of its first ``keep`` components (RESULT).

    Vectors that are null, empty, or hold null or non-finite entries, or entries that are no long
    when multiplied by STEPS, take no part. Vectors of another length are whitened on their own,
    with an n of their own. Components without variance (less than rounding leaves) are left out,
    so a table of equal vectors gives no rows, nor does an empty one. Null and repeated ids stay as
    they are; other columns are left out. ``deviation`` is null where it is no long;
    ``deviation_exact`` holds it up to 38 digits.
    """
    spark = embeddings.sparkSession
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.size("embedding") > 0)
    out = spark.createDataFrame([], RESULT)
    for row in vectors.select(F.size("embedding").alias("d")).distinct().orderBy("d").collect():
        own = vectors.where(F.size("embedding") == row["d"])
        model = fit(own, row["d"], keep)
        if model is not None and len(model.values):
            out = out.union(_whiten_length(own, row["d"], model))
    return out


def _whiten_length(vectors: DataFrame, d: int, model: Whitening) -> DataFrame:
    r = len(model.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = _rows(batch, d)
            w = model.whitened(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, r), pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(list(map(str, model.deviations(x))), pa.string()), lists], names=["vec_id", "deviation", "w"])

    wide = written(vectors.mapInArrow(project, "vec_id long, deviation string, w array<double>"), "whitened")
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    error = identity_error(wide, model.n, r)
    rows = wide.select("vec_id", F.col("deviation").alias("_exact"), F.posexplode("w").alias("component", "whitened")).withColumn("component", F.col("component") + 1)
    return rows.select(
        "vec_id", "component", F.lit(model.n).cast("long").alias("n"), F.col("_exact").try_cast("long").alias("deviation"), "whitened",
        F.element_at(explained, F.col("component")).alias("explained"), F.lit(error).alias("identity_error"), F.col("_exact").try_cast("decimal(38,0)").alias("deviation_exact"),
    )
