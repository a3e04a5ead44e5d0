"""Embedding whitening: exact distributed scatter, cyclic Jacobi on the driver, whitening matrix sent to the tasks.

Each entry c becomes the long floor(SCALE * c) + OFFSET; sums and the scatter about the rounded mean are exact integers, whatever the order
in which tasks end, so reruns agree to the last bit:

1. Each task sums its vectors by dimension; Spark adds the partial sums.
2. Each task centres its vectors at the rounded mean and multiplies them in blocks so small that every product sum is exact in a double
   (integers beyond that go through Python's). A task leaves one row per dimension, added up in two steps by (dimension, part of the tasks).
3. The driver gets d rows of d numbers, makes the covariance from them (one rounding per entry) and rotates it by cyclic Jacobi until every off-diagonal entry
   is nothing beside its two diagonal ones, which holds small eigenvalues to full relative accuracy; eigenvectors are sorted by falling eigenvalue.
4. The d x COMPONENTS matrix, bounded by the dimension, goes to the tasks, which whiten all rows; the covariance of what they give is
   measured by a pass of its own.

Vectors that are null, or hold null or non-finite entries, are dropped. The dimension is the most frequent one of the others (of equals the largest);
vectors of other dimensions, empty ones among them, can't be fitted together with it and are dropped too. Entries of 2**52 / SCALE or more in size
count as that much. A null or repeated vec_id is kept, row by row. Components without variance (an eigenvalue under d times the double's precision
of the largest: fewer vectors than dimensions, constant or dependent entries) can't be scaled to variance 1 and have no rows; equal vectors only, or no vectors, give
an empty result. A deviation beyond a long is null. Only the two named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm import bytescan as bs
from sextant.llm.shared import materialize

SCALE, OFFSET, COMPONENTS, MOST, PARTS, LIMB = 64, 1_000_000, 32, 1 << 52, 16, 31
EXACT = 1 << 53  # doubles hold all integers up to here
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(embeddings: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vector of doubles): rows whose vector is there and has finite entries only."""
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))
    rows = embeddings.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    return rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", finite))


def _integers(batches, dim: int | None = None):
    """(ids, rows x d integers without OFFSET) by dimension, or of one only."""
    for ids, vectors in bs.arrow_batches(batches, ["id", "vector"]):
        at = vectors.offsets.to_numpy()
        flat = vectors.values.to_numpy(zero_copy_only=False)
        size = np.diff(at)
        for d in np.unique(size) if dim is None else [dim]:
            some = np.flatnonzero(size == d)
            if len(some):
                entries = flat[at[:-1][some][:, None] + np.arange(d)]
                yield ids.take(pa.array(some)), np.floor(np.clip(SCALE * entries, -MOST, MOST)).astype(np.int64)


def _limbs(values: list[int]) -> tuple[list[int], list[int]]:
    """Integers of any size as high and low parts, which add up without overflow."""
    return [v >> LIMB for v in values], [v & ((1 << LIMB) - 1) for v in values]


def _whole(hi, lo) -> list[int]:
    return [(int(h) << LIMB) + int(m) for h, m in zip(hi, lo, strict=True)]


def _sums(batches):
    found: dict[int, tuple[int, list[int]]] = {}
    for ids, y in _integers(batches):
        n, total = found.get(y.shape[1], (0, [0] * y.shape[1]))
        step = max(1, (1 << 62) // MOST)
        for k in range(0, len(y), step):
            total = [t + int(s) for t, s in zip(total, y[k : k + step].sum(axis=0), strict=True)]
        found[y.shape[1]] = n + len(ids), total
    for d, (n, total) in found.items():
        hi, lo = _limbs(total)
        yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d), pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], names=["d", "k", "n", "hi", "lo"])


def exact_scatter(y: np.ndarray) -> np.ndarray:
    """y' y as Python integers; blocks of rows are multiplied as doubles where that is exact."""
    most = int(np.abs(y).max(initial=0))
    if most * most >= EXACT:
        wide = y.astype(object)
        return wide.T @ wide
    rows = max(1, EXACT // max(1, most * most))
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for k in range(0, len(y), rows):
        part = y[k : k + rows].astype(float)
        total = total + (part.T @ part).astype(np.int64)
    return total


def _scatter(centre: np.ndarray):
    def scatter(batches):
        total = None
        for _, y in _integers(batches, len(centre)):
            part = exact_scatter(y - centre)
            total = part if total is None else total + part
        if total is not None:
            yield from _matrix_rows(total)

    return scatter


def _matrix_rows(total: np.ndarray):
    hi, lo = zip(*(_limbs([int(v) for v in row]) for row in total), strict=True)
    yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(hi, pa.list_(pa.int64())), pa.array(lo, pa.list_(pa.int64()))], names=["i", "hi", "lo"])


def _added(batches):
    """Rows of one i are added; a task holds d sums at most."""
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for i, hi, lo in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            own, low = np.array(hi.values), np.array(lo.values)
            if i in found:
                own, low = found[i][0] + own, found[i][1] + low
            found[i] = own + (low >> LIMB), low & ((1 << LIMB) - 1)  # carried over, so low parts never run over
    if found:
        hi, lo = zip(*found.values(), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(hi, pa.list_(pa.int64())), pa.array(lo, pa.list_(pa.int64()))], names=["i", "hi", "lo"])


def added(partial: DataFrame) -> DataFrame:
    """(i, hi, lo) of any number of tasks -> one row per i, in two steps, so that no task reads a row of every other."""
    tasks = int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "i int, hi array<long>, lo array<long>"
    dealt = partial.withColumn("part", F.spark_partition_id() % PARTS).repartition(tasks, "i", "part").select("i", "hi", "lo")
    return dealt.mapInArrow(_added, schema).repartition(tasks, "i").mapInArrow(_added, schema)


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix by cyclic Jacobi rotations."""
    a, v = matrix.astype(float).copy(), np.eye(len(matrix))
    d = len(a)
    tiny = np.finfo(float).tiny
    for _ in range(sweeps):
        turned = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                if abs(a[p, q]) <= 2.0**-53 * np.sqrt(abs(a[p, p] * a[q, q])) + tiny:
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = 1.0 / (theta + np.copysign(np.hypot(1.0, theta), theta)) if theta else 1.0
                c = 1 / np.hypot(1.0, t)
                s = t * c
                shift = t * a[p, q]
                row_p, row_q = a[p].copy(), a[q].copy()
                a[p], a[q] = c * row_p - s * row_q, s * row_p + c * row_q
                a[:, p], a[:, q] = a[p], a[q]
                a[p, p], a[q, q] = row_p[p] - shift, row_q[q] + shift
                a[p, q] = a[q, p] = 0.0
                v[:, p], v[:, q] = c * v[:, p] - s * v[:, q], s * v[:, p] + c * v[:, q]
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[:, order]


@dataclass
class Whitening:
    """What a fit leaves: n and exact sums (without OFFSET), eigenvalues, eigenvectors, shares of the variance, error measured over the fit list."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def dim(self) -> int:
        return len(self.sums)

    def deviations(self, y: np.ndarray) -> np.ndarray:
        """n * x - S, exact: as longs where these are enough."""
        most = max(int(np.abs(y).max(initial=0)) * self.n, max(map(abs, self.sums), default=0))
        kind = np.int64 if most < 1 << 61 else object
        return y.astype(kind) * self.n - np.array(self.sums, kind)

    def whiten(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations / self.n).astype(float) @ (self.vectors / np.sqrt(self.values))

    def apply(self, rows: DataFrame) -> DataFrame:
        """SCHEMA: a row for each row of usable() with this dimension and each component."""
        model = self

        def apply(batches):
            k = len(model.values)
            for ids, y in _integers(batches, model.dim):
                for a in range(0, len(ids) if k else 0, 1024):
                    off = model.deviations(y[a : a + 1024])
                    small = int(np.abs(off).max(initial=0)) ** 2 * model.dim < 1 << 63
                    square = (off**2).sum(axis=1).tolist() if small else [int(s) if s < 1 << 63 else None for s in (off.astype(object) ** 2).sum(axis=1)]
                    m = len(off)
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.slice(a, m).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                            pa.array(square, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(model.whiten(off).ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, model.identity_error)),
                        ],
                        schema=pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())]),
                    )

        return rows.mapInArrow(apply, SCHEMA)

    def measured_error(self, rows: DataFrame) -> float:
        """Largest absolute entry of (covariance of the whitened values - identity)."""
        model, k = self, len(self.values)

        def products(batches):
            total = np.zeros((k + 1, k))
            for _, y in _integers(batches, model.dim):
                z = model.whiten(model.deviations(y))
                total[:k] += z.T @ z
                total[k] += z.sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k + 1, dtype=np.int32), k)), pa.array(np.tile(np.arange(k, dtype=np.int32), k + 1)), pa.array(total.ravel())], names=["i", "j", "s"])

        found = rows.mapInArrow(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # (components + 1) * components rows
        total = np.zeros((k + 1, k))
        for r in found:
            total[r["i"], r["j"]] = r["s"] / self.n
        return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max(initial=0.0))


def covariance(n: int, sums: list[int], scatter: list[list[int]]) -> np.ndarray:
    """Exact sums and scatter about one integer centre -> covariance, each entry rounded once."""
    return np.array([[(n * scatter[i][j] - sums[i] * sums[j]) / (n * n) for j in range(len(sums))] for i in range(len(sums))])


def fit_whitening(embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """None if no vector can be used."""
    rows = usable(embeddings, id_column, vector_column)
    sums = materialize(rows.mapInArrow(_sums, "d int, k int, n long, hi long, lo long").groupBy("d", "k").agg(F.sum("n").alias("n"), F.sum(F.col("hi").cast("decimal(38,0)")).alias("hi"), F.sum("lo").alias("lo")))
    best = sums.where("k = 0").orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not best:
        return None
    n, dim = best[0]["n"], best[0]["d"]
    found = sums.where(F.col("d") == dim).orderBy("k").collect()  # one row per dimension
    total = _whole([r["hi"] for r in found], [r["lo"] for r in found])
    centre = [(2 * s + n) // (2 * n) for s in total]
    matrix = materialize(added(rows.where(F.size("vector") == dim).mapInArrow(_scatter(np.array(centre)), "i int, hi array<long>, lo array<long>"))).orderBy("i").collect()  # d rows
    v = covariance(n, [s - n * c for s, c in zip(total, centre, strict=True)], [_whole(r["hi"], r["lo"]) for r in matrix])
    values, vectors = jacobi(v)
    some = values[:components] > max(values[0], 0.0) * dim * np.finfo(float).eps
    k = int(some.sum())
    model = Whitening(n, total, values[:k], vectors[:, :k], values[:k] / np.trace(v) if k else values[:0])
    if k:
        model.identity_error = model.measured_error(rows.where(F.size("vector") == dim))
    return model


def whitened(embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """SCHEMA, for each vector that can be used and each of the first components."""
    model = fit_whitening(embeddings, id_column, vector_column, components)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], SCHEMA)
    rows = usable(embeddings, id_column, vector_column)
    return model.apply(rows.where(F.size("vector") == model.dim))


def op11_embedding_whitening(spark, sf_dir):
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
