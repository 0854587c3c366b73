"""Whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred vectors.

The vectors X (one row each, centred) stay on executors as blocks of packed integers. A step takes v, of a vector's
length, from the driver and makes u = X v - beta * u_before in every block, reorthogonalised against all earlier u,
and z = X' u, reorthogonalised against all earlier v. An earlier u is X y with a y of a vector's length that the
driver knows, so no u is ever stored or moved: a block makes those it needs again. What a step returns are sums of
the length of a vector, added up on executors. After as many steps as vectors have dimensions X = U B V' with B upper
bidiagonal; the singular values of B, squared and divided by n, are the variances and V times its right vectors the
components. Where a step finds nothing new (beta or alpha vanish) it starts again from a direction not yet used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ball_tree import usable
from .common import prepare, stage

SCALE, SHIFT, COMPONENTS, BLOCK_ROWS = 64, 1_000_000, 32, 2048
_LEAST = 1e-12  # of the largest: what is below counts as no variance


def integers(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """floor(scale * x) + shift as longs; null where any entry has none."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    return F.when(~F.exists(vector, lambda x: F.abs(x.cast("double")) * scale >= float(1 << 52)), F.transform(whole, lambda x: x + shift))


def _blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """(ids, x): vectors of one length, packed ``block_rows`` at most to a row."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                yield pa.RecordBatch.from_pydict({"ids": pa.array([part.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()), "x": pa.array([part.column("x").flatten().to_numpy().astype("<i8").tobytes()], pa.binary())})

    return rows.select("vec_id", "x").mapInArrow(run, "ids binary, x binary")


def _added(blocks: DataFrame, make) -> np.ndarray:
    """Sum over all blocks of ``make(x)``, an array: once in each task, then on executors by position."""

    def run(batches):
        total = None
        for batch in batches:
            for blob in batch.column("x").to_pylist():
                part = make(np.frombuffer(blob, "<i8"))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(total.size), pa.int32()), "part": pa.array(total.ravel().astype(np.float64))})

    out = blocks.select("x").mapInArrow(run, "at int, part double").groupBy("at").agg(F.sum("part").alias("part")).toArrow().sort_by("at")
    return out["part"].to_numpy()


def exact_sums(blocks: DataFrame, dim: int) -> list[int]:
    """Sum of each dimension, of any size."""

    def run(batches):
        total = [0] * dim
        for batch in batches:
            for blob in batch.column("x").to_pylist():
                x = np.frombuffer(blob, "<i8").reshape(-1, dim)
                for at in range(0, len(x), 512):  # below 2**53 each, so that so many fit a long
                    total = [t + s for t, s in zip(total, x[at : at + 512].sum(0).tolist())]
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(dim), pa.int32()), "part": pa.array([str(t) for t in total])})

    parts = blocks.select("x").mapInArrow(run, "at int, part string").groupBy("at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).collect()
    sums = {r["at"]: int(r["s"]) for r in parts}
    return [sums[i] for i in range(dim)]


class Centre:
    """Centres integer vectors without a rounding error but the last one."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.dim = n, len(sums)
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x.reshape(-1, self.dim) - self.whole).astype(np.float64) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sums)**2, exactly; None beyond a long."""
        d = x.reshape(-1, self.dim) - self.whole
        if self.n * (float(np.abs(d).max(initial=0)) + 1) * np.sqrt(self.dim) < 2**31:
            return ((d * self.n - self.rest) ** 2).sum(1).tolist()
        out = [sum((int(a) * self.n - int(b)) ** 2 for a, b in zip(row, self.rest)) for row in d]
        return [s if s < 1 << 63 else None for s in out]


def bidiagonalise(blocks: DataFrame, centre: Centre, steps: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(singular values of the centred rows, largest first; right singular vectors as columns). One pass a step."""
    d = centre.dim
    steps = min(steps or d, d)
    rng = np.random.default_rng(0)
    v_all, y_all, z_all = (np.zeros((d, steps)) for _ in range(3))
    alpha, beta = np.zeros(steps), np.zeros(steps)

    def orthogonal(v, k):
        for _ in range(2):
            v = v - v_all[:, :k] @ (v_all[:, :k].T @ v)
        return v

    def fresh(k):
        v = orthogonal(rng.standard_normal(d), k)
        return v / np.sqrt(v @ v)

    v, size = fresh(0), 0.0
    for k in range(steps):
        v_all[:, k] = v
        before, ys = beta[k - 1] if k else 0.0, y_all[:, :k]

        def step(x, v=v, ys=ys, before=before, k=k):
            x = centre(x)
            us = x @ ys
            w = x @ v - (before * us[:, k - 1] if k else 0)
            return np.concatenate([[w @ w], us.T @ w, x.T @ w])

        sums = _added(blocks, step)
        ww, c, xw = sums[0], sums[1 : k + 1], sums[k + 1 :]
        length = float(np.sqrt(max(ww - c @ c, 0.0)))
        size = max(size, length)
        z = xw - z_all[:, :k] @ c
        if length > _LEAST * size:
            alpha[k] = length
            y = v - (before * y_all[:, k - 1] if k else 0) - ys @ c
            y_all[:, k], z_all[:, k] = y / length, z / length
            z = orthogonal(z / length - length * v, k + 1)
        else:
            z = np.zeros(d)
        beta[k] = float(np.sqrt(z @ z))
        if k + 1 < steps:
            if beta[k] > _LEAST * size:
                v = z / beta[k]
            else:
                beta[k], v = 0.0, fresh(k + 1)
    b = np.diag(alpha) + np.diag(beta[:-1], 1)
    _, s, right = np.linalg.svd(b)
    return s, v_all @ right.T


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of each vector and component.

    Components are the unit eigenvectors of the covariance (divisor n) of x = floor(scale * c) + shift by falling
    eigenvalue; ``whitened`` is x - mean on the component over the root of its eigenvalue, ``explained`` the
    eigenvalue's share of all variance, ``deviation`` the exact sum of (n * x - sum)**2 (null beyond a long),
    ``identity_error`` the largest absolute entry of whitened's covariance minus the identity.

    Vectors that are null or empty or hold null or non-finite entries, or entries whose x is beyond 2**52, are left out,
    and rows without an id; other rows count as often as they occur. Components without variance (a share of 1e-24 or
    less of the largest) have no whitened value and no rows; so a table of one vector gives none. Vectors of several
    lengths are fitted and whitened each among their own length, one fit for each length.
    """
    spark = vectors.sparkSession
    prepare(spark)
    v = F.col(vector_col)
    rows = vectors.where(F.col(id_col).isNotNull() & usable(v)).select(F.col(id_col).cast("long").alias("vec_id"), integers(v, scale, shift).alias("x")).where("size(x) > 0")
    rows = stage(rows.withColumn("dim", F.size("x")), "vectors")
    out = None
    for dim, n in sorted((r["dim"], r["count"]) for r in rows.groupBy("dim").count().collect()):
        blocks = stage(_blocks(rows.where(F.col("dim") == dim), block_rows), "blocks")
        part = _whitened(blocks, n, dim, components)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], OUTPUT) if out is None else out


OUTPUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whitened(blocks: DataFrame, n: int, dim: int, components: int) -> DataFrame:
    centre = Centre(n, exact_sums(blocks, dim))
    s, axes = bidiagonalise(blocks, centre)
    k = min(components, int((s > _LEAST * max(s[0], 1e-300)).sum()))
    project = axes[:, :k] * (np.sqrt(n) / s[:k])
    trace = float((s * s).sum())
    gap = _added(blocks, lambda x: ((w := centre(x) @ project).T @ w) / n).reshape(k, k) - np.eye(k) if k else np.zeros((0, 0))
    error, explained = float(np.abs(gap).max(initial=0)), s[:k] ** 2 / trace if k else s[:0]

    def run(batches):
        for batch in batches:
            for ids, blob in zip(batch.column("ids").to_pylist(), batch.column("x").to_pylist()):
                ids, x = np.frombuffer(ids, "<i8"), np.frombuffer(blob, "<i8")
                w, m = centre(x) @ project, len(ids)
                columns = [
                    pa.array(np.repeat(ids, k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                    pa.array(centre.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return blocks.mapInArrow(run, OUTPUT)
