"""Whitening of embeddings: a distributed centred scatter, and cyclic Jacobi rotations of it on the driver.

Components become whole numbers, x = floor(scale * c), so counts and sums are exact. The fit list is each distinct x once. Its mean is
known before anything is multiplied: a second pass sums the products of centred rows block by block, and the blocks' matrices are
added by cell in Spark, so that one symmetric matrix reaches the driver, whatever the number of rows. There, rotations in the plane
of each pair of dimensions take turns, until no off-diagonal cell is more than rounding beside the diagonal cells of its row and column. Judging a cell
by its own diagonal, and not by the largest, is what keeps small eigenvalues accurate. The sorted
eigenvectors over the roots of their eigenvalues are the whitening matrix, which is broadcast. What the whitened fit list's covariance
lacks to the identity is measured in one more pass, and not assumed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import cut

#: Rows whose products are summed at once.
ROWS = 4096
#: Sweeps over all pairs at most; some ten are enough for any matrix of a few thousand dimensions.
SWEEPS = 60
EPS = float(np.finfo(float).eps)


def jacobi(symmetric: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a symmetric matrix, by cyclic Jacobi rotations."""
    a = np.array(symmetric, float)
    n = len(a)
    vectors = np.eye(n)
    for _ in range(sweeps):
        turned = False
        for p in range(n - 1):
            for q in range(p + 1, n):
                off = a[p, q]
                if off == 0 or abs(off) <= EPS * np.sqrt(abs(a[p, p])) * np.sqrt(abs(a[q, q])):
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * off)
                t = 1 / (abs(theta) + np.hypot(theta, 1)) * (1 if theta >= 0 else -1)
                c = 1 / np.hypot(t, 1)
                s = t * c
                rp, rq = a[p].copy(), a[q].copy()
                a[p], a[q] = c * rp - s * rq, s * rp + c * rq
                a[:, p], a[:, q] = a[p], a[q]
                a[p, p], a[q, q] = rp[p] - t * off, rq[q] + t * off
                a[p, q] = a[q, p] = 0.0
                vp = vectors[:, p].copy()
                vectors[:, p], vectors[:, q] = c * vp - s * vectors[:, q], s * vp + c * vectors[:, q]
        if not turned:
            break
    values = np.diag(a)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


@dataclass(frozen=True)
class Whitening:
    """What rows of one dimension are whitened with: `n` distinct rows with the sums `total`, `matrix` (dim, components), and the whole trace's shares."""

    n: int
    total: list[int]
    matrix: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([t // self.n + (t % self.n) / self.n for t in self.total])

    def apply(self, x: np.ndarray) -> np.ndarray:
        """(rows, components), row by row, so that equal rows have equal results wherever they stand."""
        centred = x - self.mean
        return np.stack([(centred * w).sum(1) for w in np.ascontiguousarray(self.matrix.T)], 1) if self.matrix.shape[1] else np.zeros((len(x), 0))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sums of (n * x - total) squared; None for one that 64 bits don't hold."""
        most = self.n * max(1, int(np.abs(x).max(initial=0))) + max(map(abs, self.total))
        if most * most * max(1, x.shape[1]) < 2**63:
            own = self.n * x - np.array(self.total, np.int64)
            return (own * own).sum(1).tolist()
        exact = (sum((self.n * int(v) - t) ** 2 for v, t in zip(row, self.total, strict=True)) for row in x)
        return [d if d < 2**63 else None for d in exact]


def whole_vectors(vectors: DataFrame, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>): floor(scale * c) of each component c. Left out are null and empty vectors, and those with a component that is null, not finite,
    or that 64 bits don't hold when scaled. Rows without an id, and repeated rows, are rows."""
    c = F.col(f"`{vector_col}`")
    sound = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * scale) < 2.0**62))
    found = vectors.filter(sound & (F.size(c) > 0)).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), c.alias("c"))
    return found.select("vec_id", F.transform("c", lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("x"))


def centred_scatter(fit: DataFrame, means: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The sum of the products of centred rows, for each dimension (a symmetric matrix each)."""
    shared = fit.sparkSession.sparkContext.broadcast(means)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {d: np.zeros((d, d)) for d in shared.value}
        for rows in frames:
            for d, at in rows.groupby("dim").indices.items():
                for k in range(0, len(at), ROWS):
                    centred = np.stack(rows["x"].to_numpy()[at[k : k + ROWS]]) - shared.value[d]
                    sums[d] += centred.T @ centred
        for d, own in sums.items():
            i, j = np.triu_indices(d)
            if own.any():
                yield pd.DataFrame({"dim": d, "i": i, "j": j, "s": own[i, j]})

    cells = fit.mapInPandas(run, "dim int, i int, j int, s double").groupBy("dim", "i", "j").agg(F.sum("s").alias("s"))
    out = {d: np.zeros((d, d)) for d in means}
    for r in cells.collect():  # a row for each pair of dimensions
        out[r.dim][r.i, r.j] = out[r.dim][r.j, r.i] = r.s
    return out


def fit_whitening(whole: DataFrame, components: int = 4) -> dict[int, Whitening]:
    """A `Whitening` for each dimension among `whole` (x), fitted on distinct rows. Directions without variance have no component, so there are
    fewer where the fit list has a lower rank: none for a single distinct row. An empty table gives no fits.

    A dimension's matrix has to fit the driver: 8 bytes by its square, for each of the table's dimensions."""
    fit = cut(whole.select("x").distinct().withColumn("dim", F.size("x")))
    counted = {r.dim: r.n for r in fit.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    sums = {d: [0] * d for d in counted}
    # decimals: sums of 64-bit numbers may need more bits
    for r in fit.select("dim", F.posexplode("x").alias("i", "v")).groupBy("dim", "i").agg(F.sum(F.col("v").cast("decimal(19,0)")).alias("s")).collect():
        sums[r.dim][r.i] = int(r.s)
    found = {d: Whitening(n, sums[d], np.zeros((d, 0)), np.zeros(0)) for d, n in counted.items()}
    scatter = centred_scatter(fit, {d: w.mean for d, w in found.items()})
    for d, own in found.items():
        values, vectors = jacobi(scatter[d] / own.n)
        real = values[:components] > d * EPS * max(values[0], 0.0)
        kept, trace = values[:components][real], float(values.sum())
        matrix = vectors[:, :components][:, real] / np.sqrt(kept)
        found[d] = Whitening(own.n, own.total, matrix, kept / trace if trace > 0 else kept)
    errors = identity_errors(fit, found)
    return {d: Whitening(w.n, w.total, w.matrix, w.explained, errors.get(d, 0.0)) for d, w in found.items()}


def identity_errors(fit: DataFrame, found: dict[int, Whitening]) -> dict[int, float]:
    """For each dimension the largest absolute cell of the whitened fit list's covariance less the identity."""
    width = max((w.matrix.shape[1] for w in found.values()), default=0)
    if not width:
        return {}
    z = whitened(fit.select(F.lit(None).cast("long").alias("vec_id"), "x"), found).filter("size(z) > 0")
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    at = lambda i: F.try_element_at("z", F.lit(i + 1))
    # covar_pop subtracts the means before it multiplies
    cells = z.groupBy("dim").agg(*[F.covar_pop(at(i), at(j)).alias(f"c{i}_{j}") for i, j in pairs]).collect()
    return {
        r.dim: max(abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if j < found[r.dim].matrix.shape[1]) for r in cells
    }


def whitened(whole: DataFrame, found: dict[int, Whitening]) -> DataFrame:
    """(vec_id, dim, n, deviation, z array<double>): each row's components, as many as its dimension has."""
    shared = whole.sparkSession.sparkContext.broadcast(found)  # a matrix of some columns and a row of sums for each dimension

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for d, at in rows.groupby(rows["x"].map(len)).indices.items():
                own, x = shared.value[d], np.stack(rows["x"].to_numpy()[at])
                made = own.deviations(x)
                yield pd.DataFrame({"vec_id": rows["vec_id"].iloc[at].astype("Int64"), "dim": d, "n": own.n, "deviation": pd.array(made, "Int64"), "z": list(own.apply(x))})

    return whole.mapInPandas(run, "vec_id long, dim int, n long, deviation long, z array<double>")


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row and component (from 1, by falling eigenvalue).

    Distinct rows are fitted once, and all rows, repeated ones too, are whitened. A row has no result where its
    dimension has no component (see `fit_whitening`). Vectors of different dimensions are fitted apart. See `whole_vectors` for rows that
    are left out; other columns are ignored, and an empty table gives no rows. `deviation` is null where 64 bits don't hold it.
    """
    whole = whole_vectors(vectors, scale, id_col, vector_col)
    found = fit_whitening(whole, components)
    shares = F.create_map(*[F.lit(v) for d, w in found.items() for v in (d, [float(e) for e in w.explained])]) if found else None
    errors = F.create_map(*[F.lit(v) for d, w in found.items() for v in (d, float(w.identity_error))]) if found else None
    out = whitened(whole, found).select("vec_id", "dim", "n", "deviation", F.posexplode("z").alias("at", "whitened"))
    out = out.withColumn("explained", F.get(shares[F.col("dim")], F.col("at")) if found else F.lit(None).cast("double"))
    out = out.withColumn("identity_error", errors[F.col("dim")] if found else F.lit(None).cast("double"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", "explained", "identity_error")
