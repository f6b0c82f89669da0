"""Embedding whitening by Jacobi-Davidson on matrix-free, distributed centred products.

The covariance V of the fit list (each distinct vector once, divisor n, centred before
multiplying) is never formed. Every product V W of a block W of d-vectors is one Spark
pass: each task adds Xcᵀ(Xc W) of its rows, Xc = X - S/n, and only d x m partial sums per
partition come back. On these products Jacobi-Davidson finds the leading eigenpairs:

- Rayleigh-Ritz on the search space gives Ritz pairs (θ, u) and residuals r = V u - θ u;
- leading pairs whose residual is below `tol` (relative to the largest eigenvalue, near
  double precision) are locked and deflated from the search space;
- for every other wanted pair the projected correction equation
  (I - QQᵀ)(V - θI)(I - QQᵀ) t = -r, Q = [locked vectors, u], is solved approximately by
  MINRES; the wanted pairs run their MINRES in lockstep, so one pass serves all of them;
- the corrections, made orthogonal, expand the search space; it restarts from its best
  Ritz vectors when it exceeds `4 k` columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postlake.llm.words import map_texts
from postlake.sources.scratch import cut_lineage

#: Components returned at most.
COMPONENTS = 16
#: Scale and shift of entries: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Residual norms below TOL times the largest eigenvalue count as converged.
TOL = 1e-12
#: MINRES steps per correction equation, and outer steps at most.
INNER, OUTER = 8, 200

OUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
       "identity_error double")


def valid_vectors(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x (array<long>) of rows whose vector is present, of the table's dimension, and finite.

    The dimension is the most common vector length (the longer on ties); rows of another
    length, empty vectors, NULL vectors and vectors with NULL, NaN or infinite entries take no part.
    """
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("v")).where(
        F.col("v").isNotNull() & (F.size("v") > 0)).where(F.forall("v", finite))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return rows.select("vec_id", F.transform("v", lambda c: c.cast("long")).alias("x")).limit(0)
    dim = lengths[0]["d"]
    x = F.transform("v", lambda c: (F.floor(c.cast("double") * SCALE) + SHIFT).cast("long"))
    return rows.where(F.size("v") == dim).select("vec_id", x.alias("x"))


def whiten(embeddings: DataFrame, components: int = COMPONENTS, tol: float = TOL) -> DataFrame:
    """For each valid row and component up to `components`: vec_id, component, n, deviation,
    whitened, explained, identity_error.

    Components are numbered from 1 by falling eigenvalue; each is a unit vector with its
    largest entry (the first on ties) positive. Components with an eigenvalue not above
    `tol` times the largest (rank below `components`, or one distinct vector) are left out,
    since whitening divides by sqrt(e). Repeated rows each get their own rows; they count
    once in the fit. An empty table or one without valid rows gives no rows.
    """
    spark = embeddings.sparkSession
    rows = valid_vectors(embeddings)
    fit = cut_lineage(rows.select("x").distinct(), "whiten-fit")
    dim_rows = fit.select(F.size("x").alias("d")).limit(1).collect()
    if not dim_rows:
        return spark.createDataFrame([], OUT)
    dim = dim_rows[0]["d"]
    sums = fit.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("x")[k]).alias(f"s{k}") for k in range(dim)]).first()
    n = sums["n"]
    total = [int(sums[f"s{k}"]) for k in range(dim)]
    mean = np.array(total, dtype=np.float64) / n

    apply = centred_products(fit, mean, n)
    trace = apply(np.zeros((dim, 0)), with_trace=True)[1]
    values, vectors = jacobi_davidson(apply, dim, min(components, dim), tol)
    keep = values > tol * max(values.max(initial=0.0), 0.0)
    values, vectors = values[keep], vectors[:, keep]
    if not len(values):
        return spark.createDataFrame([], OUT)
    scaled = vectors / np.sqrt(values)
    check = scaled.T @ apply(scaled)
    identity_error = float(np.abs(check - np.eye(len(values))).max())
    return _project(rows, n, total, mean, values, vectors, trace, identity_error)


def centred_products(fit: DataFrame, mean: np.ndarray, n: int) -> Callable:
    """A function W -> V W over the fit list, one Spark pass each; with_trace also returns trace(V)."""
    def apply(w: np.ndarray, with_trace: bool = False):
        w = np.ascontiguousarray(w, dtype=np.float64)
        width = w.shape[1]

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc = np.zeros((len(mean), width))
            squares = 0.0
            for batch in batches:
                column = batch.column(0)
                if len(column) == 0:
                    continue
                x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(mean))
                centred = x.astype(np.float64) - mean
                acc += centred.T @ (centred @ w)
                squares += float(np.einsum("ij,ij->", centred, centred))
            yield pa.RecordBatch.from_arrays([pa.array([np.append(acc.ravel(), squares).tolist()])], names=["p"])

        parts = map_texts(fit.select("x"), partial, "p array<double>").collect()
        total = np.zeros(len(mean) * width + 1)
        for part in parts:
            total += np.array(part["p"])
        product = total[:-1].reshape(len(mean), width) / n
        return (product, total[-1] / n) if with_trace else product
    return apply


def jacobi_davidson(apply: Callable, dim: int, k: int, tol: float = TOL, inner: int = INNER,
                    outer: int = OUTER) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenpairs of the symmetric operator `apply` (d x m -> d x m): values falling, unit vectors.

    Raises RuntimeError where the residuals do not reach `tol` within `outer` steps.
    """
    locked_values: list[float] = []
    locked = np.zeros((dim, 0))
    if k == 0:
        return np.zeros(0), locked
    start = np.random.default_rng(0).standard_normal((dim, k))
    space = _orthonormal(start, locked)
    product = apply(space)
    largest = None
    for _ in range(outer):
        h = space.T @ product
        theta, y = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-theta, kind="stable")
        theta, y = theta[order], y[:, order]
        ritz, ritz_product = space @ y, product @ y
        residual = ritz_product - ritz * theta
        norms = np.linalg.norm(residual, axis=0)
        largest = max(largest or 0.0, abs(theta[0]), *(abs(v) for v in locked_values))
        bound = tol * max(largest, np.finfo(float).tiny)
        need = k - len(locked_values)
        done = 0
        while done < min(need, len(theta)) and norms[done] <= bound:
            done += 1
        if done:
            locked_values += theta[:done].tolist()
            locked = np.hstack([locked, ritz[:, :done]])
        if len(locked_values) >= k:
            break
        space, product = ritz[:, done:], ritz_product[:, done:]
        theta, residual = theta[done:], residual[:, done:]
        active = min(k - len(locked_values), space.shape[1])
        if space.shape[1] + active > max(4 * k, 2 * active):
            space, product = space[:, :max(2 * active, k)], product[:, :max(2 * active, k)]
        # The space is full: Rayleigh-Ritz is exact there, so what is left converged or is zero.
        if space.shape[1] + locked.shape[1] >= dim:
            rest = min(k - len(locked_values), space.shape[1])
            locked_values += theta[:rest].tolist()
            locked = np.hstack([locked, ritz[:, done:done + rest]])
            break
        bases = [np.hstack([locked, space[:, [j]]]) for j in range(active)]
        corrections = minres_lockstep(apply, -residual[:, :active], theta[:active], bases, inner)
        new = _orthonormal(np.hstack([corrections, residual[:, :active]]), np.hstack([locked, space]))
        if new.shape[1] == 0:
            raise RuntimeError("Jacobi-Davidson found no new direction before convergence")
        new = new[:, :max(active, 1)]
        space, product = np.hstack([space, new]), np.hstack([product, apply(new)])
    else:
        raise RuntimeError(f"Jacobi-Davidson did not converge in {outer} steps")
    values = np.array(locked_values[:k])
    vectors = locked[:, :k]
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    # One sign for all rows: the largest entry of each component positive (the first on ties).
    lead = np.argmax(np.abs(vectors), axis=0)
    signs = np.sign(vectors[lead, np.arange(vectors.shape[1])])
    return values, vectors * np.where(signs == 0, 1.0, signs)


def minres_lockstep(apply: Callable, rhs: np.ndarray, theta: np.ndarray, bases: list[np.ndarray],
                    steps: int) -> np.ndarray:
    """Approximate solutions t_j ⊥ Q_j of (I - Q_jQ_jᵀ)(V - θ_j I)(I - Q_jQ_jᵀ) t_j = rhs_j by MINRES.

    All systems step together: each step is one distributed product of all their Lanczos vectors.
    """
    dim, m = rhs.shape
    project = lambda vecs: np.column_stack([vecs[:, j] - bases[j] @ (bases[j].T @ vecs[:, j]) for j in range(m)])
    b = project(rhs)
    beta = np.linalg.norm(b, axis=0)
    safe = np.where(beta > 0, beta, 1.0)
    v, v_old = b / safe, np.zeros_like(b)
    w, w_old, x = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    eta = beta.copy()
    c, c_old, s, s_old = np.ones(m), np.ones(m), np.zeros(m), np.zeros(m)
    live = beta > 0
    for _ in range(steps):
        if not live.any():
            break
        av = project(apply(v) - v * theta)
        alpha = np.einsum("ij,ij->j", v, av)
        v_new = av - v * alpha - v_old * beta
        beta_new = np.linalg.norm(v_new, axis=0)
        v_new = v_new / np.where(beta_new > 0, beta_new, 1.0)
        a0 = c * alpha - c_old * s * beta
        a1 = np.sqrt(a0 ** 2 + beta_new ** 2)
        a2 = s * alpha + c_old * c * beta
        a3 = s_old * beta
        a1_safe = np.where(a1 > 0, a1, 1.0)
        c_new, s_new = a0 / a1_safe, beta_new / a1_safe
        w_new = (v - w_old * a3 - w * a2) / a1_safe
        step = np.where(live & (a1 > 0), c_new * eta, 0.0)
        x = x + w_new * step
        eta = -s_new * eta
        live = live & (beta_new > 0) & (a1 > 0)
        v_old, v, beta = v, v_new, beta_new
        w_old, w = w, w_new
        c_old, c, s_old, s = c, c_new, s, s_new
    return project(x)


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Columns of `block` made orthonormal to `against` and one another (twice); near-dependent ones dropped."""
    kept = []
    basis = against
    for j in range(block.shape[1]):
        col = block[:, j].copy()
        size = np.linalg.norm(col)
        if size == 0:
            continue
        for _ in range(2):
            if basis.shape[1]:
                col -= basis @ (basis.T @ col)
        if np.linalg.norm(col) <= 1e-10 * size:
            continue
        col /= np.linalg.norm(col)
        kept.append(col)
        basis = np.hstack([basis, col[:, None]])
    return np.column_stack(kept) if kept else np.zeros((block.shape[0], 0))


def _project(rows: DataFrame, n: int, total: list[int], mean: np.ndarray, values: np.ndarray,
             vectors: np.ndarray, trace: float, identity_error: float) -> DataFrame:
    """Every valid row times every component, in JVM expressions: deviation exact in decimals."""
    sums = F.array(*[F.lit(s).cast("decimal(38,0)") for s in total])
    gap = F.zip_with(F.transform("x", lambda v: v.cast("decimal(38,0)") * F.lit(n)), sums, lambda a, b: a - b)
    deviation = F.aggregate(gap, F.lit(0).cast("decimal(38,0)"), lambda acc, g: acc + g * g).cast("long")
    centred = F.zip_with("x", F.array(*[F.lit(float(m)) for m in mean]), lambda a, b: a.cast("double") - b)
    parts = []
    for j in range(len(values)):
        unit = F.array(*[F.lit(float(u)) for u in vectors[:, j]])
        dot = F.aggregate(F.zip_with("centred", unit, lambda a, b: a * b), F.lit(0.0), lambda acc, p: acc + p)
        parts.append(F.struct(F.lit(j + 1).alias("component"), (dot / F.lit(float(np.sqrt(values[j])))).alias("whitened"),
                              F.lit(float(values[j] / trace)).alias("explained")))
    out = rows.select("vec_id", "x").withColumn("centred", centred).select(
        "vec_id", deviation.alias("deviation"), F.explode(F.array(*parts)).alias("c"))
    return out.select("vec_id", F.col("c.component").cast("int").alias("component"), F.lit(n).cast("long").alias("n"),
                      "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"),
                      F.lit(identity_error).alias("identity_error"))
