"""Whitening of embeddings along principal components found by block Jacobi-Davidson."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vertexloom.llm.common import shield, written

COMPONENTS = 8
#: Entries become whole numbers: floor(SCALE * entry) + SHIFT.
SCALE = 1024
SHIFT = 100_000
#: Entries of this magnitude or more have no place in a 64-bit whole number with room to add.
LARGEST = 2.0**50
#: Components of less than this share of the first one's variance are rounding, not directions.
LEAST_VARIANCE = 1e-12
#: Ritz vectors beside the wanted ones that corrections keep away from.
GUARD = 4
#: Steps of the inner solver, and the share of a residual at which it may stop before.
INNER_STEPS = 8
INNER_TOLERANCE = 0.02
OUTER_STEPS = 100
#: Vectors of a block, at most; blocks of long vectors are smaller by Arrow's bound on bytes.
BLOCK_ROWS = 4096

Product = Callable[[np.ndarray], np.ndarray]


def minres(apply: Product, b: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """Solve ``apply(x) = b`` by minimal residuals, all columns in step, each step one product.

    ``apply`` is symmetric on each column for itself and may be indefinite. Stops after
    ``steps``, or when each column's residual is below ``tolerance`` of where it began.
    """
    tiny = np.finfo(float).tiny
    begin = np.linalg.norm(b, axis=0)
    x, w, w_before = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    r_before, r, y = b, b, b.copy()
    beta_before, beta = np.ones_like(begin), begin.copy()
    d_bar, epsilon, phi_bar = np.zeros_like(begin), np.zeros_like(begin), begin.copy()
    cosine, sine = -np.ones_like(begin), np.zeros_like(begin)
    for step in range(steps):
        v = y / np.maximum(beta, tiny)
        y = apply(v)
        if step:
            y = y - r_before * (beta / beta_before)
        alpha = np.sum(v * y, axis=0)
        y = y - r * (alpha / np.maximum(beta, tiny))
        r_before, r = r, y
        beta_before, beta = np.maximum(beta, tiny), np.linalg.norm(y, axis=0)
        epsilon_before = epsilon
        delta, g_bar = cosine * d_bar + sine * alpha, sine * d_bar - cosine * alpha
        epsilon, d_bar = sine * beta, -cosine * beta
        gamma = np.maximum(np.hypot(g_bar, beta), tiny)
        cosine, sine = g_bar / gamma, beta / gamma
        phi, phi_bar = cosine * phi_bar, sine * phi_bar
        w_before, w = w, (v - w_before * epsilon_before - w * delta) / gamma
        x = x + w * phi
        live = beta > np.finfo(float).eps * begin
        if not live.any() or np.all(~live | (phi_bar <= tolerance * begin)):
            break
    return x


def _orthonormal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Directions of ``new`` beyond ``basis``, orthonormal; those that vanish are left out."""
    for _ in range(3):
        size = np.linalg.norm(new, axis=0)
        new = new[:, size > 0] / size[size > 0]
        new = new - basis @ (basis.T @ new)
        new = new[:, np.linalg.norm(new, axis=0) > 1e-12]
        if not new.shape[1]:
            return new
        u, s, _ = np.linalg.svd(new / np.linalg.norm(new, axis=0), full_matrices=False)
        new = u[:, s > 1e-8]
    return new


def leading_pairs(product: Product, dim: int, count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a symmetric positive semidefinite matrix, and unit eigenvectors.

    Block Jacobi-Davidson. The matrix is known by ``product(U)`` alone. Rayleigh-Ritz in the
    subspace gives the pairs; each wanted one whose residual is above the rounding of the
    products asks for a correction t, orthogonal to all leading Ritz vectors Y, with
    (I-YY')(A-theta)(I-YY') t = -r, solved roughly by :func:`minres`, all pairs at once.
    Pairs that are there stay locked in the basis and ask no more. A full basis shrinks to its
    leading Ritz vectors. At the end the residuals are formed anew from one more product, and
    the search goes on if one isn't small enough.
    """
    count = min(count, dim)
    wanted, most = min(dim, count + GUARD), min(dim, 5 * count + GUARD)
    start = np.random.default_rng(seed).standard_normal((dim, min(dim, 2 * count + GUARD)))
    basis = _orthonormal(start, np.zeros((dim, 0)))
    image = product(basis)
    best, stale = np.inf, 0
    for _ in range(OUTER_STEPS):
        small = basis.T @ image
        values, s = np.linalg.eigh((small + small.T) / 2)
        values, s = values[::-1], s[:, ::-1]
        y = basis @ s[:, :wanted]
        residual = image @ s[:, :wanted] - y * values[:wanted]
        rounding = 8 * np.finfo(float).eps * np.sqrt(dim) * max(values[0], 0.0)
        size = np.linalg.norm(residual[:, :count], axis=0)
        stale = 0 if size.max() < best / 2 else stale + 1
        best = min(best, size.max())
        open_ = np.flatnonzero(size > rounding)
        if not len(open_) or basis.shape[1] == dim or (stale > 8 and best < 10 * rounding):
            x = np.linalg.qr(y[:, :count])[0]
            again = product(x)
            small = x.T @ again
            values, s = np.linalg.eigh((small + small.T) / 2)
            values, x, again = values[::-1], x @ s[:, ::-1], again @ s[:, ::-1]
            if np.linalg.norm(again - x * values, axis=0).max() <= 10 * rounding or (basis.shape[1] == dim and stale > 4):
                return values, x
            basis, image, best = x, again, np.inf  # what is kept of products has drifted
            continue
        shift = values[open_]

        def apply(v: np.ndarray, y: np.ndarray = y, shift: np.ndarray = shift) -> np.ndarray:
            v = v - y @ (y.T @ v)
            v = product(v) - v * shift
            return v - y @ (y.T @ v)

        r = residual[:, open_]
        t = minres(apply, -(r - y @ (y.T @ r)), INNER_STEPS, INNER_TOLERANCE)
        if basis.shape[1] + t.shape[1] > most:
            basis, image = basis @ s[:, : min(2 * count + GUARD, most - t.shape[1])], None
        new = _orthonormal(np.concatenate([t, r], axis=1) if basis.shape[1] + 2 * t.shape[1] <= most else t, basis)
        new = new[:, : dim - basis.shape[1]]
        if image is None:  # products are taken anew rather than combined: no rounding piles up
            basis = np.linalg.qr(np.concatenate([basis, new], axis=1))[0]
            image = product(basis)
        elif new.shape[1]:
            basis, image = np.concatenate([basis, new], axis=1), np.concatenate([image, product(new)], axis=1)
    raise RuntimeError(f"no convergence after {OUTER_STEPS} steps: a residual of {best:.3g} is left")


def _usable(vector) -> F.Column:
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LARGEST))


def _whole(vector) -> F.Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long"))


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    """The whole numbers of a batch as an array, a row a vector."""
    return np.asarray(column.flatten()).reshape(-1, dim)


@dataclass(frozen=True)
class Whitening:
    """A fit: ``n`` vectors, their exact ``sums``, and components by falling variance."""

    n: int
    sums: tuple[int, ...]
    variances: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def dim(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x`` - sums / n: whole means are taken off exactly, then what is left of them."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole) - part

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums over the dimensions of (n * x - sums)^2.

        With w = x - floor(sums / n) and r = sums mod n that is n^2 w.w - 2 n w.r + r.r, whose
        products are 64-bit numbers unless the entries are huge.
        """
        n, whole, rest = self.n, [s // self.n for s in self.sums], [s % self.n for s in self.sums]
        w = x - np.array(whole, np.int64)
        top = int(np.abs(w).max(initial=0))
        if self.dim * max(top, 1) * max(top, n) >= 1 << 63:
            w = w.astype(object)
        ww, wr = (w * w).sum(axis=1), (w * np.array(rest, w.dtype)).sum(axis=1)
        rr = sum(r * r for r in rest)
        return [n * n * int(a) - 2 * n * int(b) + rr for a, b in zip(ww.tolist(), wr.tolist(), strict=True)]


def _total(blocks: DataFrame, dim: int, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``f`` over all blocks: tasks add up theirs, Spark adds the tasks' entry by entry."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block in batch.column(0):
                part = np.ravel(f(np.frombuffer(block.as_buffer(), "<i8").reshape(-1, dim)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["part"])

    parts = blocks.mapInArrow(add, "part array<double>")
    got = parts.select(F.posexplode("part")).groupBy("pos").agg(F.sum("col").alias("v")).collect()
    out = np.zeros(len(got))
    for r in got:
        out[r.pos] = r.v
    return out


def _sums(blocks: DataFrame, dim: int) -> tuple[int, ...]:
    """Exact sums of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dim
        for batch in batches:
            for block in batch.column(0):
                x = np.frombuffer(block.as_buffer(), "<i8").reshape(-1, dim)
                high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                total = [t + (h << 32) + lo for t, h, lo in zip(total, high.tolist(), low.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], ["pos", "v"])

    got = blocks.mapInArrow(add, "pos int, v decimal(38,0)").groupBy("pos").agg(F.sum("v").alias("v")).collect()
    return tuple(int(r.v) for r in sorted(got, key=lambda r: r.pos))


def fit_whitening(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Fit a whitening on the vectors of ``df``; None if there is no vector.

    Vectors as whole numbers are written once as blocks. Every product with the covariance
    matrix, which is never formed, is a Spark job over them: each task centres its blocks,
    multiplies them with the columns asked for and with the result, and the tasks' parts are
    added up by Spark. The driver holds ``dim`` rows of some dozens of columns.

    Defined cases: null vectors and those with null, NaN, infinite or huge entries (2^50 and
    up) are left out; so are those whose length isn't the most frequent one (of equally
    frequent ones the larger) or zero; there are fewer components than asked for if the
    vectors span fewer dimensions, none if all are equal.
    """
    vectors = df.select(df[vector_col].alias("v")).filter(_usable(F.col("v")) & (F.size("v") > 0))
    dim = _dimension(vectors)
    if dim is None:
        return None

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([_rows(batch.column(0), dim).astype("<i8").tobytes()], pa.binary()), pa.array([batch.num_rows], pa.int64())], ["x", "rows"])

    table = written(vectors.filter(F.size("v") == dim).select(_whole(F.col("v")).alias("v")).mapInArrow(block, "x binary, rows long"), "whitening", BLOCK_ROWS, 8)
    n, blocks = table.agg(F.sum("rows").alias("n")).first().n, table.select("x")
    none = Whitening(n, _sums(blocks, dim), np.zeros(0), np.zeros((dim, 0)), 0.0, 0.0)

    def product(u: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            z = none.centred(x)
            return z.T @ (z @ u)

        return _total(blocks, dim, of).reshape(u.shape) / n

    trace = float(_total(blocks, dim, lambda x: np.square(none.centred(x)).sum(axis=0)).sum() / n)
    values, found = leading_pairs(product, dim, components) if trace else (np.zeros(0), np.zeros((dim, 0)))
    kept = values > LEAST_VARIANCE * values[:1].sum()
    model = Whitening(n, none.sums, values[kept], found[:, kept], trace, 0.0)
    if not kept.any():
        return model
    means = _total(blocks, dim, lambda x: model.whitened(x).sum(axis=0)) / n

    def spread(x: np.ndarray) -> np.ndarray:
        w = model.whitened(x) - means
        return w.T @ w

    k = int(kept.sum())
    error = np.abs(_total(blocks, dim, spread).reshape(k, k) / n - np.eye(k)).max()
    return Whitening(n, none.sums, values[kept], found[:, kept], trace, float(error))


def _dimension(vectors: DataFrame) -> int | None:
    sizes = vectors.groupBy(F.size("v").alias("dim")).count()
    row = sizes.orderBy(F.desc("count"), F.desc("dim")).first()
    return row.dim if row else None


def whiten(df: DataFrame, model: Whitening, vector_col: str = "embedding") -> DataFrame:
    """The whitened vectors of ``df`` under a fit, a row each.

    Returns the columns of ``df`` (those that clash with the new names give way) and
    ``deviation`` (decimal(38,0), exact sum over the dimensions of (n * x - sums)^2),
    ``whitened`` (array of double, a component each). Defined cases: rows without a usable
    vector of the fit's length are left out (see :func:`fit_whitening`); repeated rows are
    whitened each; empty input gives no rows.
    """
    inner, col, restored = shield(df)
    kept = inner.filter(_usable(col(vector_col)) & (F.size(col(vector_col)) == model.dim)).withColumn("x", _whole(col(vector_col)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column(batch.num_columns - 1), model.dim)
            new = [
                pa.array([Decimal(v) for v in model.deviations(x)], pa.decimal128(38, 0)),
                pa.array(list(model.whitened(x)), pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*batch.schema.names[:-1], "deviation", "whitened"])

    schema = T.StructType([*inner.schema.fields, T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    out = kept.mapInArrow(each, schema)
    return out.select(*[c for c, n in zip(restored, df.columns, strict=True) if n not in ("deviation", "whitened")], "deviation", "whitened")


def components(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """Whiten the vectors of ``df`` by a fit on themselves, a row for each vector and component.

    Returns the id and ``component`` (from 1, by falling variance), ``n`` (vectors of the
    fit), ``deviation``, ``whitened``, ``explained`` (the component's share of all variance),
    ``identity_error`` (largest entry of the whitened vectors' covariance minus the identity).
    Defined cases: as :func:`fit_whitening` and :func:`whiten`; no vectors, or equal ones
    only, give no rows.
    """
    narrow = df.select(df[id_col].alias("in_id"), df[vector_col].alias("in_vector"))
    model = fit_whitening(narrow, "in_vector", count)
    if model is None or not len(model.variances):
        model = Whitening(1, (0,), np.ones(1), np.ones((1, 1)), 1.0, 0.0)
        narrow = narrow.filter(F.lit(False))
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.variances])
    rows = whiten(narrow, model, "in_vector").select("in_id", "deviation", F.posexplode("whitened").alias("nth", "w"))
    return rows.select(
        F.col("in_id").alias(id_col), (F.col("nth") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"),
        "deviation", F.col("w").alias("whitened"), explained[F.col("nth")].alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
