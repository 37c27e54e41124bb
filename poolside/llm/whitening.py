"""Embedding whitening by a randomised range finder (op13).

An entry c becomes the long ``floor(64 c) + 1000000``; components are eigenvectors of these longs' covariance.

1. One pass sums the longs and counts rows; sums are exact.
2. A random orthonormal basis of ``components + oversampling`` columns is multiplied by the covariance in a pass over
   all centred rows (each task multiplies its rows with the basis and sums, no covariance is built), and made
   orthonormal again: a power pass. Rayleigh-Ritz on the basis gives components, and the same product their
   residuals, so no pass is for checking alone.
3. If after ``passes`` passes a residual is over ``tolerance`` of its eigenvalue, eigenvalues are too near each other
   for a small basis; it is widened to all dimensions with random columns and passed once more, which is exact.
4. A pass projects all rows and sums the covariance of what comes out; the last gives each row its values.

What goes through the driver is the basis and the sums, of dimension x components numbers, whatever the number of
rows; tasks' sums are added up by a shuffle. The basis comes from a fixed seed, so a repeated run starts alike.

Rows whose vector is null or holds a null or non-finite entry go. A null vec_id stays, as do repeated rows, each with
values of its own; both count for the fit. Shorter vectors are filled up with zeros to the longest one's length.
Entries beyond 2^40 in size count as 2^40, so sums stay exact. Components with no variance (an eigenvalue under
``FLAT`` of the trace) don't exist: equal vectors and a single vector give no rows, nor does an empty table.
Extra columns of any name are not read. A ``deviation`` too large for a long is null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolside.llm.common import staged

#: Scale and shift of entries; components with less than this share of the trace are none.
SCALE, SHIFT, FLAT = 64, 1_000_000, 1e-12
#: Rows that are multiplied at once, and the size beyond which an entry counts as that.
ROWS, MOST = 8192, float(1 << 40)


def whole_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and x (the longs) of the rows whose vectors are whole, of one length."""
    vector = F.col(vector_col)
    whole = df.filter(vector.isNotNull() & F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf"))), F.lit(False)))
    held = F.transform(vector, lambda c: F.floor(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), c.cast("double"))) * SCALE).cast("long") + SHIFT)
    rows = staged(whole.select(F.col(id_col).cast("long").alias("id"), held.alias("x")))
    short, longest = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    return rows if short == longest else rows.select("id", F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(longest) - F.size("x"))).alias("x"))


def matrices(batches, extra: str | None = None):
    """The vectors of batches, some rows at a time; with ``extra``, that column, too."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            column = part.column(part.schema.get_field_index("x"))
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
            yield (x, part.column(part.schema.get_field_index(extra))) if extra else x


def summed(rows: DataFrame, shape: tuple[int, ...], term, kind: str = "double") -> np.ndarray:
    """The sum over all rows of ``term(x)`` (an array of ``shape`` for some rows), added up in tasks and then by a shuffle."""

    def partial(batches):
        total = None
        for x in matrices(batches):
            total = term(x) if total is None else total + term(x)
        if total is not None:
            flat = np.asarray(total).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["cell", "value"])

    cells = rows.select("x").mapInArrow(partial, f"cell int, value {kind}").groupBy("cell").agg(F.sum("value").alias("value"))
    out = np.zeros(int(np.prod(shape)), np.int64 if kind == "long" else np.float64)
    for r in cells.collect():
        out[r["cell"]] = r["value"]
    return out.reshape(shape)


def fit(rows: DataFrame, mean: np.ndarray, n: int, components: int, oversampling: int, passes: int, tolerance: float, seed: int = 7):
    """Eigenvalues (falling), eigenvectors (columns) and the trace of the covariance."""
    d, rng = len(mean), np.random.default_rng(seed)
    wide = min(d, components + oversampling)
    basis = np.linalg.qr(rng.standard_normal((d, wide)))[0]
    for turn in range(passes + 1):

        def term(x, basis=basis):
            y = x - mean
            return np.concatenate([(y.T @ (y @ basis)).reshape(-1), [(y * y).sum()]])

        total = summed(rows, (d * wide + 1,), term) / n
        product, trace = total[:-1].reshape(d, wide), total[-1]
        small = basis.T @ product
        values, turns = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1][:components]
        values, vectors = values[order], basis @ turns[:, order]
        residual = np.linalg.norm(product @ turns[:, order] - vectors * values, axis=0)
        if wide == d or (residual <= tolerance * np.maximum(values, FLAT * trace)).all():
            break
        basis = np.linalg.qr(product)[0]
        if turn + 2 > passes:
            wide = d
            basis = np.linalg.qr(np.concatenate([basis, rng.standard_normal((d, d - basis.shape[1]))], axis=1))[0]
    kept = values > FLAT * trace
    return values[kept], vectors[:, kept], trace


def deviations(x: np.ndarray, sums: np.ndarray, n: int) -> list:
    """Per row the exact sum of (n x - sum)^2; null where a long can't hold it."""
    exact = n * int(np.abs(x).max(initial=0)) + int(np.abs(sums).max(initial=0)) < 1 << 62
    apart = n * x - sums if exact else n * x.astype(object) - sums.astype(object)
    most = int(np.abs(apart).max(initial=0))
    if most * most * max(1, x.shape[1]) >= 1 << 63:
        return [int(v) if v < 1 << 63 else None for v in (apart.astype(object) ** 2).sum(axis=1)]
    return (apart.astype(np.int64) ** 2).sum(axis=1).tolist()


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32, oversampling: int = 16, passes: int = 3, tolerance: float = 1e-10) -> DataFrame:
    """Per row with a whole vector, and component: ``id_col``, component, n, deviation, whitened, explained, identity_error."""
    rows = whole_vectors(df, id_col, vector_col)
    d = rows.select(F.size("x")).first()
    d = d[0] if d else 0
    total = summed(rows, (d + 1,), lambda x: np.concatenate([x.sum(axis=0), [len(x)]]), "long")
    n, sums = int(total[-1]), total[:-1]
    mean = sums / n if n else sums.astype(float)
    values, vectors, trace = fit(rows, mean, n, components, oversampling, passes, tolerance) if n and d else (np.zeros(0), np.zeros((d, 0)), 0.0)
    k = len(values)
    scaled = vectors / np.sqrt(values)

    def spread(x):
        w = (x - mean) @ scaled
        return np.concatenate([w.sum(axis=0), (w.T @ w).reshape(-1)])

    error = 0.0
    if k:
        moments = summed(rows, (k + k * k,), spread) / n
        error = float(np.abs(moments[k:].reshape(k, k) - np.outer(moments[:k], moments[:k]) - np.eye(k)).max())

    def values_of(batches):
        for x, ids in matrices(batches, "id"):
            w = (x - mean) @ scaled
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(w.reshape(-1)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(deviations(x, sums, n), pa.int64()), lists], names=["id", "deviation", "w"])

    shares = F.array(*[F.lit(float(v)) for v in values / trace]) if k else F.array().cast("array<double>")
    out = rows.mapInArrow(values_of, "id long, deviation long, w array<double>") if k else rows.select("id", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("w"))
    return out.select("id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
