"""Whitening of embeddings by shifted CholeskyQR: the covariance is never decomposed itself.

The distinct vectors, centred, are the rows of a tall matrix X that stays distributed. A pass
solves each row against the triangular factors found so far and adds up the Gram matrix of
what comes out; its Cholesky factor is the next triangular factor. The first Gram matrix, and
any that has no Cholesky factor, is shifted by a small multiple of the identity, so nearly
dependent columns do no harm. Passes end when the Gram matrix is the identity. The product of
the factors is the R of X = QR, and its singular values and right vectors are the standard
deviations (times the root of n) and the components. Working with R instead of the covariance
keeps variances apart whose ratio is beyond the digits of a double.

Vectors that are null, or hold null or non-finite entries, are dropped. Entries c count as
floor(256 * c), within the range of a long. Vectors shorter than the longest are filled with zeros. Repeated
rows are all returned but fitted once, like all rows of equal vectors. Only components with a variance
above rounding are returned: none of a table with fewer than two distinct vectors. Empty tables give empty
results; other columns aren't read. A deviation beyond a long is null.

The driver holds matrices of dimensions x dimensions only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Vectors that are solved at once.
ROWS = 4096
#: Passes at most; three are enough unless columns are dependent.
PASSES = 12
EPS = float(np.finfo(float).eps) / 2
_WIDTHS = (np.int8, np.int16, np.int32, np.int64)
_LONG = np.iinfo(np.int64)


def packed(x: np.ndarray) -> list[bytes]:
    """Each row of integers as bytes: a byte for the width, then the entries without zeros at the end. Equal vectors give equal bytes."""
    out = []
    most = np.maximum(x.max(axis=1, initial=0), ~x.min(axis=1, initial=0))
    width = np.searchsorted([np.iinfo(w).max for w in _WIDTHS], most)
    for row, w in zip(x, width.tolist(), strict=True):
        ends = np.flatnonzero(row)
        out.append(bytes([w]) + row[: ends[-1] + 1 if len(ends) else 0].astype(_WIDTHS[w]).tobytes())
    return out


def unpacked(keys: list[bytes], size: int) -> np.ndarray:
    x = np.zeros((len(keys), size), np.int64)
    for i, k in enumerate(keys):
        row = np.frombuffer(k, _WIDTHS[k[0]], offset=1)
        x[i, : len(row)] = row
    return x


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, vector to id, key (the packed integers), size (entries of the vector)."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            vectors = part.column(1)
            sizes = np.where(np.asarray(vectors.is_valid()), np.asarray(vectors.value_lengths().fill_null(0)), 0)
            values = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)  # nulls become NaN
            row = np.repeat(np.arange(len(sizes)), sizes)
            bad = np.asarray(vectors.is_null()) | (np.bincount(row, ~np.isfinite(values), len(sizes)) > 0)
            x = np.zeros((len(sizes), max(1, sizes.max(initial=0))), np.int64)
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = np.floor(256.0 * values)
                whole = np.where(scaled >= 2.0**63, _LONG.max, np.where(scaled < -(2.0**63), _LONG.min, scaled.astype(np.int64)))
            place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            x[row, place] = whole
            keep = np.flatnonzero(~bad)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), pa.array(packed(x[keep]), pa.binary()), pa.array(sizes[keep], pa.int32())], ["id", "key", "size"])


def _chunks(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield unpacked(batch.slice(at, ROWS).column(column).to_pylist(), size)


def sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """How many vectors, and their exact sum in each dimension."""

    def add(batches):
        n, total = 0, [0] * size
        for x in _chunks(batches, "key", size):
            n += len(x)
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)  # neither can overflow in so few rows
            total = [t + (int(h) << 32) + int(w) for t, h, w in zip(total, high, low, strict=True)]
        yield pa.RecordBatch.from_pydict({"j": pa.array([-1, *range(size)], pa.int32()), "s": pa.array([str(v) for v in (n, *total)])})

    rows = fit.select("key").mapInArrow(add, "j int, s string").groupBy("j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    found = {r["j"]: int(r["s"]) for r in rows}
    return found.get(-1, 0), [found.get(j, 0) for j in range(size)]


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - S/n in doubles: the whole part of the mean is taken off as integers."""
    whole = [s // n for s in total]
    rest = np.array([(s - w * n) / n for s, w in zip(total, whole, strict=True)])
    if max(np.abs(x).max(initial=0), max(map(abs, whole), default=0)) < 2**61:
        return (x - np.array(whole, np.int64)).astype(float) - rest
    return (x.astype(object) - np.array(whole, object)).astype(float) - rest


def solve_rows(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The q of q @ r = x for an upper triangular r, a column at a time."""
    q = np.empty_like(x)
    for j in range(len(r)):
        q[:, j] = (x[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def gram(fit: DataFrame, make, size: int) -> np.ndarray:
    """The sum over all vectors x of the outer products of the rows of make(x)."""

    def add(batches):
        total = np.zeros((size, size))
        for x in _chunks(batches, "key", fit_size):
            q = make(x)
            total += q.T @ q
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.repeat(np.arange(size, dtype=np.int32), size)), "j": pa.array(np.tile(np.arange(size, dtype=np.int32), size)), "v": pa.array(total.ravel())})

    fit_size = fit.fit_size
    rows = fit.select("key").mapInArrow(add, "i int, j int, v double").where("j >= i").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((size, size))
    for r in rows:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def triangle(fit: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """The R of the QR decomposition of the centred vectors, by shifted CholeskyQR."""
    size = len(total)
    factors: list[np.ndarray] = []
    product = np.eye(size)
    for k in range(PASSES):

        def make(x, found=tuple(factors)):
            q = centred(x, n, total)
            for r in found:
                q = solve_rows(q, r)
            return q

        g = gram(fit, make, size)
        scale = float(np.linalg.norm(g, 2))
        if not scale:
            return np.zeros((size, size))  # all vectors are equal
        if k and float(np.abs(g - np.eye(size)).max()) < 1e-13 * size:
            break
        shift = 11 * (n * size + size * (size + 1)) * EPS * scale
        shift = min(shift, 1e-3 * scale)  # the bound is loose for very many rows
        try:
            if k == 0:
                raise np.linalg.LinAlgError
            r = np.linalg.cholesky(g).T
            if np.diag(r).min() ** 2 < 64 * size * EPS * scale:
                raise np.linalg.LinAlgError
        except np.linalg.LinAlgError:
            r = np.linalg.cholesky(g + shift * np.eye(size)).T
        factors.append(r)
        product = r @ product
        if k and abs(product).max() and np.linalg.svd(product, compute_uv=False)[-1] < EPS * np.linalg.norm(product, 2) and _settled(g):
            break
    return product


def _settled(g: np.ndarray) -> bool:
    """All eigenvalues of a Gram matrix are 1, or 0 for dependent columns."""
    e = np.linalg.eigvalsh(g)
    return bool(np.minimum(np.abs(e - 1), np.abs(e)).max() < 1e-9)


def components(r: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors as rows, variances, shares of the whole variance) of the components above rounding, by falling variance."""
    _, s, vectors = np.linalg.svd(r)
    there = int((s > 64 * len(r) * EPS * s[0]).sum()) if len(s) and s[0] > 0 else 0
    k = min(most, there)
    vectors = vectors[:k]
    signs = np.sign(vectors[np.arange(k), np.abs(vectors).argmax(axis=1)]) if k else np.ones(0)
    variance = s**2 / n
    return vectors * signs[:, None], variance[:k], variance[:k] / variance.sum() if k else variance[:0]


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sums of (n * x - S)**2 over the dimensions, exact; None beyond a long."""
    most = n * int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) + max(map(abs, total), default=0)
    if most * most * max(1, x.shape[1]) < 2**63:
        return ((n * x - np.array(total, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, total, strict=True)) for row in x.tolist()]
    return [v if v < 2**63 else None for v in exact]


def whiten(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", most: int = 4) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    id_type = dict(vectors.dtypes)[id_col]
    schema = f"id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    made = vectors.select(F.col(id_col).alias("id"), F.col(column).cast("array<double>").alias("v")).mapInArrow(_integers, f"id {id_type}, key binary, size int")
    rows = saved(made, "vectors")
    fit = saved(rows.select("key").distinct(), "fit")
    size = rows.agg(F.max("size").alias("size")).first()["size"] or 0
    if not size:  # no vectors, or none with entries
        return rows.sparkSession.createDataFrame([], schema)
    fit.fit_size = size
    n, total = sums(fit, size)
    axes, variance, explained = components(triangle(fit, n, total), n, most)
    if not len(axes):
        return rows.sparkSession.createDataFrame([], schema)
    turn = axes.T / np.sqrt(variance)
    project = lambda x: centred(x, n, total) @ turn
    again = gram(fit, lambda x: np.column_stack([project(x), np.ones(len(x))]), len(axes) + 1) / n
    mean = again[-1, :-1]
    error = float(np.abs(again[:-1, :-1] - np.outer(mean, mean) - np.eye(len(axes))).max())

    def out(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = unpacked(part.column("key").to_pylist(), size)
                k, w = len(axes), project(x)
                each = pa.array(np.repeat(np.arange(len(x)), k))
                columns = [
                    part.column("id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n)), pa.array(deviations(x, n, total), pa.int64()).take(each),
                    pa.array(w.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("id", "key").mapInArrow(out, schema)


def op11_whitening(vectors: DataFrame) -> DataFrame:
    """vec_id and what ``whiten`` gives for the first four components."""
    return whiten(vectors).withColumnRenamed("id", "vec_id")
