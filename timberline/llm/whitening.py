"""Embedding whitening: vectors as whole numbers, each distinct one fitted and whitened once.

Vectors become whole numbers, floor(1024 * entry) + 100000. Rows with the same numbers are one group; its
weight in the fit is the number of its rows, or one. Sums are exact; groups are centred, multiplied
by their weights and by themselves (a matrix product in each task), and the small products are added
up. The eigenvectors of the covariance project each distinct vector once; rows join their group's values.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import stage

SCALE, SHIFT = 1024, 100_000
#: Numbers beyond are held at this, where doubles stop being exact.
FARTHEST = 2.0**53
GROUP = ["dims", "k1", "k2"]
#: Entries of vectors that are held at once as doubles.
AT_ONCE = 4_000_000


def whole_numbers(vector: Column) -> Column:
    """floor(1024 * entry) + 100000 of each entry; null where the vector or an entry is missing or not finite."""
    entries = vector.cast("array<double>")
    finite = F.forall(entries, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(entries, lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(FARTHEST)), F.lit(-FARTHEST))) + SHIFT))


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(dims, rows, matrix of whole numbers) of rows with equally many entries, some at a time."""
    for batch in batches:
        dims = batch.column("dims").to_numpy()
        for d in np.unique(dims).tolist():
            own = batch.filter(pa.array(dims == d))
            step = max(1, AT_ONCE // d)
            for k in range(0, own.num_rows, step):
                rows = own.slice(k, step)
                yield d, rows, rows.column("x").flatten().to_numpy().reshape(-1, d)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dims, at, n, total): a task's weights and weighted sums by place in the vector."""
    n: dict[int, int] = {}
    total: dict[int, np.ndarray] = {}
    for d, rows, x in _lots(batches):
        weight = rows.column("weight").to_numpy()
        n[d] = n.get(d, 0) + int(weight.sum())
        wide = int(weight.sum()) * _largest(x) >= 1 << 62
        total[d] = total.get(d, 0) + (weight @ (x.astype(object) if wide else x)).astype(object)
    for d, sums in total.items():
        columns = [pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(np.full(d, n[d])), pa.array(sums.tolist(), pa.decimal128(38))]
        yield pa.RecordBatch.from_arrays(columns, names=["dims", "at", "n", "total"])


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


def _off(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact: in 64 bits where they suffice, else as Python's whole numbers."""
    if n * _largest(x) + max(abs(s) for s in sums) < 1 << 62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n, with one rounding."""
    return (_off(x, n, sums) / n).astype(np.float64)


def _products(fits: dict[int, tuple[int, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(dims, at, row): a task's weighted products of centred vectors, a row of the matrix each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product: dict[int, np.ndarray] = {}
        for d, rows, x in _lots(batches):
            c = _centred(x, *fits[d])
            product[d] = product.get(d, 0) + (c * rows.column("weight").to_numpy()[:, None]).T @ c
        for d, p in product.items():
            row = pa.ListArray.from_arrays(np.arange(0, d * d + 1, d, dtype=np.int32), p.reshape(-1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d)), pa.array(np.arange(d)), row], names=["dims", "at", "row"])

    return run


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, unit eigenvectors as rows, trace), the largest ``most`` by falling eigenvalue."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    return values[::-1][:most], vectors.T[::-1][:most], float(np.trace(covariance))


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum of (n * x - S)^2, exact; none where it doesn't fit in 64 bits."""
    off = _off(x, n, sums)
    if _largest(off) ** 2 * off.shape[1] >= 1 << 62:
        exact = [sum(v * v for v in row) for row in off.tolist()]
        return [v if v < 1 << 63 else None for v in exact]
    return np.square(off).sum(axis=1).tolist()


def _whiten(fits: dict[int, tuple[int, np.ndarray]], axes: dict[int, tuple[np.ndarray, np.ndarray]], most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(group, weight, deviation, w1, w2, ...): each distinct vector projected and scaled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, rows, x in _lots(batches):
            scale, vectors = axes[d]
            white = (_centred(x, *fits[d]) @ vectors.T) * scale
            names = [*GROUP, "weight", "deviation", *(f"w{k + 1}" for k in range(most))]
            none = np.full(len(x), np.nan)
            values = [white[:, k] if k < white.shape[1] else none for k in range(most)]
            arrays = [*(rows.column(c) for c in GROUP), rows.column("weight"), pa.array(_deviation(x, *fits[d]), pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(v, from_pandas=True) for v in values)], names=names)

    return run


def whiten(vectors: DataFrame, most: int = 8, weighted: bool = True, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Components are numbered from 1 by falling eigenvalue of the covariance of the whole-number vectors
    (see ``whole_numbers``), divisor n; n is the number of rows, or of distinct vectors if not
    ``weighted``. deviation is the sum of (n * x - S)^2 (null beyond 64 bits), explained the eigenvalue's
    share of the trace, identity_error the largest entry of the covariance of whitened minus the identity.

    Null vectors and such with null or non-finite entries are left out. Vectors of each length are a fit of
    their own. A component without variance, to rounding, has whitened null and no part in
    identity_error; where nothing varies, explained is null too. Rows that repeat an id, or have none,
    are vectors of their own; vectors without entries and empty tables give no rows. Groups are told apart
    by two 64-bit hashes of their numbers. Numbers beyond 2^53 count as 2^53.
    """
    x = whole_numbers(F.col(vector_col))
    base = vectors.select(F.col(id_col).alias("vec_id"), x.alias("x")).where(F.size("x") > 0)
    base = base.withColumns({"dims": F.size("x").cast("long"), "k1": F.xxhash64("x"), "k2": F.xxhash64(F.lit(1), "x")})
    count = F.count(F.lit(1)) if weighted else F.lit(1).cast("long")
    distinct = stage(base.groupBy(*GROUP).agg(F.any_value("x").alias("x"), count.alias("weight")), "distinct")
    sums = distinct.mapInArrow(_sums, "dims long, at long, n long, total decimal(38,0)").groupBy("dims", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    fits: dict[int, tuple[int, np.ndarray]] = {}
    for r in sums.collect():
        fits.setdefault(r.dims, (r.n, np.zeros(r.dims, object)))[1][r["at"]] = int(r.total)
    rows = distinct.mapInArrow(_products(fits), "dims long, at long, row array<double>")
    entries = rows.select("dims", "at", F.posexplode("row").alias("other", "v")).groupBy("dims", "at", "other").agg(F.sum("v").alias("v"))
    # A matrix of the length squared: what the fit is, however many vectors there are.
    matrices = {d: np.zeros((d, d)) for d in fits}
    for r in entries.collect():
        matrices[r.dims][r["at"], r.other] = r.v / fits[r.dims][0]
    axes, shares = {}, []
    for d, matrix in matrices.items():
        values, vecs, trace = components(matrix, most)
        varied = values > trace * d * np.finfo(float).eps
        with np.errstate(divide="ignore", invalid="ignore"):
            axes[d] = np.where(varied, 1 / np.sqrt(values), np.nan), vecs
        shares += [(d, k + 1, fits[d][0], float(v / trace) if trace > 0 else None) for k, v in enumerate(values)]
    columns = [f"w{k + 1}" for k in range(most)]
    schema = ", ".join(["dims long, k1 long, k2 long, weight long, deviation long", *(f"{c} double" for c in columns)])
    white = stage(distinct.mapInArrow(_whiten(fits, axes, most), schema), "whitened")
    # The covariance of what came out, centred before multiplying.
    weight = F.sum("weight")
    means = white.groupBy("dims").agg(*((F.sum(F.col("weight") * F.col(c)) / weight).alias(f"m_{c}") for c in columns))
    off = {c: F.col(c) - F.col(f"m_{c}") for c in columns}
    wrong = [
        F.coalesce(F.abs(F.sum(F.col("weight") * off[a] * off[b]) / weight - (1.0 if a == b else 0.0)), F.lit(0.0)) for i, a in enumerate(columns) for b in columns[i:]
    ]
    errors = white.join(F.broadcast(means), "dims").groupBy("dims").agg(functools.reduce(F.greatest, wrong).alias("identity_error"))
    spark = vectors.sparkSession
    parts = spark.createDataFrame(shares, "dims long, component int, n long, explained double").join(errors, "dims")
    values = F.posexplode(F.array(*columns)).alias("place", "whitened")
    each = white.select(*GROUP, "deviation", values).withColumn("component", F.col("place") + 1)
    each = each.join(F.broadcast(parts), ["dims", "component"])
    return base.select("vec_id", *GROUP).join(each, GROUP).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
