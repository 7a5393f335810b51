"""Near-duplicate embeddings: int8 tile products with error bounds, full precision where it matters.

Vectors of one label are dealt into tiles. A task multiplies two tiles as whole numbers: each unit
vector is a scale times int8 values, plus an error whose length is known. The product of two vectors
then differs from the product of their quantised forms by no more than e1 + e2 + e1 * e2, so most
pairs are decided as being below; pairs that may reach the threshold are computed again in
double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import checked_broadcast, components, stage
from timberline.llm.jaccard import _groups

#: Vectors in a tile on average: the memory of a task is that of two tiles and their product.
TILE = 2048


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 values, scale, error) of unit vectors: row = scale * values + rest, |rest| <= error."""
    scale = np.abs(unit).max(axis=1) / 127
    values = np.rint(unit / scale[:, None]).astype(np.int8)
    rest = np.sqrt(np.square(unit - scale[:, None] * values).sum(axis=1))
    return values, scale, rest + 1e-12  # with room for rounding


def level(rows: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that the largest component is about one: the cosine stays as
    it is, and no square of a finite component overflows or vanishes."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])


def linked_pairs(a: np.ndarray, b: np.ndarray, threshold: float, same: bool, rows: int = 512) -> tuple[np.ndarray, np.ndarray, int]:
    """(i, j, recomputed): pairs whose cosine reaches the threshold; i < j where a is b.

    Whole-number products are exact in single precision while dimension * 127^2 stays below 2^24,
    and are made in double precision beyond.
    """
    a, b = level(a), level(b)
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    norms = [np.sqrt(np.square(x).sum(axis=1)) for x in (a, b)]
    (qa, sa, ea), (qb, sb, eb) = quantised(a / norms[0][:, None]), quantised(b / norms[1][:, None])
    left, right = qa.astype(kind), qb.astype(kind).T
    found_i, found_j, recomputed = [], [], 0
    for k in range(0, len(a), rows):
        part = slice(k, k + rows)
        bound = (left[part] @ right).astype(np.float64) * sa[part, None] * sb[None, :]
        bound += ea[part, None] + eb[None, :] + ea[part, None] * eb[None, :]
        i, j = np.nonzero(bound >= threshold)
        i += k
        if same:
            i, j = i[i < j], j[i < j]
        recomputed += len(i)
        for m in range(0, len(i), 1 << 16):
            x, y = i[m : m + (1 << 16)], j[m : m + (1 << 16)]
            good = np.einsum("ij,ij->i", a[x], b[y]) / (norms[0][x] * norms[1][y]) >= threshold
            found_i.append(x[good])
            found_j.append(y[good])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *found_i]), np.concatenate([none, *found_j]), recomputed


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row reachable from each of ``n`` rows."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if (root == before).all():
            return root


def near_embeddings(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept (vec_id = component_id).

    Two vectors link when their labels are equal and not null, their lengths are equal, and their
    cosine in double precision reaches the threshold. Null or zero vectors and such with null or
    non-finite components link with nothing and are their own component. Equal vectors are compared
    once and counted with their number. Rows that repeat an id are vectors of their own with one
    component between them; a row without an id is in no component. An empty table gives no rows.
    """
    base = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("v"),
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0)
    # -0.0 and 0.0 are one value; a class is the vectors of a label that are equal.
    rows = base.withColumn("v", F.when(F.coalesce(usable, F.lit(False)), F.transform("v", lambda x: x + F.lit(0.0))))
    rows = stage(rows.withColumn("d", F.when(F.col("v").isNotNull(), F.size("v"))), "vectors")
    classes = rows.where("v is not null").groupBy("label", "d", "v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    classes = stage(classes.withColumn("key", F.monotonically_increasing_id()), "classes")
    sizes = classes.groupBy("label", "d").agg(F.count(F.lit(1)).alias("size"))
    blocks = sizes.select("label", "d", F.ceil(F.col("size") / TILE).cast("int").alias("blocks"))
    by = ["label", "d", "i", "j"]
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    dealt = (
        classes.join(checked_broadcast(blocks), ["label", "d"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "label", "d", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            (F.col("own") > F.col("other")).cast("int").alias("side"), "key", "copies", "v",
        )
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each class in a pair of tiles: linked vectors of other classes, and a class it reaches."""
        for group in _groups(batches, by):
            d = group.column("d")[0].as_py()
            matrix = group.column("v").combine_chunks().flatten().to_numpy().reshape(-1, d)
            key, copies, side = (group.column(c).to_numpy() for c in ("key", "copies", "side"))
            if group.column("i")[0].as_py() == group.column("j")[0].as_py():
                i, j, _ = linked_pairs(matrix, matrix, threshold, True)
            else:
                left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                i, j, _ = linked_pairs(matrix[left], matrix[right], threshold, False)
                i, j = left[i], right[j]
            links = np.bincount(i, copies[j], len(key)) + np.bincount(j, copies[i], len(key))
            root = _forest(len(key), i, j)
            at = np.flatnonzero(links > 0)
            yield pa.RecordBatch.from_pydict(
                {"key": pa.array(key[at], pa.int64()), "links": pa.array(links[at].astype(np.int64)), "to": pa.array(key[root[at]], pa.int64())}
            )

    ordered = dealt.repartition(*by).sortWithinPartitions(*by)
    found = stage(ordered.mapInArrow(compare, "key long, links long, to long"), "links")
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("key").alias("a"), F.col("to").alias("b")))
    # Components of classes by the smallest id in them.
    named = classes.select("key", "id").join(checked_broadcast(stage(parts, "parts")), F.col("key") == F.col("node"), "left")
    named = named.select("key", "id", F.coalesce("component", "key").alias("part"))
    least = named.groupBy("part").agg(F.min("id").alias("component_id"))
    result = stage(
        classes.join(named.select("key", "part"), "key").join(least, "part").join(counts, "key", "left").select(
            "label", "d", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
        ),
        "found",
    )
    # Only classes that link or repeat need to be looked up again, by the vector itself.
    linked = result.where("n_links > 0").withColumnRenamed("component_id", "part_id")
    out = rows.join(linked, ["label", "d", "v"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("part_id", "vec_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
