"""Whitening against numpy over all rows at once."""

import math

import numpy as np
import pytest

from timberline.llm.queries import QUERIES
from timberline.llm.whitening import whiten


def usable(v):
    return v is not None and len(v) > 0 and all(e is not None and math.isfinite(e) for e in v)


def plain(rows, most, weighted=True):
    """{(vec_id, component): (n, deviation, whitened up to sign, explained)}, in exact sums."""
    kept = [(i, [math.floor(1024 * float(e)) + 100_000 for e in v]) for i, v in rows if usable(v)]
    fit = [x for _, x in kept] if weighted else [list(t) for t in {tuple(x) for _, x in kept}]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    out = {}
    for i, x in kept:
        off = [n * a - s for a, s in zip(x, sums)]
        for k in range(min(most, len(x))):
            e, axis = values[-1 - k], vectors[:, -1 - k]
            out[i, k + 1] = (n, sum(o * o for o in off), float(np.array(off) / n @ axis) / math.sqrt(e), e / values.sum())
    return out


def compare(got, want):
    assert sorted((r.vec_id, r.component) for r in got) == sorted(want)
    sign = {}
    for r in sorted(got, key=lambda r: -abs(r.whitened)):
        n, deviation, white, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        sign.setdefault(r.component, 1 if r.whitened * white > 0 else -1)
        assert r.whitened * sign[r.component] == pytest.approx(white, rel=1e-7, abs=1e-7)
        assert r.explained == pytest.approx(explained, rel=1e-9)
        assert 0 <= r.identity_error < 1e-9
    assert len({r.identity_error for r in got}) == 1


def test_query(spark):
    path = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    compare(QUERIES["op13_whitening"](spark, path).collect(), plain(rows, 8))


@pytest.mark.parametrize("weighted", [True, False])
def test_copies_and_bad_vectors(spark, weighted):
    rnd = np.random.default_rng(4)
    vectors = [(i, [float(e) for e in rnd.normal(size=5) * [5, 4, 3, 2, 1]]) for i in range(80)]
    vectors += [(100 + i, vectors[i % 3][1]) for i in range(60)]
    # The same whole numbers from other entries.
    vectors += [(200, [math.floor(1024 * e) / 1024 for e in vectors[0][1]])]
    bad = [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0]), (302, [math.nan] * 5), (303, [math.inf, 0.0, 0.0, 0.0, 0.0]), (304, [])]
    rows = [(i, v, 1, "x") for i, v in vectors + bad]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long, dims string").repartition(3)
    got = whiten(table, most=8, weighted=weighted).collect()
    compare(got, plain(vectors, 8, weighted))
    assert max(r.component for r in got) == 5


def test_edges(spark):
    kind = "vec_id long, embedding array<double>"
    assert whiten(spark.createDataFrame([], kind)).count() == 0
    assert whiten(spark.createDataFrame([(1, None), (2, [])], kind)).count() == 0
    # One vector, in several rows: nothing varies.
    rows = whiten(spark.createDataFrame([(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [0.5, 1.0])], kind)).collect()
    assert len(rows) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows} == {(3, 0, None, None, 0.0)}
    # Two lengths, each with a fit; the second component of the first doesn't vary.
    rows = whiten(spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [0.0]), (4, [1.0]), (5, [5.0])], kind)).collect()
    found = {(r.vec_id, r.component): r for r in rows}
    assert found[1, 1].n == 2 and abs(found[1, 1].whitened) == pytest.approx(1) and found[1, 2].whitened is None and found[5, 1].n == 3
    assert all(r.identity_error < 1e-12 for r in rows)
    # Far entries: the deviation is exact as long as it fits.
    far = {r.vec_id: r.deviation for r in whiten(spark.createDataFrame([(1, [0.0]), (2, [1e5]), (3, [2e5])], kind)).collect()}
    assert far[1] == (3 * 102_400_000) ** 2
    far = {r.vec_id: r.deviation for r in whiten(spark.createDataFrame([(1, [0.0]), (2, [1e8]), (3, [2e8])], kind)).collect()}
    assert far[1] is None and far[2] == 0
    far = whiten(spark.createDataFrame([(1, [-1e300]), (2, [1e300])], kind)).collect()
    assert [abs(r.whitened) for r in far] == pytest.approx([1, 1]) and [r.deviation for r in far] == [None, None]
