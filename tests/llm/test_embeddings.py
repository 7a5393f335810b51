"""Near-duplicate embeddings against all pairs."""

import math

import numpy as np
import pytest

import timberline.llm.embeddings as module
from timberline.llm.embeddings import linked_pairs, near_embeddings, quantised


def plain(rows, threshold=0.93):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        return np.array(v) / np.linalg.norm(v)

    units = [unit(v) if label is not None else None for _, v, label in rows]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if units[a] is not None and units[b] is not None and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]):
                if units[a] @ units[b] >= threshold:
                    n[a] += 1
                    n[b] += 1
                    parent[find(a)] = find(b)
    best = {}
    for i, (d, *_) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), d), d)
    return sorted((d, n[i], best[find(i)]) for i, (d, *_) in enumerate(rows))


@pytest.mark.parametrize("tile", [2048, 7])
def test_links(spark, monkeypatch, tile):
    monkeypatch.setattr(module, "TILE", tile)
    rng = np.random.default_rng(tile)
    rows, ident = [], 0
    for label in (0, 1, 2, None):
        for _ in range(12):
            center = rng.normal(size=16)
            for _ in range(rng.integers(1, 9)):
                rows.append((ident, (center + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.3])).tolist(), label))
                ident += 1
    one = rows[0][1]
    rows += [(9000 + k, one, 0) for k in range(20)] + [(9100, [2 * x for x in one], 0), (9101, one[:8], 0), (9102, None, 0), (9103, [], 1)]
    rows += [(9104, [0.0] * 16, 0), (9105, [-0.0] * 16, 0), (9106, [float("nan")] + one[1:], 0), (9107, [float("inf")] + one[1:], 0)]
    rows += [(9108, [None] + one[1:], 0), (9109, [x * 1e-30 for x in one], 0), (9110, [1.0] + [0.0] * 15, 1), (9111, [1.0] + [-0.0] * 15, 1)]
    frame = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, label int, n_links int").repartition(4)
    got = near_embeddings(frame).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == plain(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_empty_and_null_ids(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert near_embeddings(spark.createDataFrame([], schema)).count() == 0
    got = near_embeddings(spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.1], 1)], schema)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in got if r.vec_id) == [(4, 1, 4)]


def test_bounds():
    """The bound is never below the true product, and few pairs are computed twice."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 64))
    x[300:] = x[:300] + rng.normal(size=(300, 64)) * 0.38
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    q, s, e = quantised(unit)
    product = unit @ unit.T
    bound = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s[None, :]
    assert (np.abs(product - bound) <= e[:, None] + e[None, :] + e[:, None] * e[None, :]).all()
    i, j, recomputed = linked_pairs(x, x, 0.93, True)
    true = np.argwhere(np.triu(product >= 0.93, 1))
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(map(tuple, true.tolist()))
    assert 0 < len(i) <= recomputed < 2 * len(i) + 50
