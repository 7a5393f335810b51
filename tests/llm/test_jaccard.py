"""The similarity join against all pairs."""

import itertools
import random
import tracemalloc
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest

import timberline.llm.jaccard as module
from timberline.llm.jaccard import differing, set_keys, similar_documents
from timberline.llm.shingles import alike, shingle_sets
from timberline.llm.signature_tree import candidate_pairs, signature


def plain_set(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def components(rows, linked):
    ids = [d for d, _ in rows if d is not None]
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {d: find(d) for d in ids}


def corpus(seed, passage_share=0.3):
    rnd = random.Random(seed)
    texts = [None, "", " \n\t", "one two", "ONE  two", "one two three four", "É one two three four five", "é one two three four five"]
    texts += [" ".join(rnd.choices("abcdefghij", k=rnd.randrange(0, 30))) for _ in range(60)]
    passage = [f"p{i}" for i in range(60)]
    for _ in range(25):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.randrange(8, 200))]
        if rnd.random() < passage_share:
            words += passage
        for _ in range(rnd.choice([1, 1, 2, 5, 12])):
            copy = list(words)
            for _ in range(rnd.randrange(0, 1 + len(words) // 25)):
                copy[rnd.randrange(len(copy))] = f"v{rnd.randrange(10**6)}"
            texts.append(("  " if rnd.random() < 0.3 else " ").join(copy).upper() if rnd.random() < 0.2 else "\n".join(copy))
    texts.append("x " * 30000)
    return [(7 * i + 3, t) for i, t in enumerate(texts)] + [(None, texts[20])]


def want(rows):
    sets = {d: plain_set(t) for d, t in rows if d is not None}
    linked = [
        (a, b) for a, b in itertools.combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    return sets, components(rows, linked)


def test_similar_sets_share_a_key():
    rng = np.random.default_rng(4)
    none = np.array([], np.int64)
    for n in [*range(1, 140), 200, 333, 1000, 5000]:
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        for out in {0, differing(n, 80) // 2, differing(n, 80)}:
            for gone in {0, out // 2, out}:
                left = rng.permutation(a)[: n - gone]
                b = np.unique(np.concatenate((left, rng.integers(0, 1 << 63, out - gone, dtype=np.uint64))))
                if not len(b) or not alike(a, b, 80):
                    continue
                (x, few), (y, _) = set_keys(a, 80, none), set_keys(b, 80, none)
                if few:
                    x, y = (set_keys(s, 80, np.array([n]))[0] for s in (a, b))
                assert len(np.intersect1d(x, y)), (n, out, gone)


@pytest.mark.parametrize("small", [False, True])
def test_join(spark, monkeypatch, small):
    if small:  # wide roots, tiles, salts and no broadcasts, on little data
        for name, value in (("TILE", 3), ("WIDE", 4), ("PARTNERS", 2)):
            monkeypatch.setattr(module, name, value)
        monkeypatch.setattr(module, "checked_broadcast", lambda df: df)
    rows = corpus(11 if small else 12)
    sets, parts = want(rows)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, component_id int").repartition(5)
    got = similar_documents(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), parts[r.doc_id], parts[r.doc_id] == r.doc_id), r


def test_repeated_rows_and_none(spark):
    rows = [(1, "a b c d e f")] * 3 + [(2, "a b c d e f"), (2, "other words altogether here and there")]
    got = similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (1, 1), (2, 1), (2, 2)]
    assert similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trees_lose_nothing():
    rnd = random.Random(5)
    texts = []
    for _ in range(30):
        words = [str(rnd.random()) for _ in range(rnd.randrange(6, 400))]
        for _ in range(rnd.randrange(1, 20)):
            copy = list(words)
            for _ in range(rnd.randrange(0, 6)):
                copy[rnd.randrange(len(copy))] = str(rnd.random())
            texts.append(" ".join(copy))
    sets = shingle_sets(texts, at_once=1000)
    sizes = np.array([len(s) for s in sets])
    side = np.array([rnd.randrange(2) for _ in sets])
    marks = [signature(s) for s in sets]
    linked = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if alike(sets[a], sets[b], 80)}
    pairs = {tuple(sorted(p)) for p in candidate_pairs(marks, sizes, 80).tolist()}
    assert linked <= pairs and len(pairs) < len(sets) ** 2 / 8
    across = {tuple(sorted(p)) for p in candidate_pairs(marks, sizes, 80, side).tolist()}
    assert {(a, b) for a, b in linked if side[a] != side[b]} <= across
    assert all(side[a] != side[b] for a, b in across)


def test_repeated_id_with_other_texts(spark):
    """Each row of a repeated doc_id has the links of its own text, whichever row comes first."""
    words = [[f"{x}{i}" for i in range(n)] for x, n in (("a", 60), ("b", 200), ("c", 90))]
    first, second, third = (" ".join(w) for w in words)
    near = [" ".join([*w[:-1], "other"]) for w in words]
    rows = [(1, near[0]), (3, near[1]), (4, near[2]), (7, first), (7, second), (7, "alone with nothing that is like it"), (9, third)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in similar_documents(docs).collect()}
        assert len(got) == 7
        assert got[7, 56] == (1, False) and got[7, 196] == (3, False) and got[9, 86] == (4, False) and got[7, 3] == (7, True)


def test_trees_pair_all_widths():
    """Below 50 percent similar sets may be many times as large as one another."""
    rng = np.random.default_rng(6)
    large = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
    sets = [large, np.sort(rng.permutation(large)[:220]), np.sort(rng.permutation(large)[:450])]
    sizes = np.array([len(s) for s in sets])
    pairs = {tuple(sorted(p)) for p in candidate_pairs([signature(s) for s in sets], sizes, 20).tolist()}
    assert {(0, 1), (0, 2)} <= pairs
    across = candidate_pairs([signature(s) for s in sets], sizes, 20, np.array([0, 1, 1]))
    assert {(0, 1), (0, 2)} <= {tuple(sorted(p)) for p in across.tolist()}


def test_first_round_grows_with_members(spark, monkeypatch):
    """A wide root's first round gives out a few pairs for each member, however many tiles it has."""
    monkeypatch.setattr(module, "TILE", 8)
    rng = np.random.default_rng(7)
    tokens = np.unique(rng.integers(0, 1 << 63, 100, dtype=np.uint64))
    rows = [(5, 240, i, i, len(tokens), signature(tokens), [5]) for i in range(240)]
    members = spark.createDataFrame(rows, "root long, m long, id long, part long, n long, bits binary, roots array<long>")
    pairs = module._tree_candidates(members, 80, module.FIRST).collect()
    assert 0 < len(pairs) <= module.FIRST * len(rows)
    assert module._tree_candidates(members, 80).count() == 240 * 239 // 2


def test_packed_keys(spark, monkeypatch):
    """Packed keys give the classes of each key of several, and name those that a batch doesn't pack whole."""
    for name, value in (("PACKED", 3), ("BUCKET", 16)):
        monkeypatch.setattr(module, name, value)
    rng = np.random.default_rng(8)
    rows = [((i % 3 << 33) + 40 * i, sorted({*rng.integers(0, 1 << 48, 20).tolist(), *rng.integers(0, 60, 2).tolist(), *[99] * (i % 7 == 0)})) for i in range(90)]
    rows += [(7, []), (11, [99])]
    leaves = spark.createDataFrame(rows, "id long, keys array<long>").repartition(3)
    of = {}
    for i, keys in rows:
        for k in keys:
            of.setdefault(k, set()).add(i)
    got = module._shared_keys(leaves, 2000).collect()
    cut = {r.key for r in got if r.a < 0}
    assert all(len(of[k]) > 3 for k in cut) and 99 in cut
    assert {(r.key, r.a, r.b) for r in got if r.b >= 0} == {(k, min(x), max(x)) for k, x in of.items() if len(x) == 2}
    more = sorted((r.key, r.a) for r in got if r.a >= 0 and r.b < 0)
    assert more == sorted((k, i) for k, x in of.items() if len(x) > 2 and k not in cut for i in x)
    ids = np.sort(rng.integers(0, 10_000, 4000))
    assert (module._from_planes(module._planes(ids)) == ids).all()


def test_memory_goes_by_slices(monkeypatch):
    """What a task makes of a batch's texts or keys is held for a slice of its rows, not for all of them."""
    monkeypatch.setattr(module, "TEXT_BYTES", 1 << 18, raising=False)
    monkeypatch.setattr(module, "KEYS_AT_ONCE", 1 << 14, raising=False)
    texts = [" ".join(f"{i}.{j}" for j in range(300)) for i in range(2000)] + ["", "x " * 200_000]
    docs = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
    keys = np.random.default_rng(9).integers(0, 1 << 48, 400_000).reshape(4000, 100)
    leaves = pa.RecordBatch.from_pydict({"id": pa.array(range(4000), pa.int64()), "keys": pa.array(list(keys), pa.list_(pa.int64()))})
    df = MagicMock()
    df.select.return_value = df
    df.sparkSession.sparkContext.defaultParallelism = 4
    module._described(df, 5, 80, [])
    module._shared_keys(df, 400_000)
    described, packed = (c.args[0] for c in df.mapInArrow.call_args_list)
    for run, batch, most in ((described, docs, 25), (packed, leaves, 3)):
        tracemalloc.start()
        made = [[], []]
        for out in run(iter([batch])):
            made[0] += out.column("doc_id").to_pylist() if run is described else []
            made[1] += [len(x) // 8 for x in out.column("ids").to_pylist()] if run is packed else []
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert made[0] == list(range(len(texts))) if run is described else sum(made[1]) == keys.size
        assert peak < most


@pytest.mark.parametrize("most", [1, 300])
def test_slices_lose_nothing(spark, monkeypatch, most):
    """Results are the same however small the slices are, rows larger than a slice and empty ones included."""
    batch = pa.RecordBatch.from_pydict({"text": ["", "ab", None, "x" * 1000, "", "y"] * 50, "keys": [[1] * (k % 7) for k in range(300)]})
    for column in ("text", "keys"):
        parts = list(module._parts(iter([batch, batch.slice(7, 0), batch.slice(3, 90)]), column, most))
        rows = [r for p in parts for r in p.to_pylist()]
        assert rows == batch.to_pylist() + batch.slice(3, 90).to_pylist()
        assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column(column).to_pylist()) <= most for p in parts)
    for name in ("TEXT_BYTES", "KEYS_AT_ONCE"):
        monkeypatch.setattr(module, name, most)
    rows = corpus(11)
    sets, component = want(rows)
    got = similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {(d, len(sets[d]), component[d]) for d in sets}
