"""Ranked search against all documents scored one by one."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from timberline.llm import ranked_search as module
from timberline.llm.ranked_search import owners_by_frequency, ranked_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, top):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, words in asked.items():
        scored = []
        for d, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in words if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    words = ["The", "the", "tHe", "of", "a1", "9", "É", "é", "日本", "ß", "naïve"] + [f"w{i}" for i in range(150)]
    text = lambda n: "".join(rnd.choice(words[:6] if rnd.random() < 0.4 else words) + rnd.choice([" ", "-", "\n", "_", "@"]) for _ in range(n))
    docs = [(i, text(rnd.choice([0, 1, 3, 20, 200]))) for i in range(700)]
    docs += [(5, docs[3][1]), (None, docs[8][1]), (None, docs[8][1]), (900, None), (901, " .. "), (902, docs[8][1]), (903, "the " * 60_000)]
    items = [(i, text(rnd.choice([1, 4, 15]))) for i in range(30)] + [(3, "w1 w2"), (None, "w3 the"), (77, None), (78, "nowhere"), (79, "")]
    return docs, items


@pytest.mark.parametrize(("seed", "top", "owners", "bundle", "size"), [(1, 10, 3, 256, 500_000), (2, 3, 4, 7, 500_000), (3, 2, 1, 10, 60)])
def test_ranks(spark, monkeypatch, seed, top, owners, bundle, size):
    monkeypatch.setattr(module, "BUNDLE", bundle)
    monkeypatch.setattr(module, "SLICE", size)
    docs, items = corpus(seed)
    table = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, item_id int, block string").repartition(3)
    asked = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id int, text string, item int").repartition(2)
    got = ranked_search(table, asked, top, owners)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(docs, items, top)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([("x", "a")], "item_id string, text string")
    # One document: the weight of a term that all documents hold is floor(1000 ln(4 / 3)).
    assert [tuple(r) for r in ranked_search(docs, items).collect()] == [("x", 1, 1, 287 * (10**9 // (1000 + 8 * 100)))]
    assert ranked_search(docs.limit(0), items).count() == 0
    assert ranked_search(docs, items.limit(0)).count() == 0
    assert ranked_search(docs, items.limit(0)).schema["item_id"].dataType.simpleString() == "string"


def test_rare_terms_come_first():
    df = np.array([1, 1, 2, 1000, 3, 1100, 500, 0, 600, 300])
    owner = owners_by_frequency(df, 3)
    assert owner[[0, 1, 7]].tolist() == [0, 0, 0] and (np.diff(owner[np.argsort(df)]) >= 0).all() and set(owner.tolist()) == {0, 1, 2}
