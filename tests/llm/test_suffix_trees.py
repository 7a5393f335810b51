"""Repeated passages against all windows compared by their words."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from timberline.llm import suffix_trees
from timberline.llm.suffix_trees import anchors, drop_repeated_passages, repeated_passages
from timberline.llm.word_stream import EXACT_WORDS, hashes

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(texts, window):
    """(words, removed, kept text) of each text."""
    words = [WORD.findall(t or "") for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def corpus(seed, window):
    rnd = random.Random(seed)
    vocabulary = ["a", "A", "b", "é", "日本", "x y", "zz"] + [f"w{i}" for i in range(300)]
    fresh = lambda n: [rnd.choice(vocabulary[7:]) for _ in range(n)]
    passages = [fresh(rnd.choice([window - 1, window, window + 1, 3 * window])) for _ in range(6)]
    texts = []
    for _ in range(60):
        words = []
        for _ in range(rnd.randrange(0, 5)):
            words += rnd.choice([fresh(rnd.randrange(0, 2 * window)), rnd.choice(passages), rnd.choice(passages)[1:], ["a", "b"] * rnd.randrange(window), ["a"] * rnd.randrange(2 * window)])
        texts.append("".join(w + rnd.choice([" ", "\n", "\t ", "\x0b", "\r\n"]) for w in words))
    return texts + [texts[0], texts[3], texts[3], texts[7] + " more", "", None, " \n ", "one"]


@pytest.mark.parametrize(("seed", "window", "limit"), [(1, 35, 256), (2, 35, 0), (3, 10, 3), (4, 3, 0), (5, 1, 256)])
def test_passages(spark, monkeypatch, seed, window, limit):
    """With a limit of 0, prefixes of all groups are lengthened to whole windows."""
    monkeypatch.setattr(suffix_trees, "LEAST", limit)
    monkeypatch.setattr(suffix_trees, "PARTS", 1 << 40 if limit < 256 else 8)
    texts = corpus(seed, window)
    rows = [(i // 2 if i % 7 else None, i, t, 1, 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, key long, text string, doc int, digest int").repartition(4)
    got = drop_repeated_passages(docs, window)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_text"]
    want = sorted((str(r[0]), *w) for r, w in zip(rows, plain(texts, window)))
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in got.collect()) == want


def test_digest_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "b c d")], "doc_id long, text string")
    rows = {r.doc_id: r for r in drop_repeated_passages(docs, 2, digest=True).collect()}
    assert (rows[1].n_words, rows[1].n_removed) == (3, 2)
    assert rows[2].kept_sha256 == "18ac3e7343f016890c510e93f935261169d9e3f565436429830faf0934f4f8e4"
    assert drop_repeated_passages(docs.limit(0), 35).count() == 0


def test_long_text(spark):
    rnd = random.Random(9)
    long = [f"w{rnd.randrange(10**6)}" for _ in range(300_000)]
    docs = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(long[70_000:70_100] + ["end"])), (3, "x" * 2_000_000)], "doc_id long, text string")
    rows = {r.doc_id: (r.n_words, r.n_removed) for r in drop_repeated_passages(docs, digest=True).select("doc_id", "n_words", "n_removed").collect()}
    assert rows == {1: (300_000, 100), 2: (101, 100), 3: (1, 0)}


def test_anchors_cover_all_windows():
    rnd = np.random.default_rng(3)
    text = " ".join(rnd.choice(["a", "b", "c", "dd"], 400)).encode()
    _, words = hashes(np.frombuffer(text, np.uint8), EXACT_WORDS)
    key, at, first, last, _ = anchors(words, np.array([0, len(words)]), 20)
    assert first[0] == 0 and last[-1] == len(words) - 20 and (first[1:] == last[:-1] + 1).all()
    assert ((first >= at - 12) & (last <= at)).all()


def test_anchors_are_dropped_once_unique(spark):
    """Passages are found through the trees: without equal anchors there is nothing to sort."""
    docs = spark.createDataFrame([(i, " ".join(f"d{i}w{k}" for k in range(60))) for i in range(20)], "doc_id long, text string")
    assert repeated_passages(docs, 35).count() == 0
