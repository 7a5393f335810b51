"""Packing: every id once, gapless sequences, no padding."""

import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest

from timberline.llm.bpe import vocabulary
from timberline.llm.packing import borders, combinations, pack_documents, plan_rests


def check(pieces, ids_of, window):
    """ids_of: (doc_id, ids) of every row."""
    sequences, docs = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        docs[p.doc_id].append((p.start, p.length, p.ids_crc32, p.doc_tokens))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == window or at < window and at & (at - 1) == 0
    wanted = defaultdict(list)
    for doc, ids in ids_of:
        wanted[doc].append(ids)
    assert docs.keys() == wanted.keys()
    for doc, all_ids in wanted.items():
        assert sum(p[1] for p in docs[doc]) == sum(map(len, all_ids))
        if len(all_ids) == 1:
            at = 0
            for start, length, crc, n in sorted(docs[doc]):
                assert start == at and n == len(all_ids[0])
                assert crc == zlib.crc32(struct.pack(f"<{length}I", *all_ids[0][start : start + length]))
                at += length


@pytest.mark.parametrize("window", [16, 2048])
def test_pack(spark, window):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rng = np.random.default_rng(5)
    words = ["the", "of", "ndernt", "thorreou", "x<|endoftext|>", "42", "é", ".", "\n"]
    texts = [" ".join(rng.choice(words, n)) for n in rng.integers(0, 60 if window == 16 else 1500, 250)]
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [(1000, None, None), (1001, "", "b"), (1002, "the " * 9000, "c")]
    rows += [(2000, "the same row " * 7, "d")] * 5 + [(None, "no id", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(5)
    pieces = pack_documents(docs, window=window).collect()
    ids_of = [(d, library.encode(t or "", add_special_tokens=False).ids + [1]) for d, t, _ in rows]
    check(pieces, ids_of, window)


def test_same_lengths(spark):
    """One length holds all rows: no combination fits, the rests are cut."""
    rows = [(i, "the of and") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    pieces = pack_documents(docs, window=2048).collect()
    check(pieces, [(i, [1169, 286, 290, 1]) for i in range(3000)], 2048)


def test_empty(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_plan():
    rng = np.random.default_rng(1)
    counts = np.zeros(2048, np.int64)
    counts[1:] = rng.integers(0, 400, 2047)
    slots, left, sequences = plan_rests(counts, 2048)
    used = np.zeros(2048, np.int64)
    filled = defaultdict(int)
    for length, low, high, first, offset in slots:
        assert low == used[length]
        used[length] = high
        filled[first, high - low] += length
    assert (used + left == counts).all() and set(filled.values()) == {2048}
    # The fit takes most rests whole.
    assert (left * np.arange(2048)).sum() < 0.3 * (counts * np.arange(2048)).sum()
    assert all(r.sum() == 64 for r in combinations(64, np.ones(64, bool)))
    assert borders(2048 + 1300, 2048) == [(2048, 1024), (3072, 256), (3328, 16), (3344, 4)]
