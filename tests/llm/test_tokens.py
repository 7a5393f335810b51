"""Token operators against the libraries that define their results."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from timberline.llm.bpe import PieceEncoder, merges, vocabulary
from timberline.llm.tokens import count_tokens, decode_ids, encode_documents

TEXTS = [
    None, "", " ", "  \n\t ", "The quick brown fox.", "don't WE'LL 'tis", "a  b \n c\t\td", " lead", "trail ",
    "x<|endoftext|>y <|startoftext|> z<|endoftext|>", "<|endoftext|>", "<|endoftext", "日本語のテスト 漢字", "🙂🙂 👩‍👩‍👧 été ﬁ",
    "Σίσυφος ΟΔΟΣ İstanbul ǅ ß ẞ", "1234567 ½ ² Ⅷ", "a" * 3000, "ab" * 900 + " " + "xyzzy" * 300, "tab\x1csep\x1fx\x85y z w",
    "\r\nline\r\n\r\n", "thththetionbleing anthrethtiontion", "nul\x00 in", "​zero‍width", "'s's 've", "same", "same",
]


def noise(seed, n):
    rnd = random.Random(seed)
    parts = ["th", "ER", "ing", " ", "  ", "\n", ".", "'s", "é", "ñ", "ß", "7", "42", "|", "$$$", "the", "of", "\t", "漢", "🙂", "Σ", "_", "́"]
    return ["".join(rnd.choices(parts, k=rnd.randrange(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS + noise(1, 400))] + [(None, "no id", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_encode_and_decode(docs):
    lib = library("word_bpe_49k.json")
    encoded = encode_documents(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(encoded) == len(TEXTS) + 400
    for r in encoded:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, list(r.ids), r.decoded) == (len(ids), ids, decoded), r.text
        assert r.ids_text == " ".join(map(str, ids))
        assert (r.ids_sha256, r.decoded_sha256) == (sha(" ".join(map(str, ids))), sha(decoded))
    again = {r.doc_id: r.decoded for r in decode_ids(encode_documents(docs)).collect()}
    assert all(again[r.doc_id] == r.decoded for r in encoded)
    assert encode_documents(docs, keep=False).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_counts(docs):
    lib = library("byte_bpe_50k.json")
    rows = count_tokens(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    for r in rows:
        n = len(lib.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 1024), r.text


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert encode_documents(none).count() == 0 and count_tokens(none).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_proofs(name):
    """Every token proven whole is whole for exact merging; speculation equals merging."""
    bpe = merges(vocabulary(name))
    names = random.Random(2).sample(sorted(bpe.proposals), 3000)
    ends = [t for t in names if t.endswith(" ") or not bpe.end]
    assert all(bpe.merge(t) == [bpe.proposals[t]] for t in ends)
    words = [a.rstrip(" ") + b for a, b in zip(names, ends[1:] + ends[:1])]
    assert bpe.encode(words) == bpe.encode(words, speculate=False)


def test_forgetting(monkeypatch):
    """A memory that is always full gives the same."""
    import timberline.llm.bpe as module

    texts = [t or "" for t in TEXTS] + noise(3, 100)
    encoder = PieceEncoder(vocabulary("byte_bpe_50k.json"), len, sum)
    before = encoder.texts(texts)
    monkeypatch.setattr(module, "REMEMBERED", 0)
    assert encoder.texts(texts, at_once=1) == before
