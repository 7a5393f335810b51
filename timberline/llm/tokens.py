"""BPE encoding and decoding, and token counts: one narrow pass over the documents, no shuffle.

A row needs nothing but its own text, so tasks are independent and a lost one is simply run again.
Each Python worker reads the vocabulary once and remembers a bounded number of words.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from timberline.llm.bpe import MarkedEncoder, PieceCounter, vocabulary
from timberline.llm.common import narrow

ENCODED = "doc_id long, ids array<int>, n_tokens long, ids_text string, decoded string, ids_sha256 string, decoded_sha256 string"
COUNTED = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def _joined(values: list[tuple[int, str, str]]) -> tuple[int, str, str]:
    if not values:
        return 0, "", ""
    n, ids, names = zip(*values)
    return sum(n), " ".join([i for i in ids if i]), " ".join([t for t in names if t])


@functools.lru_cache(maxsize=2)
def _marked(path: str) -> MarkedEncoder:
    encoder = MarkedEncoder(path, None, _joined)
    names = encoder.bpe.names
    encoder.render = lambda ids: (len(ids), " ".join(map(str, ids)), " ".join([names[i] for i in ids]))
    return encoder


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encode_documents(docs: DataFrame, vocab: str = "word_bpe_49k.json", keep: bool = True) -> DataFrame:
    """Token ids of every whole text, the text they decode to, and digests of both.

    ``ids_text`` holds the decimal ids joined by one space. Decoding joins the tokens' strings by
    one space, as a vocabulary file without a decoder asks. Special strings inside a text are their
    tokens. A null or empty text has no ids. Rows are independent: equal rows give equal results,
    an empty table gives no rows. ``keep=False`` leaves out the large columns.
    """
    columns = [c.split()[0] for c in ENCODED.split(", ")]
    kept = [c for c in columns if keep or c not in ("ids", "ids_text", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _marked(vocabulary(vocab))
        for batch in batches:
            found = encoder.texts(batch.column("text").to_pylist())
            n, ids, decoded = zip(*found) if found else ((), (), ())
            made = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array(n, pa.int64()),
                "ids_sha256": pa.array(map(_sha, ids), pa.string()),
                "decoded_sha256": pa.array(map(_sha, decoded), pa.string()),
            }
            if keep:
                made |= {
                    "ids": pa.array([[int(i) for i in x.split()] for x in ids], pa.list_(pa.int32())),
                    "ids_text": pa.array(ids, pa.string()),
                    "decoded": pa.array(decoded, pa.string()),
                }
            yield pa.RecordBatch.from_pydict({c: made[c] for c in kept})

    schema = ", ".join(c for c in ENCODED.split(", ") if c.split()[0] in kept)
    return narrow(docs).mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, vocab: str = "word_bpe_49k.json") -> DataFrame:
    """(doc_id, decoded) from (doc_id, ids array<int>): the other way round, for stored ids.

    Ids outside the vocabulary are skipped; null or empty ids decode to an empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _marked(vocabulary(vocab)).bpe.names
        for batch in batches:
            texts = [" ".join([names[i] for i in ids or () if i in names]) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "decoded": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, vocab: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """Bytes and tokens of every whole text, and whether the tokens exceed ``limit``.

    A piece of text that is proven to be one token counts as one without being encoded; only the
    others are merged. A null or empty text has none of either. Rows are independent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _counter(vocabulary(vocab))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = encoder.texts(texts)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_bytes": pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                    "n_tokens": pa.array(n, pa.int64()),
                    "over_limit": pa.array([x > limit for x in n], pa.bool_()),
                }
            )

    return narrow(docs).mapInArrow(run, COUNTED)
