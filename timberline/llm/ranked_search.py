"""Ranked lexical search over partitioned terms: bundles of items pass from term owner to term owner.

Documents are cut into blocks; each block's postings belong to term owners, one for each range of
document frequency, rare terms first. A bundle of items visits the owners of a block one after the
other: a cogroup brings its accumulators (a sparse list of documents and whole-number scores per item)
together with the owner's postings, and what comes out goes to the next owner. A document leaves an
item's accumulators once the terms still to come can't lift it to the place that ``top`` documents of
its block have already; what the last owner gives out is at most ``top`` documents per item and
block, and the best of these are chosen.

Terms are told apart by 64-bit hashes. Items are taken in slices of bounded size, so that their terms
and weights can be sent to all tasks; a slice reads the documents once.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.common import stage
from timberline.llm.word_stream import alphabet, byte_mask, lots, utf8

#: Terms: runs of ASCII letters and digits and of anything beyond ASCII, with A-Z as a-z.
TERMS = alphabet(byte_mask((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)), lower=True, seed=12)
#: Documents in a block (their numbers fit in 16 bits), and hits that close a block before.
BLOCK, HITS = 2048, 4_000_000
#: Items in a bundle, and terms of items in a slice: 16 bytes each are sent to all tasks.
BUNDLE, SLICE = 256, 500_000
#: No document gains more than its weight times this from a term.
MOST = 1_000_000

BLOCKS = "block long, docs long, ids binary, sizes binary, terms binary, ends binary, places binary, counts binary"


def _plain(array: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(array, kind).tobytes()


def _read(value, kind: str) -> np.ndarray:
    return np.frombuffer(value.as_py(), kind)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, term): a row for each term of a row's text."""
    for batch in batches:
        ids, texts = batch.column("item_id"), utf8(batch.column("text").to_pylist())
        for at, words, begins in lots(texts, TERMS):
            row = np.repeat(np.arange(at, at + len(begins) - 1), np.diff(begins))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(words.astype(np.int64))], names=["item_id", "term"])


def _blocks(terms: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's documents in blocks, with the postings of ``terms`` (sorted): per term its documents' places
    in the block and how often they hold it."""
    # Most words are told to be no term by 20 bits of their hash.
    likely = np.zeros(1 << 20, bool)
    likely[(terms >> np.uint64(44)).astype(np.int64)] = True

    def packed(number: int, ids: list, sizes: list[np.ndarray], place: list[np.ndarray], term: list[np.ndarray], count: list[np.ndarray]) -> pa.RecordBatch:
        place, term, count = (np.concatenate(x) for x in (place, term, count))
        order = np.argsort(term, kind="stable")
        place, term, count = place[order], term[order], count[order]
        own, ends = np.unique(term, return_counts=True)
        known = np.array([i is not None for i in ids])
        numbers = np.array([0 if i is None else i for i in ids], np.int64)
        row = {
            "block": (TaskContext.get().partitionId() << 32) + number, "docs": len(ids),
            "ids": _plain(numbers, "<i8") + _plain(known, "u1"), "sizes": _plain(np.concatenate(sizes), "<i8"),
            "terms": _plain(own, "<i4"), "ends": _plain(np.cumsum(ends), "<i8"),
            "places": _plain(place, "<u2"), "counts": _plain(count, "<i4"),
        }
        return pa.RecordBatch.from_pylist([row], schema=pa.schema([(k, pa.binary() if isinstance(v, bytes) else pa.int64()) for k, v in row.items()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, hits = 0, 0
        ids, sizes, place, term, count = [], [], [], [], []
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = batch.slice(k, 256)
                texts, own = utf8(rows.column("text").to_pylist()), rows.column("doc_id").to_pylist()
                for at, words, begins in lots(texts, TERMS):
                    found = np.flatnonzero(likely[(words >> np.uint64(44)).astype(np.int64)])
                    spot = np.searchsorted(terms, words[found])
                    spot[spot == len(terms)] = 0
                    hit = terms[spot] == words[found] if len(terms) else np.zeros(len(found), bool)
                    text = np.searchsorted(begins, found[hit], side="right") - 1
                    pair, often = np.unique(text * max(len(terms), 1) + spot[hit], return_counts=True)
                    place.append(pair // max(len(terms), 1) + len(ids))
                    term.append(pair % max(len(terms), 1))
                    count.append(often)
                    sizes.append(np.diff(begins))
                    ids += own[at : at + len(begins) - 1]
                    hits += len(pair)
                if len(ids) > BLOCK - 256 or hits > HITS:
                    yield packed(number, ids, sizes, place, term, count)
                    number, hits = number + 1, 0
                    ids, sizes, place, term, count = [], [], [], [], []
        if ids:
            yield packed(number, ids, sizes, place, term, count)

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): documents that hold a term; -1: documents with a term; -2: terms of all documents."""
    for batch in batches:
        for k in range(batch.num_rows):
            sizes, ends = _read(batch.column("sizes")[k], "<i8"), _read(batch.column("ends")[k], "<i8")
            term = np.concatenate((_read(batch.column("terms")[k], "<i4"), [-1, -2])).astype(np.int32)
            n = np.concatenate((np.diff(ends, prepend=0), [(sizes > 0).sum(), sizes.sum()])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n)], names=["term", "n"])


@dataclass(frozen=True)
class Plan:
    """What all tasks of a slice know: the corpus, and weight and owner of each term, the terms of each item."""

    n_docs: int
    n_terms: int
    weight: np.ndarray
    owner: np.ndarray
    owners: int
    item_terms: np.ndarray
    item_ends: np.ndarray

    def terms_of(self, item: int) -> np.ndarray:
        return self.item_terms[self.item_ends[item - 1] if item else 0 : self.item_ends[item]]

    @property
    def items(self) -> int:
        return len(self.item_ends)


def impacts(count: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What an occurrence count is worth in a document of ``size`` terms; exact whole numbers.

    The part that depends on the length is taken in Python's integers where 64 bits could overflow.
    """
    if n_terms and 90 * int(size.max(initial=0)) * n_docs >= 1 << 62:
        m = np.array([10 + (90 * int(s) * n_docs) // n_terms for s in size], np.int64)
    else:
        m = 10 + (90 * size * n_docs) // max(n_terms, 1)
    return (1_000_000_000 * count) // (1000 * count + 8 * m)


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def owners_by_frequency(df: np.ndarray, owners: int) -> np.ndarray:
    """An owner for each term: rare terms first, cut between quarters of powers of two of the frequency so that
    owners have about as many postings each."""
    level = np.floor(4 * np.log2(np.maximum(df, 1))).astype(np.int64)
    load = np.bincount(level, df, minlength=1)
    middle = np.cumsum(load) - load / 2
    return np.minimum((middle / max(load.sum(), 1) * owners).astype(np.int64), owners - 1)[level]


def _postings(plan: Plan, owner: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(block, ids, terms, ends, places, gains): an owner's postings of each block; ids go to the last owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                value = lambda name: batch.column(name)[k]  # noqa: B023, E731
                terms, ends = _read(value("terms"), "<i4"), _read(value("ends"), "<i8")
                sizes, places, counts = _read(value("sizes"), "<i8"), _read(value("places"), "<u2"), _read(value("counts"), "<i4")
                length = np.diff(ends, prepend=0)
                mine = plan.owner[terms] == owner
                keep = np.repeat(mine, length)
                gains = impacts(counts[keep].astype(np.int64), sizes[places[keep]], plan.n_docs, plan.n_terms)
                row = {
                    "block": value("block").as_py(), "docs": value("docs").as_py(), "ids": value("ids").as_py() if owner == plan.owners - 1 else b"",
                    "terms": _plain(terms[mine], "<i4"), "ends": _plain(np.cumsum(length[mine]), "<i8"),
                    "places": _plain(places[keep], "<u2"), "gains": _plain(gains, "<i4"),
                }
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([(n, pa.binary() if isinstance(v, bytes) else pa.int64()) for n, v in row.items()]))

    return run


POSTINGS = "block long, docs long, ids binary, terms binary, ends binary, places binary, gains binary"
ACCUMULATORS = "block long, bundle int, sizes binary, places binary, scores binary"


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers byte by byte: first all lowest bytes, and so on; high bytes are mostly zero."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).reshape(-1).view("<i8")


def _visit(plan: Plan, owner: int, top: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A bundle at an owner: accumulators and postings of a block in, accumulators or results out."""
    last = owner == plan.owners - 1
    to_come = [
        int((plan.weight[t := plan.terms_of(i)] * (plan.owner[t] > owner)).sum()) * MOST for i in range(plan.items)
    ]

    def run(carried: pa.Table, postings: pa.Table) -> pa.Table:
        block, bundle = carried.column("block")[0].as_py(), carried.column("bundle")[0].as_py()
        value = lambda table, name: table.column(name)[0]
        docs = value(postings, "docs").as_py()
        terms, ends = _read(value(postings, "terms"), "<i4"), _read(value(postings, "ends"), "<i8")
        places, gains = _read(value(postings, "places"), "<u2"), _read(value(postings, "gains"), "<i4")
        sizes, had = _read(value(carried, "sizes"), "<i4"), _read(value(carried, "places"), "<u2")
        scores = _from_planes(value(carried, "scores").as_py())
        start = np.concatenate(([0], ends))
        begin = np.concatenate(([0], np.cumsum(sizes)))
        out_sizes, out_places, out_scores = [], [], []
        for k, item in enumerate(range(bundle * BUNDLE, min((bundle + 1) * BUNDLE, plan.items))):
            score = np.zeros(docs, np.int64)
            if len(sizes):
                score[had[begin[k] : begin[k + 1]]] = scores[begin[k] : begin[k + 1]]
            mine = plan.terms_of(item)
            at = np.searchsorted(terms, mine)
            at[at == len(terms)] = 0
            for spot in at[terms[at] == mine].tolist() if len(terms) else ():
                # A document holds a term once in the postings, so plain addition is enough.
                part = slice(start[spot], start[spot + 1])
                score[places[part]] += plan.weight[terms[spot]] * gains[part].astype(np.int64)
            held = np.flatnonzero(score > 0)
            if len(held) > top:
                rank = np.partition(score[held], len(held) - top)[len(held) - top]
                held = held[score[held] + to_come[item] >= rank]
            out_sizes.append(len(held))
            out_places.append(held)
            out_scores.append(score[held])
        chosen = np.concatenate(out_places) if out_places else np.empty(0, np.int64)
        gained = np.concatenate(out_scores) if out_scores else np.empty(0, np.int64)
        if not last:
            row = {"block": [block], "bundle": [bundle], "sizes": [_plain(out_sizes, "<i4")], "places": [_plain(chosen, "<u2")], "scores": [_planes(gained)]}
            return pa.table(row, pa.schema([("block", pa.int64()), ("bundle", pa.int32()), *((c, pa.binary()) for c in ("sizes", "places", "scores"))]))
        packed = value(postings, "ids").as_py()
        numbers, known = np.frombuffer(packed[: 8 * docs], "<i8"), np.frombuffer(packed[8 * docs :], "u1").astype(bool)
        item = np.repeat(np.arange(len(out_sizes)) + bundle * BUNDLE, out_sizes)
        order = np.lexsort((numbers[chosen], ~known[chosen], -gained, item))
        item, chosen, gained = item[order], chosen[order], gained[order]
        first = np.searchsorted(item, item)
        best = np.arange(len(item)) - first < top
        chosen = chosen[best]
        return pa.table(
            {"item": pa.array(item[best].astype(np.int32)), "doc_id": pa.array(numbers[chosen], mask=~known[chosen]), "score": pa.array(gained[best])}
        )

    return run


def _slice(docs: DataFrame, items: DataFrame, top: int, owners: int) -> DataFrame:
    """(item, doc_id, score) of a slice's items; items (item int from 0 on, terms) are few enough to send."""
    rows = sorted(items.select("item", "terms").collect(), key=lambda r: r.item)
    lists = [np.unique(np.array(r.terms, np.int64).astype(np.uint64)) for r in rows]
    terms = np.unique(np.concatenate(lists))
    blocks = stage(docs.mapInArrow(_blocks(terms), BLOCKS), "blocks")
    counted = blocks.mapInArrow(_totals, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = {r.term: r.n for r in counted}
    df = np.array([n.get(t, 0) for t in range(len(terms))], np.int64)
    n_docs = n.get(-1, 0)
    plan = Plan(
        n_docs, n.get(-2, 0), weights(df, n_docs), owners_by_frequency(df, owners), owners,
        np.concatenate([np.searchsorted(terms, x) for x in lists]), np.cumsum([len(x) for x in lists]),
    )
    bundles = math.ceil(plan.items / BUNDLE)
    numbers = F.explode(F.sequence(F.lit(0), F.lit(bundles - 1)))
    none = F.lit(bytearray())
    state = blocks.select("block", numbers.alias("bundle"), none.alias("sizes"), none.alias("places"), none.alias("scores"))
    for owner in range(owners):
        postings = blocks.mapInArrow(_postings(plan, owner), POSTINGS).withColumn("bundle", numbers)
        result = "item int, doc_id long, score long" if owner == owners - 1 else ACCUMULATORS
        state = state.groupBy("block", "bundle").cogroup(postings.groupBy("block", "bundle")).applyInArrow(_visit(plan, owner, top), result)
    by = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    # Spark keeps the first rows of each task before they meet, so an item's rows stay few.
    return state.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)


def ranked_search(
    docs: DataFrame, items: DataFrame, top: int = 10, owners: int = 3, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item by score, equal scores by doc_id.

    An item's terms are the distinct terms of its text; rows that repeat an item_id, or have none, are one
    item with the terms of all. Documents that repeat an id are documents of their own; one without an id
    comes after others of its score. Null and empty texts have no terms: such documents are never found,
    such items have no rows. Other columns don't matter; an empty table gives no rows.
    """
    documents = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = items.schema[item_col].dataType
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    schema = items.select(F.col(item_col).alias("item_id")).schema.add("term", "long")
    found = asked.mapInArrow(_item_terms, schema).groupBy("item_id").agg(F.collect_set("term").alias("terms"))
    found = stage(found.withColumn("size", F.size("terms")), "items")
    total = found.agg(F.sum("size")).head()[0] or 0
    # Twice as many slices as needed, so that uneven ones fit; items are numbered within their slice.
    slices = 1 if total <= SLICE else math.ceil(2 * total / SLICE)
    part = F.pmod(F.xxhash64("item_id"), F.lit(slices)).cast("int")
    parts = []
    for k in range(slices if total else 0):
        mine = found.where(part == k)
        if slices > 1 and mine.isEmpty():
            continue
        numbered = stage(mine.orderBy("item_id").withColumn("item", F.row_number().over(Window.orderBy("item_id")) - 1), "slice")
        best = _slice(documents, numbered, top, owners)
        parts.append(best.join(F.broadcast(numbered.select("item", "item_id")), "item").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return docs.sparkSession.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    return functools.reduce(DataFrame.unionByName, parts)
