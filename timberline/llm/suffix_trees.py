"""Repeated passages of words by prefix-partitioned suffix trees.

The suffixes of a corpus are too many to sort, so only suffixes at anchors are: of the windows of
``window`` words, each has one anchor, the run of ``ANCHOR`` words in it with the smallest hash (the
first of equals). Equal windows have equal anchors at equal places, so a window whose anchor occurs
once occurs once, and drops out. An anchor of neighbouring windows is one leaf: the anchor, the words
of these windows before it and after it.

Leaves are dealt by their prefix. The anchor is the shortest prefix; where more leaves share it than
an eighth of a task's share, the prefix is lengthened to the whole window, so that groups stay within a
task's memory however common a line is. In a group, leaves are sorted by the words after the anchor,
with the lengths of common prefixes of neighbours: the suffix tree, as its intervals. The words before
the anchor, read backwards, make a second tree. A window of o words before and the rest after occurs
again where two leaves meet in a node of depth at least o of the one and in one of depth window - o of the
other: these are the deep internal nodes, and what they cover are the repeated passages.

Equal texts are one document from the start (by two 64-bit hashes), and equal leaves of a task are
one: all their windows occur again. Words are told apart by 64-bit hashes, of which leaves carry 48 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.common import stage
from timberline.llm.shingles import mix, word_powers
from timberline.llm.word_stream import EXACT_WORDS, lots, utf8

#: Words in an anchor, or fewer if the window is shorter.
ANCHOR = 8
#: Leaves that a task holds at a time, before equal ones are merged and when groups are sorted.
AT_ONCE = 1_000_000
SORTED_AT_ONCE = 100_000
#: Prefixes are lengthened from so many leaves on: a part of a task's share, but this number at least.
PARTS, LEAST = 8, 256

PLACES = "key long, salt int, doc long, first int, last int, n long"


def anchors(words: np.ndarray, begins: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(key, at, first, last, text) of each anchor: its hash, its place, the windows it is the anchor of
    (their first words) and the number of its text. Places count from the first word of ``words``."""
    size = min(ANCHOR, window)
    n = len(words) - window + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return np.empty(0, np.uint64), none, none, none, none
    run = words[: len(words) - size + 1]
    for k in range(1, size):
        run = mix(run) + words[k : k + len(run)]
    run = mix(run)
    # The smallest of each window's runs and its place, by doubling; the first of equals.
    width = window - size + 1
    low, at, span = run, np.arange(len(run)), 1
    while span < width:
        step = min(span, width - span)
        left = len(low) - step
        later = low[step:] < low[:left]
        low, at = np.where(later, low[step:], low[:left]), np.where(later, at[step:], at[:left])
        span += step
    # Windows lie within a text.
    text = np.searchsorted(begins, np.arange(n), side="right") - 1
    inside = np.arange(n) + window <= begins[text + 1]
    start = np.flatnonzero(inside)
    if not len(start):
        return np.empty(0, np.uint64), none, none, none, none
    at, text = at[start], text[start]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (text[1:] != text[:-1]))))
    end = np.append(new[1:], len(start)) - 1
    return run[at[new]], at[new], start[new], start[end], text[new]


def spans_hash(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of words[start:end], for many spans."""
    up, down = word_powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(doc, texts) of the texts that a task sees for the first time."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        pairs = list(zip(batch.column("doc").to_pylist(), batch.column("digest").to_pylist()))
        new = [i for i, x in enumerate(pairs) if not (x in seen or seen.add(x))]
        if new:
            yield np.array([pairs[i][0] for i in new], np.int64), utf8(batch.column("text").take(pa.array(new)).to_pylist())


def _first_places(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Anchors of a task's texts, equal leaves merged.

    salt 0: the task's first leaf of this key; n is the task's number of leaves of it. salt > 0: a further
    leaf of it. salt -1: windows first to last are those of a leaf that the task has already.
    """

    def flush(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, leaf, doc, at, first, last = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((np.arange(len(key)), leaf, key))
        key, leaf, doc, at, first, last = (x[order] for x in (key, leaf, doc, at, first, last))
        new_key = np.concatenate(([True], key[1:] != key[:-1]))
        new_leaf = new_key | np.concatenate(([True], leaf[1:] != leaf[:-1]))
        again = ~np.append(new_leaf[1:], True) & new_leaf  # a leaf that others of the task equal
        begin = np.flatnonzero(new_key)
        leaves = np.add.reduceat(new_leaf.astype(np.int64), begin)
        n = np.zeros(len(key), np.int64)
        n[begin] = leaves
        salt = np.where(new_key, 0, 1 + (mix(leaf) % np.uint64(1 << 20)).astype(np.int64))
        # A place is a leaf (its anchor's word) or settled windows; a leaf that others equal is both.
        kept, settled = np.flatnonzero(new_leaf), np.flatnonzero(~new_leaf | again)
        spread = mix(doc[settled].astype(np.uint64) + first[settled].astype(np.uint64)).astype(np.int64)
        columns = {
            "key": np.concatenate((key[kept].astype(np.int64), spread)),
            "salt": np.concatenate((salt[kept], np.full(len(settled), -1))).astype(np.int32),
            "doc": np.concatenate((doc[kept], doc[settled])),
            "first": np.concatenate((at[kept], first[settled])).astype(np.int32),
            "last": np.concatenate((at[kept], last[settled])).astype(np.int32),
            "n": np.concatenate((n[kept], np.zeros(len(settled), np.int64))),
        }
        return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for doc, texts in _texts(batches):
            for begin, words, begins in lots(texts, EXACT_WORDS):
                key, at, first, last, text = anchors(words, begins, window)
                if not len(key):
                    continue
                leaf = spans_hash(words, first, last + window) + (at - first).astype(np.uint64)
                own = begins[text]
                parts.append((key, leaf, doc[begin + text], at - own, first - own, last - own))
                held += len(key)
            if held > AT_ONCE:
                yield flush(parts)
                parts, held = [], 0
        if parts:
            yield flush(parts)

    return run


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's texts, each once, packed for the way."""
    pack = zstandard.ZstdCompressor(level=3)
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        pairs = list(zip(batch.column("doc").to_pylist(), batch.column("digest").to_pylist()))
        new = [i for i, x in enumerate(pairs) if not (x in seen or seen.add(x))]
        doc, digest = ([pairs[i][k] for i in new] for k in (0, 1))
        texts = utf8(batch.column("text").take(pa.array(new, pa.int64())).to_pylist())
        yield pa.RecordBatch.from_pydict(
            {"doc": pa.array(doc, pa.int64()), "digest": pa.array(digest, pa.int64()), "packed": pa.array([pack.compress(t) for t in texts], pa.binary())}
        )


def _leaves(window: int, common: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Leaves at the given places of texts: key, doc, at, before, words (48 bits each, without the anchor's).

    Where the key is ``common``, a leaf for each of its windows instead, by the whole window.
    """
    size = min(ANCHOR, window)

    def made(doc: list[int], texts: list[bytes], places: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for begin, words, begins in lots(texts, EXACT_WORDS):
            key, at, first, last, text = anchors(words, begins, window)
            number = len(begins) - 1
            wanted = np.concatenate([places[begin + k].astype(np.int64) + begins[k] for k in range(number)])
            keep = np.isin(at, wanted)
            key, at, first, last, text = (x[keep] for x in (key, at, first, last, text))
            own = np.array(doc[begin : begin + number], np.int64)
            often = np.isin(key, common)
            one = ~often
            left, right = (at - first)[one], (last + window - at - size)[one]
            length = left + right
            ends = np.cumsum(length)
            spot = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length)
            spot += np.repeat(first[one], length) + np.where(spot < np.repeat(left, length), 0, size)
            packed = words[spot].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
            offsets = np.concatenate(([0], ends * 6)).astype(np.int32)
            body = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(packed)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key[one].astype(np.int64)), pa.array(own[text[one]]), pa.array((at - begins[text])[one].astype(np.int32)),
                    pa.array(left.astype(np.int32)), body,
                ],
                names=["key", "doc", "at", "before", "words"],
            )
            if often.any():
                count = (last - first + 1)[often]
                start = np.repeat(first[often], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                which = np.repeat(text[often], count)
                none = np.full(len(start), -1, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(spans_hash(words, start, start + window).astype(np.int64)), pa.array(own[which]),
                        pa.array((start - begins[which]).astype(np.int32)), pa.array(none), pa.array([b""] * len(start), pa.binary()),
                    ],
                    names=["key", "doc", "at", "before", "words"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            pairs = list(zip(batch.column("doc").to_pylist(), batch.column("digest").to_pylist()))
            new = [i for i, x in enumerate(pairs) if not (x in seen or seen.add(x))]
            packed, places = (batch.column(c).take(pa.array(new, pa.int64())) for c in ("packed", "places"))
            for k in range(0, len(new), 512):
                texts = [unpack.decompress(p) for p in packed[k : k + 512].to_pylist()]
                some = [np.asarray(p, np.int64) for p in places[k : k + 512].to_pylist()]
                yield from made([pairs[i][0] for i in new[k : k + 512]], texts, some)

    return run


def _depths(order: np.ndarray, key: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The common prefix of each sorted leaf with the one before it: words, or -1 where the key differs."""
    key, matrix = key[order], matrix[order]
    equal = matrix[1:] == matrix[:-1]
    depth = np.where(equal.all(axis=1), matrix.shape[1], equal.argmin(axis=1)) if matrix.shape[1] else np.zeros(len(key) - 1, np.int64)
    return np.concatenate(([-1], np.where(key[1:] == key[:-1], depth, -1)))


def _padded(body: np.ndarray, start: np.ndarray, length: np.ndarray, width: int, step: int) -> np.ndarray:
    """``length`` words from ``start`` on in steps of ``step``, one row each; zeros fill up."""
    place = np.arange(width)[None, :]
    there = place < length[:, None]
    return np.where(there, body[np.where(there, start[:, None] + step * place, 0)] if len(body) else 0, 0).astype(np.uint64)


def repeated_windows(key: np.ndarray, doc: np.ndarray, at: np.ndarray, before: np.ndarray, sizes: np.ndarray, body: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(doc, first, last): runs of windows that leaves of whole groups share. ``body`` holds their words."""
    size = min(ANCHOR, window)
    width = window - size
    begin = np.cumsum(sizes) - sizes
    # Copies of a text that came by several ways are one leaf.
    order = np.lexsort((before, at, doc, key))
    same = np.zeros(len(key), bool)
    a, b = order[1:], order[:-1]
    same[a] = (key[a] == key[b]) & (doc[a] == doc[b]) & (at[a] == at[b]) & (before[a] == before[b])
    key, doc, at, before, sizes, begin = (x[~same] for x in (key, doc, at, before, sizes, begin))
    out = []
    # Leaves under whole windows: a node of full depth, with as many leaves as share the key.
    whole = before < 0
    if whole.any():
        _, back, count = np.unique(key[whole], return_inverse=True, return_counts=True)
        often = count[back] > 1
        out.append((doc[whole][often], at[whole][often], at[whole][often]))
    key, doc, at, before, sizes, begin = (x[~whole] for x in (key, doc, at, before, sizes, begin))
    if len(key):
        after = sizes - before
        right = _padded(body, begin + before, after, width, 1)
        left = _padded(body, begin + before - 1, before, width, -1)
        nodes = []
        for matrix in (left, right):
            order = np.lexsort((*matrix.T[::-1], key))
            nodes.append((order, _depths(order, key, matrix)))
        hit = np.zeros((len(key), width + 1), bool)
        for o in range(width + 1):
            # Windows that begin o words before the anchor.
            has = np.flatnonzero((before >= o) & (after >= width - o))
            if len(has) < 2:
                continue
            ids = []
            for (order, depth), deep in zip(nodes, (o, width - o)):
                node = np.empty(len(key), np.int64)
                node[order] = np.cumsum(depth < deep)
                ids.append(node[has])
            _, back, count = np.unique(ids[0] * (len(key) + 1) + ids[1], return_inverse=True, return_counts=True)
            hit[has[count[back] > 1], o] = True
        # Runs of neighbouring windows; o falls as the first word rises.
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, low = np.nonzero(edge == 1)
        _, high = np.nonzero(edge == -1)
        out.append((doc[row], at[row] - high + 1, at[row] - low))
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out))


def _trees(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Repeated windows of sorted leaves, as many whole groups at a time as are near ``SORTED_AT_ONCE``."""

    def found(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        key, doc, at, before = (table.column(c).to_numpy() for c in ("key", "doc", "at", "before"))
        words = table.column("words").combine_chunks()
        words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
        raw = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]] if words.buffers()[2] else np.empty(0, np.uint8)
        body = np.zeros((len(raw) // 6, 8), np.uint8)
        body[:, :6] = raw.reshape(-1, 6)
        result = repeated_windows(key, doc, at.astype(np.int64), before.astype(np.int64), np.diff(ends).astype(np.int64) // 6, body.reshape(-1).view("<u8"), window)
        return pa.RecordBatch.from_arrays([pa.array(result[0], pa.int64()), *(pa.array(x.astype(np.int32)) for x in result[1:])], names=["doc", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows < SORTED_AT_ONCE:
                continue
            table = pa.concat_tables(held)
            key = table.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
            if cut:
                yield found(table.slice(0, cut))
                table = table.slice(cut)
            held, rows = [table], table.num_rows
        if rows:
            yield found(pa.concat_tables(held))

    return run


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("doc"), F.xxhash64(F.lit(1), text).alias("digest"), text.alias("text")
    )


def repeated_passages(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, passages array<struct<first int, last int>>): windows that occur again, per distinct text.

    doc is xxhash64 of the text; first and last are the numbers of first words, so that the words from
    first to last + window - 1 are covered. Texts that occur in several rows count once here. Null and empty
    texts and texts of fewer words than ``window`` have none; an empty table gives no rows.
    """
    if window < 1:
        raise ValueError("window must be at least one word")
    spark = docs.sparkSession
    texts = _named(docs, id_col, text_col).select("doc", "digest", "text")
    # A task sends one row per key to the key's owner, and further leaves, known to repeat, to anywhere.
    by = Window.partitionBy("key", "salt")
    place = F.xxhash64("doc", "first")
    seen = texts.mapInArrow(_first_places(window), PLACES).withColumn("place", place)
    seen = seen.repartition("key", "salt").withColumns(
        {"low": F.min("place").over(by), "high": F.max("place").over(by), "most": F.max("n").over(by), "total": F.sum("n").over(by)}
    )
    again = (F.col("salt") != 0) | (F.col("low") != F.col("high")) | (F.col("most") > 1)
    places = stage(seen.where(again).select("key", "salt", "doc", "first", "last", F.col("total").alias("n")), "places")
    # At most PARTS keys for each task have a PARTS-th of a task's share of leaves, so the list is bounded.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    limit = max(LEAST, places.where("salt >= 0").count() // (PARTS * tasks))
    common = places.where((F.col("salt") == 0) & (F.col("n") > limit)).select("key").distinct()
    keys = np.array([r.key for r in common.collect()], np.int64).astype(np.uint64)
    wanted = places.where("salt >= 0").groupBy("doc").agg(F.collect_set("first").alias("places"))
    packed = texts.mapInArrow(_compressed, "doc long, digest long, packed binary")
    leaves = packed.join(wanted, "doc").select("doc", "digest", "packed", "places")
    leaves = leaves.mapInArrow(_leaves(window, keys), "key long, doc long, at int, before int, words binary")
    found = leaves.repartition("key").sortWithinPartitions("key").mapInArrow(_trees(window), "doc long, first int, last int")
    settled = places.where("salt < 0").select("doc", "first", "last")
    runs = found.unionByName(settled).groupBy("doc").agg(F.collect_set(F.struct("first", "last")).alias("passages"))
    return stage(runs, "passages")


def _kept(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc, digest, words, removed, the kept words joined by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            rows = []
            passages = batch.column("passages")
            for k, (doc, digest) in enumerate(zip(batch.column("doc").to_pylist(), batch.column("digest").to_pylist())):
                if (doc, digest) in seen:
                    continue
                seen.add((doc, digest))
                words = unpack.decompress(batch.column("packed")[k].as_py()).split()
                spans = passages[k].values
                kept = words
                if spans is not None and len(spans):
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, spans.field("first").to_numpy(), 1)
                    np.add.at(change, spans.field("last").to_numpy() + window, -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                rows.append((doc, digest, len(words), len(words) - len(kept), b" ".join(kept)))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())],
                names=["doc", "digest", "n_words", "n_removed", "kept"],
            )

    return run


def drop_repeated_passages(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """A row per document: doc_id, n_words, n_removed, and the kept words, joined by blanks.

    A word goes if a window of ``window`` words that covers it has words that also start elsewhere, in
    this document or another; rows with the same text are documents of their own. With ``digest``, a
    column kept_sha256 instead of kept_text. Repeated and null ids are kept as they are; null texts are
    empty; other columns don't matter. An empty table gives no rows.
    """
    passages = repeated_passages(docs, window, id_col, text_col)
    rows = _named(docs, id_col, text_col)
    packed = rows.select("doc", "digest", "text").mapInArrow(_compressed, "doc long, digest long, packed binary")
    whole = packed.join(passages, "doc", "left").select("doc", "digest", "packed", "passages")
    kept = whole.mapInArrow(_kept(window), "doc long, digest long, n_words long, n_removed long, kept binary")
    text = F.sha2("kept", 256).alias("kept_sha256") if digest else F.col("kept").cast("string").alias("kept_text")
    kept = kept.select("doc", "digest", "n_words", "n_removed", text).dropDuplicates(["doc", "digest"])
    # A text of several rows goes whole if it holds a window.
    ids = rows.select("doc_id", "doc", "digest")
    copies = stage(ids.groupBy("doc", "digest").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copies")
    kept = stage(kept.join(copies, ["doc", "digest"], "left"), "kept")
    gone = F.col("copies").isNotNull() & (F.col("n_words") >= window)
    name = "kept_sha256" if digest else "kept_text"
    empty = F.sha2(F.lit(""), 256) if digest else F.lit("")
    return ids.join(kept, ["doc", "digest"]).select(
        "doc_id", "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(gone, empty).otherwise(F.col(name)).alias(name),
    )
