"""Packing documents into sequences of a fixed window, by non-negative least squares.

Full windows of a document are sequences of their own. What is left of each, its rest, is shorter
than a window. The histogram of rests (one row per length, so bounded by the window) goes to the
driver. Combinations of two or three lengths that fill a window exactly are enumerated; how often
each is used is a non-negative least-squares fit to the histogram, rounded down, then topped up
greedily from all combinations. Rests that no combination takes are laid end to end, from long to short, and cut at the
windows' borders; the last, unfinished window is cut into powers of two, which need no padding.

Ids are encoded once and never shuffled: full windows and uncut rests are carried by checksums, and
only the stored rests that are cut are read again.
"""

from __future__ import annotations

import functools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.bpe import PieceLibrary, vocabulary
from timberline.llm.common import checked_broadcast, narrow, stage

def combinations(window: int, present: np.ndarray) -> np.ndarray:
    """Rows of three lengths (0 for none) that fill the window; only lengths that are present."""
    rows = []
    for a in range(window // 3 + 1):
        if a and not present[a]:
            continue
        b = np.arange(max(a, 1), (window - a) // 2 + 1)
        c = window - a - b
        ok = present[b] & present[c]
        rows.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], 1))
    return np.concatenate(rows) if rows else np.empty((0, 3), np.int64)


def fit_counts(combos: np.ndarray, counts: np.ndarray, rounds: int) -> np.ndarray:
    """Non-negative least squares by multiplicative updates: x with (combos' lengths) x ~ counts."""
    x = np.ones(len(combos))
    goal = counts.astype(float).copy()
    goal[0] = 0
    up = goal[combos].sum(1)
    for _ in range(rounds):
        used = np.bincount(combos.ravel(), np.repeat(x, 3), len(counts))
        used[0] = 0
        x *= up / np.maximum(used[combos].sum(1), 1e-9)
    return x


def plan_rests(counts: np.ndarray, window: int) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray, int]:
    """How rests are placed: (length, first number, last number + 1, first sequence, offset) for the
    combinations, how many of each length are left, and how many sequences the combinations take."""
    combos = combinations(window, counts > 0)
    left, slots, sequences = counts.copy(), [], 0
    if not len(combos):
        return slots, left, sequences
    # As many equations as lengths: a basic solution has no more counts than that. Those of twice as
    # many combinations are fitted to the end and rounded; what they leave is open to all combinations.
    order = np.argsort(-fit_counts(combos, counts, 40), kind="stable")
    combos = combos[order]
    x = fit_counts(combos[: 2 * window], counts, 300)
    rows, room = combos.tolist(), left.tolist()
    times: dict[int, int] = defaultdict(int)

    def take(i: int, wanted: int | None) -> None:
        lengths = [n for n in rows[i] if n]
        n = min(room[k] // lengths.count(k) for k in lengths)
        n = n if wanted is None else min(n, wanted)
        if n > 0:
            times[i] += n
            for k in lengths:
                room[k] -= n

    fitted = np.argsort(-x, kind="stable").tolist()
    for i in fitted:
        take(i, int(x[i]))
    for i in (*fitted, *range(len(x), len(rows))):  # whatever still fits; each one taken here uses up a length
        take(i, None)
    left = np.array(room, np.int64)
    given = np.zeros(len(counts), np.int64)
    for i, n in times.items():
        offset = 0
        for k in rows[i]:
            if k:
                slots.append((k, int(given[k]), int(given[k] + n), sequences, offset))
                given[k] += n
                offset += k
        sequences += n
    return slots, left, sequences


def borders(total: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of the sequences after the last full window: powers of two."""
    at, out = total - total % window, []
    for bit in range(window.bit_length() - 1, -1, -1):
        if (total % window) >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


@functools.lru_cache(maxsize=2)
def _library(path: str) -> PieceLibrary:
    return PieceLibrary(path)


ROWS = "doc_id long, part long, row long, doc_tokens long, rest long, number long, first long, crcs array<long>, crc long, ids binary"


def _encoded(docs: DataFrame, vocab: str, window: int, end_id: int) -> DataFrame:
    """A row per document: checksums of its full windows, and its rest with a checksum.

    (part, row) names a row; ``number`` counts equal rests, ``first`` full windows within a part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _library(vocabulary(vocab))
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        windows = rows = 0
        small = encoder.codec.n_vocab <= 1 << 16 and end_id < 1 << 16
        for batch in batches:
            out = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.texts(batch.column("text").to_pylist())):
                ids = np.append(ids.astype("<u4"), np.uint32(end_id))
                full, rest = divmod(len(ids), window)
                crcs = [zlib.crc32(ids[i * window : (i + 1) * window]) for i in range(full)]
                left = ids[full * window :]
                kept = left.astype("<u2" if small else "<u4").tobytes()
                out.append((doc, part, rows, len(ids), rest, seen[rest], windows, crcs, zlib.crc32(left), kept))
                rows, windows = rows + 1, windows + full
                seen[rest] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), ROW_TYPES)], ROW_NAMES) if out else EMPTY

    return docs.mapInArrow(run, ROWS)


ROW_NAMES = [c.split()[0] for c in ROWS.split(", ")]
ROW_TYPES = [pa.list_(pa.int64()) if n == "crcs" else pa.binary() if n == "ids" else pa.int64() for n in ROW_NAMES]
EMPTY = pa.RecordBatch.from_arrays([pa.array([], t) for t in ROW_TYPES], ROW_NAMES)


def _cut_pieces(cut: DataFrame, window: int, full_until: int, tail: list, base: int) -> DataFrame:
    """The pieces of rests that cross a border."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                wide = "<u2" if len(row["ids"]) == 2 * row["rest"] else "<u4"
                ids = np.frombuffer(row["ids"], wide).astype("<u4")
                begin, at, stop = row["doc_tokens"] - row["rest"], row["stream"], row["stream"] + row["rest"]
                done = 0
                while at < stop:
                    if at < full_until:
                        where, offset, till = at // window, at % window, (at // window + 1) * window
                    else:
                        i = next(i for i, (s, k) in enumerate(tail) if s <= at < s + k)
                        where, offset, till = full_until // window + i, at - tail[i][0], sum(tail[i])
                    length = min(stop, till) - at
                    crc = zlib.crc32(ids[done : done + length])
                    out.append((row["doc_id"], begin + done, length, crc, row["doc_tokens"], base + where, offset))
                    at, done = at + length, done + length
            yield pa.RecordBatch.from_pylist([dict(zip(PIECE_NAMES, r)) for r in out], PIECE_ARROW)

    return cut.mapInArrow(run, ", ".join(f"{c} long" for c in PIECE_NAMES))


PIECE_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
PIECE_ARROW = pa.schema([(c, pa.int64()) for c in PIECE_NAMES])


def pack_documents(docs: DataFrame, vocab: str = "byte_bpe_50k.json", window: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens.

    A document is its ids and ``end_id``; a null or empty text has ``end_id`` alone. Every id is in
    one piece. Equal rows are packed each on their own; an empty table gives no rows. Sequences
    are a whole window or a power of two long, so nothing is padded. ``window`` must be a power of
    two. The driver gets the histogram of rests: ``window`` rows at most.
    """
    if window & (window - 1) or window < 4:
        raise ValueError("window must be a power of two, 4 at least")
    spark = docs.sparkSession
    rows = stage(_encoded(narrow(docs), vocab, window, end_id), "packing")

    counts = np.zeros(window, np.int64)
    for rest, n in rows.where("rest > 0").groupBy("rest").count().collect():
        counts[rest] = n
    slots, left, base = plan_rests(counts, window)
    # What is left is laid end to end, long rests first: a place for each length, then by number.
    total, plan = 0, [(*s, -1) for s in slots]
    for k in range(window - 1, 0, -1):
        if left[k]:
            plan.append((k, int(counts[k] - left[k]), int(counts[k]), 0, 0, total))
            total += int(left[k]) * k
    full_until, tail = total - total % window, borders(total, window)
    after = base + full_until // window + len(tail)

    full = rows.select(
        "doc_id", "part", "first", "doc_tokens", F.posexplode("crcs").alias("i", "ids_crc32")
    ).select(
        "doc_id", (F.col("i").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32",
        "doc_tokens",
        (F.lit(after) + F.col("part") * (1 << 33) + F.col("first") + F.col("i")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    # Numbers of equal rests across tasks: a running sum over tasks, not over rows.
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        rows.where("rest > 0").groupBy("rest", "part").count()
        .select("rest", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"))
    )
    places = spark.createDataFrame(
        plan or [(0, 0, 0, 0, 0, 0)], "rest long, low long, high long, sequence long, offset long, stream long"
    )
    rests = rows.drop("ids", "crcs").where("rest > 0").join(firsts, ["rest", "part"]).withColumn("number", F.col("number") + F.col("earlier"))
    # Bounded: three rows for each combination used, three windows' lengths of them at most; one for each length.
    placed = rests.join(F.broadcast(places), "rest").where("low <= number and number < high").select(
        "doc_id", "part", "row", "doc_tokens", "rest", "crc", "offset",
        (F.col("sequence") + F.col("number") - F.col("low")).alias("sequence_id"),
        F.when(F.col("stream") >= 0, F.col("stream") + (F.col("number") - F.col("low")) * F.col("rest")).alias("stream"),
    )
    placed = stage(placed, "places")
    at, last = F.col("stream"), F.col("stream") + F.col("rest") - 1
    uncut = F.col("stream").isNull() | (F.floor(at / window) == F.floor(last / window)) & (last < full_until)
    in_stream = F.col("stream").isNotNull()
    whole = placed.where(uncut).select(
        "doc_id", (F.col("doc_tokens") - F.col("rest")).alias("start"), F.col("rest").alias("length"), F.col("crc").alias("ids_crc32"),
        "doc_tokens",
        F.when(in_stream, F.lit(base) + F.floor(at / window)).otherwise(F.col("sequence_id")).alias("sequence_id"),
        F.when(in_stream, at % window).otherwise(F.col("offset")).alias("offset"),
    )
    cut = stage(placed.where(~uncut).select("part", "row", "stream"), "cuts")
    stored = rows.select("doc_id", "part", "row", "doc_tokens", "rest", "ids").join(checked_broadcast(cut), ["part", "row"])
    again = _cut_pieces(stored, window, full_until, tail, base)
    return full.unionByName(whole).unionByName(again)
