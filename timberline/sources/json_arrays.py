"""Objects of large JSON arrays: one file is cut into objects by many tasks.

Whether a byte stands in a string, and how deep, depends on everything before it. A block of bytes
sums that up for what follows: for each way it may begin (outside a string, inside, inside after a
backslash) how it ends and by how much the depth changes. Folding these small sums over a file's
blocks gives each block its true beginning. A second look at the blocks finds the arrays and counts their
objects, a second fold numbers them, and each block then hands out the objects that begin in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.session import list_in_few_tasks, stage
from timberline.sources.bytes import read_range
from timberline.sources.heads import file_list

#: Bytes in a block, and bytes before it in which the name of an array is looked for.
BLOCK = 4 << 20
LOOK_BACK = 1 << 16
# Members of an envelope that may hold the records, in order.
MEMBERS = ["events", "logs", "records", "entries", "messages"]

OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
_NAME = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*\Z', re.DOTALL)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
_STEP = np.zeros(256, np.int64)
_STEP[[ord("["), ord("{")]] = 1
_STEP[[ord("]"), ord("}")]] = -1


@dataclass
class Marks:
    """Brackets outside strings: where, which, the depth after each (from 0 at the start); the state at the end."""

    at: np.ndarray
    char: np.ndarray
    depth: np.ndarray
    state: int


def brackets(data: np.ndarray, state: int) -> Marks:
    """The brackets of ``data`` outside strings, if it begins in ``state``."""
    slash = np.flatnonzero(data == 92)
    if state == ESCAPED and len(slash) and slash[0] == 0:
        slash = slash[1:]  # it is itself escaped
    first = slash[np.concatenate(([True], np.diff(slash) != 1))] if len(slash) else slash
    last = slash[np.concatenate((np.diff(slash) != 1, [True]))] if len(slash) else slash
    escaped = (last + 1)[(last - first) % 2 == 0]
    if state == ESCAPED:
        escaped = np.concatenate(([0], escaped))
    quote = np.setdiff1d(np.flatnonzero(data == 34), escaped, assume_unique=True)
    opened = int(state != OUTSIDE)
    at = np.flatnonzero(_STEP[data])
    at = at[(np.searchsorted(quote, at) + opened) % 2 == 0]
    inside = (len(quote) + opened) % 2
    end = OUTSIDE if not inside else ESCAPED if len(escaped) and escaped[-1] == len(data) else INSIDE
    if not len(data):
        end = state
    return Marks(at, data[at], np.cumsum(_STEP[data[at]]), end)


def _bytes(path: str, start: int, end: int) -> np.ndarray:
    return np.frombuffer(read_range(path, start, end), np.uint8)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's sum: the state and change of depth for each state it may begin in; its first character."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            data = _bytes(row["path"], row["start"], row["end"])
            marks = [brackets(data, s) for s in (OUTSIDE, INSIDE, ESCAPED)]
            solid = np.flatnonzero(~_SPACE[data])
            deep = [int(m.depth[-1]) if len(m.depth) else 0 for m in marks]
            rows.append(row | {"states": [m.state for m in marks], "deep": deep, "first": int(data[solid[0]]) if len(solid) else None})
        yield pa.RecordBatch.from_pylist(rows, schema=_arrow(SUMS))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


PLACE = "path string, source_id string, start long, end long"
SUMS = f"{PLACE}, states array<int>, deep array<long>, first int"
STARTS = f"{PLACE}, state int, depth long, inner long"
FOUND = f"{STARTS}, part int, member string, open long, close long, still int, objects long, wrong long, commas long, tops long, stray long"
RANGES = f"{STARTS}, from long, to long, number long"


def _placed(table: pa.Table) -> pa.Table:
    """A file's blocks with the state and depth they begin in; none if the file isn't one whole value."""
    rows = sorted(table.to_pylist(), key=lambda r: r["start"])
    first = next((r["first"] for r in rows if r["first"] is not None), None)
    state, depth, out = OUTSIDE, 0, []
    for r in rows:
        place = {n: r[n] for n in ("path", "source_id", "start", "end")}
        # Records are one level below an array, two below an envelope.
        out.append(place | {"state": state, "depth": depth, "inner": 1 if first == ord("[") else 2})
        depth += r["deep"][state]
        state = r["states"][state]
    whole = state == OUTSIDE and depth == 0 and first in (ord("["), ord("{"))
    return pa.Table.from_pylist(out if whole else [], schema=_arrow(STARTS))


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: part 0 is what stands before the first end of an array of records that began earlier; each
    array that begins here, and may hold the records or reaches into the next block, is a part of its own."""
    for batch in batches:
        rows = [part for row in batch.to_pylist() for part in _parts(row)]
        yield pa.RecordBatch.from_pylist(rows, schema=_arrow(FOUND))


def _parts(row: dict) -> list[dict]:
    data, inner = _bytes(row["path"], row["start"], row["end"]), row["inner"]
    marks = brackets(data, row["state"])
    after = row["depth"] + marks.depth
    before = after - _STEP[marks.char]
    opens = marks.at[(marks.char == ord("[")) & (before == inner - 1)]
    closes = marks.at[(marks.char == ord("]")) & (after == inner - 1)]
    objects = marks.at[(marks.char == ord("{")) & (before == inner)]
    nested = marks.at[(marks.char == ord("[")) & (before == inner)]
    # Between brackets the depth stays: there, only blanks and commas may stand beside objects.
    def between(depth: int) -> np.ndarray:
        edges = np.concatenate(([0], marks.at + 1)), np.concatenate((marks.at, [len(data)]))
        here = np.concatenate(([row["depth"]], after)) == depth
        change = np.zeros(len(data) + 1, np.int8)
        change[edges[0][here]] += 1
        change[edges[1][here]] -= 1
        return np.cumsum(change[:-1], dtype=np.int8).astype(bool) & ~_SPACE[data]

    level = between(inner)
    commas = np.flatnonzero(level & (data == ord(",")))
    wrong = np.sort(np.concatenate((np.flatnonzero(level & (data != ord(","))), nested)))
    tops = int((before == 0).sum() - ((before == 0) & (_STEP[marks.char] < 0)).sum())
    stray = int(between(0).sum())
    base = row | {"tops": tops, "stray": stray}
    count = lambda x, a, b: int(np.searchsorted(x, b) - np.searchsorted(x, a))

    def part(number: int, member: str | None, start: int | None, begin: int) -> dict:
        k = np.searchsorted(closes, begin)
        close = int(closes[k]) if k < len(closes) else None
        end = len(data) if close is None else close
        return base | {
            "part": number, "member": member, "open": None if start is None else row["start"] + start, "close": None if close is None else row["start"] + close,
            "still": int(close is None), "objects": count(objects, begin, end), "wrong": count(wrong, begin, end), "commas": count(commas, begin, end),
        }

    out = [part(0, None, None, 0)]
    for number, start in enumerate(opens.tolist()):
        member = "" if inner == 1 else _member(row, start)
        made = part(number + 1, member, start, start + 1)
        if made["still"] or member in ("", *MEMBERS):
            out.append(made)
    return out


def _member(row: dict, at: int) -> str | None:
    """The name of the member whose value begins ``at`` bytes into the block."""
    end = row["start"] + at
    name = _NAME.search(read_range(row["path"], max(0, end - LOOK_BACK), end))
    return name[1].decode("utf-8", "replace") if name else None


def _numbered(table: pa.Table) -> pa.Table:
    """The blocks of the array of records, and how many of its objects come before each block."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["start"], r["part"]))
    blocks = {r["start"]: r for r in rows}
    whole = sum(r["tops"] for r in blocks.values()) == 1 and not any(r["stray"] for r in blocks.values())
    found: dict[str, list[dict]] = {}
    going = None  # the parts of the array that reaches into the next block
    for r in rows:
        if r["part"] == 0:
            if going is None:
                continue
            going.append(r)
            if not r["still"]:
                going = None
        else:
            parts = [r]
            found.setdefault(r["member"], parts) if r["member"] in ("", *MEMBERS) else None
            going = parts if r["still"] else None
    out = []
    for member in ["", *MEMBERS] if whole else []:
        parts = found.get(member)
        if parts is None:
            continue
        objects = sum(p["objects"] for p in parts)
        if any(p["wrong"] for p in parts) or sum(p["commas"] for p in parts) != max(objects - 1, 0):
            continue
        number = 0
        for p in parts:
            span = {"from": p["start"] if p["open"] is None else p["open"] + 1, "to": p["end"] if p["close"] is None else p["close"], "number": number}
            out.append({n: p[n] for n in ("path", "source_id", "start", "end", "state", "depth", "inner")} | span)
            number += p["objects"]
        break
    return pa.Table.from_pylist(out, schema=_arrow(RANGES))


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source_id, line_number, raw): the objects that begin in a block, read on to their ends."""
    for batch in batches:
        for row in batch.to_pylist():
            data = _bytes(row["path"], row["start"], row["end"])
            marks = brackets(data, row["state"])
            after = row["depth"] + marks.depth
            begins = marks.at[(marks.char == ord("{")) & (after == row["inner"] + 1)]
            begins = begins[(begins >= row["from"] - row["start"]) & (begins < row["to"] - row["start"])]
            ends = marks.at[(marks.char == ord("}")) & (after == row["inner"])]
            ends = ends[np.searchsorted(ends, begins[0]) :][: len(begins)] if len(begins) else ends[:0]
            texts = [data[a : b + 1].tobytes() for a, b in zip(begins.tolist(), ends.tolist())]
            if len(ends) < len(begins):
                texts.append(_to_end(row["path"], row["start"] + int(begins[-1]), row["end"]))
            number = row["number"] + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["source_id"]] * len(texts), pa.string()), pa.array(range(number, number + len(texts)), pa.int64()),
                    pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()),
                ],
                names=["source_id", "line_number", "raw"],
            )


def _to_end(path: str, start: int, known: int) -> bytes:
    """The object that begins at ``start`` and goes on beyond ``known``."""
    size = known - start + (1 << 16)
    while True:
        data = read_range(path, start, start + size)
        marks = brackets(np.frombuffer(data, np.uint8), OUTSIDE)
        end = np.flatnonzero(marks.depth == 0)
        if len(end):
            return data[: int(marks.at[end[0]]) + 1]
        if len(data) < size:
            return data
        size *= 2


def _dealt(df: DataFrame) -> DataFrame:
    """Blocks over all tasks: rows are few and small but mean much work, so their size says nothing."""
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, "path", "start")


def array_ranges(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """Where the records of listed files ``(path, source_id, size)`` stand, by block.

    A file counts if it is one JSON value: an array of objects, or an object in which one of the members
    ``events, logs, records, entries, messages``, the first of these that is an array of objects, holds
    the records. Other files have no rows, nor has a file whose brackets don't match.
    """
    listed = files.where("size > 0").select("path", "source_id", "size")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block).cast("long")))
    blocks = listed.select("path", "source_id", "size", starts.alias("start"))
    blocks = blocks.select("path", "source_id", "start", F.least(F.col("start") + block, "size").alias("end"))
    sums = _dealt(blocks).mapInArrow(_sums, SUMS)
    placed = stage(sums.groupBy("path").applyInArrow(_placed, STARTS), "blocks")
    return stage(_dealt(placed).mapInArrow(_arrays, FOUND).groupBy("path").applyInArrow(_numbered, RANGES), "ranges")


def array_objects(ranges: DataFrame) -> DataFrame:
    """``(source_id, line_number, raw_line)``: the objects in :func:`array_ranges`.

    ``line_number`` is the object's position from 1, ``raw_line`` the compact object; an object that isn't
    valid in itself keeps its text. Tasks hold a block, or an object if that is larger.
    """
    objects = _dealt(ranges).mapInArrow(_objects, "source_id string, line_number long, raw string")
    compact = F.get(F.from_json(F.concat(F.lit("["), "raw", F.lit("]")), "array<string>"), F.lit(0))
    return objects.select("source_id", "line_number", F.coalesce(compact, "raw").alias("raw_line"))


def read_json_array(spark: SparkSession, path: str | list[str], block: int = BLOCK) -> DataFrame:
    """``(source_id, line_number, entry_id, raw_line)``: the objects of files that are JSON arrays.

    See :func:`array_ranges` and :func:`array_objects`. A gzip file is unpacked by one task.
    """
    rows = array_objects(array_ranges(file_list(spark, path).where(~F.col("path").endswith(".gz")), block))
    rows = rows.unionByName(_unpacked(spark, path))
    return rows.select("source_id", "line_number", (F.col("line_number") - 1).alias("entry_id"), "raw_line")


def _unpacked(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Objects of gzip files, each read by one task: they can't be entered midway."""
    list_in_few_tasks(spark)
    whole = spark.read.option("pathGlobFilter", "*.gz").text(path, wholetext=True)
    text = whole.select(F.col("_metadata.file_path").alias("source_id"), F.trim("value").alias("_text"))
    envelope = F.from_json("_text", "map<string,string>")
    member = F.coalesce(
        *[F.when(F.forall(items, lambda o: o.startswith("{")), items) for items in (F.from_json(F.element_at(envelope, F.lit(k)), "array<string>") for k in MEMBERS)]
    )
    items = F.when(F.col("_text").startswith("["), F.from_json("_text", "array<string>")).otherwise(member)
    objects = F.when(F.forall(items, lambda o: o.startswith("{")), items)
    return text.select("source_id", F.posexplode(objects).alias("_i", "raw_line")).select("source_id", (F.col("_i") + 1).cast("long").alias("line_number"), "raw_line")
