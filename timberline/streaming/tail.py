"""Growing log files as a stream: complete new lines of each file, from where the last batch ended."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from timberline.sources.bytes import locate, read_range

COLUMNS = "source_id string, line_number long, raw_line string, position long"
#: First bytes that tell a file from another of the same name, and bytes that are read at a time.
HEAD, STEP = 64, 4 << 20


@dataclass
class Piece(InputPartition):
    """Lines whose ends lie in bytes ``start`` to ``end`` of a file that had ``size`` bytes and began with ``head``."""

    path: str
    start: int
    end: int
    size: int
    head: str


def new_ranges(before: dict, now: dict) -> list[tuple[str, int, int, str]]:
    """(path, from, to, head) of what two listings {path: [size, head]} differ by.

    A file that shrank, or whose first bytes are others than before, is read from its start, and so is one
    that was gone meanwhile.
    """
    out = []
    for path, (size, head) in sorted(now.items()):
        old_size, old_head = before.get(path, (0, ""))
        start = old_size if size >= old_size and head.startswith(old_head) else 0
        if size > start:
            out.append((path, start, size, head))
    return out


class TailReader(DataSourceStreamReader):
    """Offsets are listings: what a batch reads follows from two of them, also after a restart."""

    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.at_end = options.get("start", "beginning") == "end"
        self.split = int(options.get("split", 64 << 20))
        self.heads: dict[str, tuple[object, str]] = {}

    def _listing(self) -> dict:
        system, inside = locate(self.path)
        own = system.get_file_info(inside)
        found = [own] if own.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(inside, allow_not_found=True))
        prefix = self.path.rstrip("/")
        files = [
            (f, prefix if f.path == inside else f"{prefix}/{f.base_name}")
            for f in found
            if f.type == pafs.FileType.File and f.size and fnmatch.fnmatch(f.base_name, self.pattern) and not f.base_name.startswith((".", "_")) and f.extension != "gz"
        ]
        # Only files that changed are looked into.
        changed = [(f, p) for f, p in files if self.heads.get(p, (None, ""))[0] != (f.size, f.mtime_ns)]
        with ThreadPoolExecutor(16) as pool:
            heads = list(pool.map(lambda x: _head(x[1]), changed))
        for (f, p), head in zip(changed, heads):
            self.heads[p] = (f.size, f.mtime_ns), head
        self.heads = {p: self.heads[p] for _, p in files}
        return {p: [f.size, self.heads[p][1]] for f, p in files if self.heads[p][1]}

    def initialOffset(self) -> dict:
        return {"files": self._listing() if self.at_end else {}}

    def latestOffset(self) -> dict:
        return {"files": self._listing()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [
            Piece(path, a, min(a + self.split, to), to, head)
            for path, begin, to, head in new_ranges(start["files"], end["files"])
            for a in range(begin, to, self.split)
        ]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        for lines in complete_lines(partition):
            rows = [(text.removesuffix(b"\r").decode("utf-8", "replace"), at) for at, text in lines if text not in (b"", b"\r")]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([partition.path] * len(rows), pa.string()), pa.nulls(len(rows), pa.int64()),
                    pa.array([t for t, _ in rows], pa.string()), pa.array([at for _, at in rows], pa.int64()),
                ],
                names=["source_id", "line_number", "raw_line", "position"],
            )


def _head(path: str) -> str:
    try:
        return read_range(path, 0, HEAD).hex()
    except FileNotFoundError:
        return ""


def complete_lines(piece: Piece, step: int = STEP) -> Iterator[list[tuple[int, bytes]]]:
    """(place, line) of the lines that end in a piece, some at a time.

    A line that began before is read from its beginning; one that doesn't end here belongs to whichever
    piece it ends in, in this batch or a later one. If the file is no longer what was listed, what was
    there is lost, and what is there now is for the next listing.
    """
    try:
        system, inside = locate(piece.path)
        with system.open_input_file(inside) as file:
            if file.size() < piece.size or not file.read_at(HEAD, 0).hex().startswith(piece.head):
                return
            at = _line_start(file, piece.start, step)
            held = b""
            for begin in range(at, piece.end, step):
                held += file.read_at(min(step, piece.end - begin), begin)
                *lines, rest = held.split(b"\n")
                out = []
                for line in lines:
                    out.append((at, line))
                    at += len(line) + 1
                held = rest
                if out:
                    yield out
    except FileNotFoundError:
        return


def _line_start(file, place: int, step: int) -> int:
    """Where the line that holds the byte at ``place`` begins."""
    while place > 0:
        begin = max(0, place - step)
        found = file.read_at(place - begin, begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        place = begin
    return 0


class LogTail(DataSource):
    """``spark.readStream.format("log_tail")``; options path, pattern, start and split."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return COLUMNS

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def tail_log_lines(
    spark: SparkSession, path: str, pattern: str = "*", start: str = "beginning", split_bytes: int = 64 << 20
) -> DataFrame:
    """New lines of the files of a folder (or of one file) as a stream ``(source_id, line_number, raw_line, position)``.

    Each batch reads the bytes that files gained since the batch before, and of these the lines that are
    complete; the rest waits for its line end. A file that shrank, was replaced (other first bytes) or came
    back is read from its start. Large gains are read by several tasks, ``split_bytes`` each. ``start="end"``
    passes over what is there when the stream first starts. The checkpoint holds the sizes and first 64 bytes of
    the folder's files, so a restarted query goes on where it ended.

    Lines end with a line feed, empty lines are dropped, ``position`` is the line's first byte and orders a file's
    lines; ``line_number`` is null (see :class:`LiveLog`). Compressed files don't grow and are passed over.
    """
    spark.dataSource.register(LogTail)
    reader = spark.readStream.format("log_tail").option("path", path).option("pattern", pattern)
    return reader.option("start", start).option("split", str(split_bytes)).load()
