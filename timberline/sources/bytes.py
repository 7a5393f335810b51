"""Bytes of files at given places, read inside tasks through Arrow's file systems.

Spark's own readers take files whole or by split. What needs a file's head, its new tail, or blocks at
chosen places goes through here: local and mounted folders, and the stores Arrow knows by their
scheme (such as s3, gs, hdfs).
"""

from __future__ import annotations

import re
from urllib.parse import quote

import pyarrow.fs as pafs

LINE_END = re.compile(rb"\r\n|\n|\r")


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark names it, and the path in it."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    if scheme is None or scheme[1] == "file":
        rest = path if scheme is None else path[5:]
        return pafs.LocalFileSystem(), re.sub(r"^/+", "/", rest)
    return pafs.FileSystem.from_uri(quote(path, safe=":/@?=&+,;~"))


def read_range(path: str, start: int, end: int) -> bytes:
    """Bytes from ``start`` up to ``end``, or to where the file ends."""
    system, inside = locate(path)
    with system.open_input_file(inside) as file:
        return file.read_at(max(0, end - start), start) if start < file.size() else b""


def first_lines(path: str, count: int, step: int = 1 << 16) -> list[bytes]:
    """The first ``count`` lines of a plain or gzip file, reading no further than needed."""
    system, inside = locate(path)
    with system.open_input_stream(inside, compression="gzip" if inside.endswith(".gz") else None) as file:
        parts: list[bytes] = []
        found, last = 0, b""
        while found <= count:
            more = file.read(step)
            if not more:
                break
            # Line ends of two bytes may be cut; counting one too many is made up for by reading one further.
            found += len(LINE_END.findall(more)) - (last == b"\r" and more[:1] == b"\n")
            last = more[-1:]
            parts.append(more)
    lines = LINE_END.split(b"".join(parts))
    if lines and not lines[-1] and len(lines) <= count:
        lines.pop()
    return lines[:count]
