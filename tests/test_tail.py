"""Growing, truncated, replaced and vanished files, line by line."""

import os
import random

import pytest
from pyspark.sql import functions as F

from timberline.streaming import LiveLog, tail_log_lines
from timberline.streaming.tail import Piece, TailReader, complete_lines, new_ranges


class Follower:
    """A reader and what it has seen; ``restart`` keeps only the offset."""

    def __init__(self, path, **options):
        self.options = {"path": str(path), **{k: str(v) for k, v in options.items()}}
        self.restart()
        self.offset = self.reader.initialOffset()

    def restart(self):
        self.reader = TailReader(self.options)

    def poll(self):
        latest = self.reader.latestOffset()
        pieces = self.reader.partitions(self.offset, latest)
        rows = [r for p in pieces for batch in self.reader.read(p) for r in batch.to_pylist()]
        self.offset = latest
        return [(os.path.basename(r["source_id"]), r["raw_line"]) for r in sorted(rows, key=lambda r: (r["source_id"], r["position"]))]


def test_append_truncate_replace_restart(tmp_path):
    a = tmp_path / "a.log"
    a.write_text("one\ntwo\r\n\nthr")
    tail = Follower(tmp_path)
    assert tail.poll() == [("a.log", "one"), ("a.log", "two")]
    assert tail.poll() == []
    with a.open("a") as f:
        f.write("ee\nfour\nfi")
    assert tail.poll() == [("a.log", "three"), ("a.log", "four")]
    tail.restart()
    with a.open("a") as f:
        f.write("ve")
    assert tail.poll() == []
    with a.open("a") as f:
        f.write("\n")
    assert tail.poll() == [("a.log", "five")]
    # Truncated and written anew.
    a.write_text("new 1\n")
    assert tail.poll() == [("a.log", "new 1")]
    # Replaced by a larger file of the same name, as rotation does.
    a.rename(tmp_path / "a.log.1")
    a.write_text("rotated 1\nrotated 2 is longer than all before\n")
    assert tail.poll() == [("a.log", "rotated 1"), ("a.log", "rotated 2 is longer than all before"), ("a.log.1", "new 1")]
    # Gone, and back with the same text.
    text = a.read_text()
    a.unlink()
    assert tail.poll() == []
    a.write_text(text)
    tail.restart()
    assert len(tail.poll()) == 2
    (tmp_path / "b.log").write_text("late\n")
    (tmp_path / ".hidden").write_text("no\n")
    (tmp_path / "c.log.gz").write_bytes(b"no\n")
    assert tail.poll() == [("b.log", "late")]


def test_start_pattern_and_single_file(tmp_path):
    (tmp_path / "a.log").write_text("old\npart")
    (tmp_path / "b.txt").write_text("old\n")
    tail = Follower(tmp_path, start="end", pattern="*.log")
    with (tmp_path / "a.log").open("a") as f:
        f.write("ly new\nnewer\n")
    (tmp_path / "b.txt").write_text("old\nnew\n")
    assert tail.poll() == [("a.log", "partly new"), ("a.log", "newer")]
    one = Follower(tmp_path / "b.txt")
    assert one.poll() == [("b.txt", "old"), ("b.txt", "new")]
    assert Follower(tmp_path / "nowhere").poll() == []


@pytest.mark.parametrize("split", [1, 7, 1000])
def test_every_line_in_one_piece(tmp_path, split):
    rnd = random.Random(split)
    text = "".join("x" * rnd.choice([0, 1, 5, 40]) + rnd.choice(["é", ""]) + "\n" for _ in range(120)) + "open end"
    data = text.encode()
    (tmp_path / "a").write_bytes(data)
    head = data[:64].hex()
    got = []
    for a in range(0, len(data), split):
        piece = Piece(str(tmp_path / "a"), a, min(a + split, len(data)), len(data), head)
        got += [x for lines in complete_lines(piece, step=11) for x in lines]
    at, want = 0, []
    for line in data.split(b"\n")[:-1]:
        want.append((at, line))
        at += len(line) + 1
    assert got == want


def test_a_file_that_changed_after_listing_waits(tmp_path):
    (tmp_path / "a").write_text("first\nsecond\n")
    tail = Follower(tmp_path)
    latest = tail.reader.latestOffset()
    pieces = tail.reader.partitions(tail.offset, latest)
    (tmp_path / "a").write_text("x\n")
    assert [r for p in pieces for r in tail.reader.read(p)] == []
    tail.offset = latest
    assert tail.poll() == [("a", "x")]
    (tmp_path / "a").unlink()
    assert [r for p in pieces for r in tail.reader.read(p)] == []


def test_new_ranges():
    assert new_ranges({}, {"a": [5, "61"]}) == [("a", 0, 5, "61")]
    assert new_ranges({"a": [5, "6162"]}, {"a": [9, "616263"], "b": [0, ""]}) == [("a", 5, 9, "616263")]
    assert new_ranges({"a": [5, "61"]}, {"a": [4, "61"]}) == [("a", 0, 4, "61")]
    assert new_ranges({"a": [5, "61"]}, {"a": [5, "62"]}) == [("a", 0, 5, "62")]
    assert new_ranges({"a": [5, "61"]}, {}) == []


def test_stream_with_checkpoint(spark, tmp_path):
    """Query runs over a folder that changes between them, parsed and numbered."""
    logs = tmp_path / "logs"
    logs.mkdir()
    live = LiveLog(f"{tmp_path}/live", lambda: [F.col("source_id"), F.col("position")])

    def run():
        stream = tail_log_lines(spark, str(logs), split_bytes=20)
        query = stream.writeStream.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True)
        query.foreachBatch(live).start().awaitTermination()
        return [(r.line_number, r.level, r.message) for r in live.rows(spark).orderBy("line_number").collect()]

    (logs / "a.log").write_text("ERROR a1\nWARN a2\nINFO a")
    assert run() == [(1, 4, "a1"), (2, 3, "a2")]
    with (logs / "a.log").open("a") as f:
        f.write("3\n")
    (logs / "b.log").write_text("ERROR b1\n")
    assert run()[2:] == [(3, 1, "a3"), (4, 4, "b1")]
    assert len(run()) == 4
    (logs / "a.log").write_text("WARN again\n")
    assert run()[4:] == [(5, 3, "again")]
