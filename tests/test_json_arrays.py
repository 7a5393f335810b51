"""Large JSON arrays cut by blocks, file heads, and folders of any kind of file."""

import gzip
import json
import os
import random

import numpy as np
import pytest

from timberline.formats import detect_format
from timberline.sources import read_heads, read_json_array, read_log_lines, read_logs
from timberline.sources.bytes import first_lines
from timberline.sources.json_arrays import ESCAPED, INSIDE, OUTSIDE, brackets

MEMBERS = ["events", "logs", "records", "entries", "messages"]


def plain(text):
    """The array of records of a whole file; None if it isn't one."""
    try:
        value = json.loads(text)
    except ValueError:
        return None
    objects = lambda x: isinstance(x, list) and all(isinstance(o, dict) for o in x)
    if objects(value):
        return value
    if isinstance(value, dict):
        return next((value[m] for m in MEMBERS if objects(value.get(m))), None)
    return None


def test_brackets_from_any_place():
    text = '{"a\\\\": "[\\"{", "b": [1, {"c": "\\\\\\\\"}], "d\\"]": "\\\\\\""}'.encode() * 3
    data = np.frombuffer(text, np.uint8)
    whole = brackets(data, OUTSIDE)
    # The state at each cut, by reading one byte after the other.
    state = OUTSIDE
    for cut, byte in enumerate([*text, 0]):
        first, rest = brackets(data[:cut], OUTSIDE), brackets(data[cut:], state)
        assert first.state == state
        assert np.concatenate((first.at, rest.at + cut)).tolist() == whole.at.tolist(), cut
        assert rest.state == whole.state == OUTSIDE
        if state == ESCAPED:
            state = INSIDE
        elif byte == 34:
            state = INSIDE if state == OUTSIDE else OUTSIDE
        elif byte == 92 and state == INSIDE:
            state = ESCAPED


def record(rnd, depth=0):
    text = lambda: "".join(rnd.choice('ab"\\[]{},:\n é日 ') for _ in range(rnd.randrange(12)))
    value = lambda: rnd.choice([text(), rnd.randrange(100), None, True, 1.5, [], {}])
    out = {text() + str(i): value() for i in range(rnd.randrange(4))}
    if depth < 3 and rnd.random() < 0.5:
        out["n"] = [record(rnd, depth + 1), [1, [text()]], {"events": [record(rnd, 3)]}]
    return out


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_arrays_by_blocks(spark, tmp_path, block):
    rnd = random.Random(block)
    files = {
        "array": [record(rnd) for _ in range(40)],
        "envelope": {"meta": {"logs": [{"not": "this"}], "x": [[1], {}]}, "n": [1, 2], "logs": [record(rnd) for _ in range(30)], "z": {"records": [{}]}},
        "order": {"messages": [{"m": 1}], "entries": [{"e": i} for i in range(9)], "events": [1, {"no": 1}], "logs": "text"},
        "empty": [], "none": {"events": [], "logs": [{"l": 1}]}, "nested": [[{"a": 1}]], "mixed": [{"a": 1}, 2], "value": "text [{", "object": {"other": [{"a": 1}]},
    }
    texts = {n: json.dumps(v, ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, 1, 4])) for n, v in files.items()}
    texts |= {"lines": '{"a": 1}\n{"a": 2}\n', "cut": '[{"a": 1}, {"b": ', "twice": '[{"a": 1}] [{"b": 1}]', "commas": '[{"a": 1} {"b": 1}]', "blank": " \n", "spaced": '\n\n [ {"a" : [ 1 ]} , {} ]\n '}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    (tmp_path / "zero.json").write_text("")
    got = {n: [] for n in texts}
    for r in read_json_array(spark, str(tmp_path), block).collect():
        assert r.entry_id == r.line_number - 1
        got[os.path.basename(r.source_id)[:-5]].append((r.line_number, json.loads(r.raw_line)))
    for name, text in texts.items():
        want = plain(text)
        assert sorted(got[name], key=lambda x: x[0]) == [(i + 1, o) for i, o in enumerate(want or [])], name


def test_objects_are_compact(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"logs": [\n {"b" : 1.50, "a": "x y"},\n {"m":"q","n": { "a":[1, 2]}}]}')
    with gzip.open(tmp_path / "b.json.gz", "wt") as f:
        f.write('[{"g": 1}, {"g": 2}]')
    rows = read_json_array(spark, str(tmp_path)).orderBy("source_id", "line_number").collect()
    assert [r.raw_line for r in rows] == ['{"b":1.5,"a":"x y"}', '{"m":"q","n":{"a":[1,2]}}', '{"g":1}', '{"g":2}']


def test_many_tasks_for_one_file(spark, tmp_path):
    rows = [{"level": "warn", "message": f"m{i} \" ] }} \\", "n": {"i": [i]}} for i in range(20_000)]
    (tmp_path / "one.json").write_text(json.dumps({"records": rows}))
    df = read_json_array(spark, str(tmp_path), block=50_000)
    assert df.rdd.getNumPartitions() >= 4
    parts = df.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    assert sum(parts) == 20_000 and max(parts) < 15_000
    got = sorted(((r.line_number, json.loads(r.raw_line)) for r in df.collect()), key=lambda x: x[0])
    assert got == [(i + 1, r) for i, r in enumerate(rows)]


def test_first_lines_only(tmp_path):
    for name, end in (("n", "\n"), ("rn", "\r\n"), ("r", "\r")):
        text = end.join(["", "a" * 9, "", "b" * 70_000, *(f"line {i}" for i in range(100))])
        (tmp_path / name).write_bytes(text.encode())
        with gzip.open(tmp_path / f"{name}.gz", "wb") as f:
            f.write(text.encode())
        for path in (f"{tmp_path}/{name}", f"file:{tmp_path}/{name}", f"file://{tmp_path}/{name}.gz"):
            for step in (3, 1000, 1 << 16):
                assert first_lines(path, 50, step) == [b"", b"a" * 9, b"", b"b" * 70_000, *(f"line {i}".encode() for i in range(46))]
    (tmp_path / "short").write_bytes(b"x\ny\n")
    assert first_lines(f"{tmp_path}/short", 50) == [b"x", b"y"]
    (tmp_path / "zero").write_bytes(b"")
    assert first_lines(f"{tmp_path}/zero", 50) == []


def folder(tmp_path):
    root = tmp_path / "a b"
    root.mkdir()
    (root / "plain.log").write_text("\nERROR pipe burst\n" * 80)
    (root / "lines.log").write_text("".join(f'{{"level":"warn","message":"m{i}"}}\n' for i in range(60)))
    (root / "array.json").write_text(json.dumps([{"level": "error", "message": f"a{i}"} for i in range(5)], indent=2))
    (root / "envelope.json").write_text(json.dumps({"level": "info", "message": "env", "events": [{"level": "debug", "message": "e0"}]}))
    (root / "unified.json").write_text(json.dumps([{"messageType": "Error", "eventMessage": "u0", "subsystem": "s"}], indent=1))
    (root / "single.log").write_text('{"level":"warn","message":"alone"}\n')
    (root / "report.ips").write_text('{"timestamp":"2026-05-01 08:00:00.00 +0000","app_name":"Pump","bug_type":"309"}\nbody\n')
    with gzip.open(root / "packed.log.gz", "wt") as f:
        f.write("2026-05-01 08:00:00 host app[1]: started\n" * 3)
    return str(root)


def test_heads_detect_like_all_lines(spark, tmp_path):
    path = folder(tmp_path)
    heads = read_heads(spark, path)
    whole = {tuple(r) for r in detect_format(read_log_lines(spark, path)).collect()}
    assert {tuple(r) for r in detect_format(heads).collect()} == whole and len(whole) == 8
    first = read_log_lines(spark, path).where("line_number <= 50").select("source_id", "line_number", "raw_line")
    assert sorted(map(tuple, heads.collect())) == sorted(map(tuple, first.collect()))


def test_bytes_read_stay_flat(spark, tmp_path, monkeypatch):
    """A head costs the same however long the file is."""
    import timberline.sources.bytes as by

    read = []

    class Counting:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def read(self, n):
            read.append(n)
            return self.file.read(n)

    place = by.locate

    class System:
        def __init__(self, system):
            self.system = system

        def open_input_stream(self, inside, compression):
            return Counting(self.system.open_input_stream(inside, compression=compression))

    monkeypatch.setattr(by, "locate", lambda p: (System(place(p)[0]), place(p)[1]))
    for n in (1000, 100_000):
        (tmp_path / "x.log").write_text("".join(f"line {i} of some text\n" for i in range(n)))
        assert len(first_lines(f"{tmp_path}/x.log", 50)) == 50
    assert read == [1 << 16, 1 << 16]


def test_read_logs_takes_a_folder_as_it_is(spark, tmp_path):
    rows = read_logs(spark, folder(tmp_path)).collect()
    by = {}
    for r in rows:
        by.setdefault(os.path.basename(r.source_id), []).append((r.line_number, r.level, r.message))
    assert sorted(by["array.json"]) == [(i + 1, 4, f"a{i}") for i in range(5)]
    assert by["envelope.json"] == [(1, 0, "e0")]
    assert by["unified.json"] == [(1, 4, "u0")]
    assert by["single.log"] == [(1, 3, "alone")]
    assert len(by["lines.log"]) == 60 and len(by["plain.log"]) == 80 and len(by["packed.log.gz"]) == 3
    assert sorted(n for n, _, _ in by["report.ips"]) == [0, 1, 2]
    one = read_logs(spark, os.path.join(str(tmp_path), "a b", "lines.log"), "json").collect()
    assert {r.level for r in one} == {3} and len(one) == 60
