"""Files in, files out."""

import gzip
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from timberline.formats import parse_logs
from timberline.sinks import write_csv, write_json, write_text
from timberline.sources import (
    compact_ingested, current_files, file_category, ingest_changed, log_catalog, read_ingested, read_json_array, read_log_lines, read_log_table,
    write_log_table,
)


@pytest.fixture
def folder(tmp_path):
    random.seed(7)
    made = {}
    (tmp_path / "in").mkdir()
    for n in range(2):
        lines = [
            "" if random.random() < 0.1 else f"2026-03-08 13:46:{i % 60:02d} host app{n}[1]: line {i}"
            for i in range(4000)
        ]
        made[f"a{n}.log"] = lines
        (tmp_path / "in" / f"a{n}.log").write_text("\n".join(lines) + "\n")
    with gzip.open(tmp_path / "in" / "z.log.gz", "wt", newline="") as f:
        f.write("\r\n".join(made["a0.log"]))
    made["z.log.gz"] = made["a0.log"]
    return tmp_path, made


def test_line_numbers_over_splits(spark, folder):
    root, made = folder
    df = read_log_lines(spark, f"{root}/in")
    assert df.rdd.getNumPartitions() > 3
    got = defaultdict(list)
    for r in df.collect():
        got[os.path.basename(r.source_id)].append((r.line_number, r.entry_id, r.raw_line))
    for name, lines in made.items():
        kept = [(i + 1, line) for i, line in enumerate(lines) if line]
        assert sorted(got[name]) == [(n, i, line) for i, (n, line) in enumerate(kept)]
    assert read_log_lines(spark, f"{root}/in/a0.log", keep_empty=True).count() == 4000


def test_lines_stay_where_they_are(spark, folder, monkeypatch):
    """Whatever Spark's own limit, lines are joined to their blocks in place; beyond the table's bound they move."""
    from timberline.sources import lines

    root, _ = folder
    want = sorted(map(tuple, read_log_lines(spark, f"{root}/in").collect()))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = read_log_lines(spark, f"{root}/in")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted(map(tuple, df.collect())) == want
        monkeypatch.setattr(lines, "SENT_BLOCKS", 0)
        df = read_log_lines(spark, f"{root}/in")
        assert "SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, df.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_catalog(spark, folder):
    root, _ = folder
    for name in ("Spin1.ips", "JetsamEvent-1.ips", "app.crash", ".hidden.log", "data.gz"):
        (root / "in" / name).write_text("x\n")
    (root / "in" / "empty.log").write_text("")
    (root / "in" / "sub").mkdir()
    (root / "in" / "sub" / "deep.log").write_text("x\n")
    got = {r.name: r.category for r in log_catalog(spark, f"{root}/in").collect()}
    assert got == {
        "a0.log": "log", "a1.log": "log", "z.log.gz": "log", "Spin1.ips": "spin", "JetsamEvent-1.ips": "diagnostic",
        "app.crash": "crash",
    }
    assert spark.range(1).select(file_category(F.lit("x.diag"))).first()[0] == "diagnostic"


def test_ingest_only_what_changed(spark, folder):
    root, made = folder
    table = f"{root}/table"
    assert ingest_changed(spark, log_catalog(spark, f"{root}/in"), table) == 3
    assert read_ingested(spark, table).count() == sum(sum(1 for x in v if x) for v in made.values())
    assert ingest_changed(spark, log_catalog(spark, f"{root}/in"), table) == 0
    (root / "in" / "a1.log").write_text("[WARN] one\n\nx\n")
    assert ingest_changed(spark, log_catalog(spark, f"{root}/in"), table) == 1
    now = read_ingested(spark, table).where(F.col("source_id").endswith("a1.log"))
    assert [(r.line_number, r.level) for r in now.orderBy("line_number").collect()] == [(1, 3), (3, 1)]


def test_ingest_of_json_and_reports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "j.log").write_text("".join(f'{{"level":"warn","message":"m{i}"}}\n' for i in range(5)))
    (tmp_path / "in" / "r.ips").write_text('{"timestamp":"2026-05-01 08:00:00.00 +0000","app_name":"Pump","bug_type":"309"}\nbody\n')
    (tmp_path / "in" / "p.log").write_text("ERROR pipe burst\n")
    table, root = f"{tmp_path}/t", f"{tmp_path}/in"
    assert ingest_changed(spark, log_catalog(spark, root), table) == 3
    rows = read_ingested(spark, table)
    got = sorted((os.path.basename(r.source_id), r.line_number) for r in rows.collect())
    assert got == [("j.log", n) for n in range(1, 6)] + [("p.log", 1)] + [("r.ips", n) for n in range(3)]
    assert rows.where("message is null").count() == 0
    (tmp_path / "in" / "j.log").unlink()
    assert ingest_changed(spark, log_catalog(spark, root), table) == 0
    assert read_ingested(spark, table).count() == 4
    assert ingest_changed(spark, log_catalog(spark, root), table) == 0


def _messages(spark, table):
    return sorted(r.message for r in read_ingested(spark, table).collect())


def test_ingest_in_groups_survives_a_crash(spark, tmp_path, monkeypatch):
    from timberline.sources import tables

    folder, table = tmp_path / "in", f"{tmp_path}/t"
    folder.mkdir()
    for n in range(9):
        (folder / f"f{n}.log").write_text(f"ERROR old {n}\n")
    wrote = []

    def crashing(df, path):
        wrote.append(path)
        write_log_table(df, path)
        if len(wrote) == 2:
            raise RuntimeError("executor and driver lost")

    with monkeypatch.context() as m:
        m.setattr(tables, "write_log_table", crashing)
        with pytest.raises(RuntimeError):
            ingest_changed(spark, log_catalog(spark, str(folder)), table, group_files=3)
    done = current_files(spark, table).count()
    assert 0 < done < 9 and read_ingested(spark, table).count() == done
    # The next run does the rest only.
    assert ingest_changed(spark, log_catalog(spark, str(folder)), table, group_files=3) == 9 - done
    assert _messages(spark, table) == [f"old {n}" for n in range(9)]


def test_compaction_drops_what_is_not_current(spark, tmp_path):
    folder, table = tmp_path / "in", f"{tmp_path}/t"
    folder.mkdir()
    assert compact_ingested(spark, table) == 0
    for n in range(4):
        (folder / f"f{n}.log").write_text(f"ERROR old {n}\nWARN more {n}\n")
    ingest_changed(spark, log_catalog(spark, str(folder)), table, group_files=2)
    before = len(list((tmp_path / "t" / "rows").iterdir()))
    (folder / "f0.log").write_text("ERROR new\n")
    (folder / "f1.log").unlink()
    ingest_changed(spark, log_catalog(spark, str(folder)), table)
    want = ["more 2", "more 3", "new", "old 2", "old 3"]
    assert _messages(spark, table) == want
    assert compact_ingested(spark, table) >= 1
    assert _messages(spark, table) == want
    live = {r.generation for r in current_files(spark, table).collect()}
    folders = {int(p.name.split("=")[1]) for p in (tmp_path / "t" / "rows").iterdir()}
    assert folders == live and len(folders) <= before + 1
    # Going on from the compacted table.
    assert ingest_changed(spark, log_catalog(spark, str(folder)), table) == 0
    (folder / "f4.log").write_text("INFO last\n")
    assert ingest_changed(spark, log_catalog(spark, str(folder)), table) == 1
    assert _messages(spark, table) == sorted([*want, "last"])
    assert compact_ingested(spark, table) == 0


def test_log_table_keeps_rows(spark, folder):
    root, _ = folder
    df = parse_logs(read_log_lines(spark, f"{root}/in/a0.log"), "plain")
    write_log_table(df, f"{root}/t", ranges=3)
    back = read_log_table(spark, f"{root}/t")
    assert back.count() == df.count()
    assert back.where("day = '2026-03-08'").agg(F.max("line_number")).first()[0] == df.agg(F.max("line_number")).first()[0]


def test_json_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"logs": [\n {"level":"error","message":"m1"},\n {"message":"m2","n":{"a":[1]}}]}')
    (tmp_path / "b.json").write_text('[{"message":"q"},\n{"message":"r"}]')
    (tmp_path / "c.json").write_text('{"other": 1}')
    df = parse_logs(read_json_array(spark, str(tmp_path)), "json").orderBy("source_id", "line_number")
    assert [(r.line_number, r.level, r.message) for r in df.collect()] == [(1, 4, "m1"), (2, 1, "m2"), (1, 1, "q"), (2, 1, "r")]


def _text(path):
    return "".join(open(os.path.join(path, n)).read() for n in sorted(os.listdir(path)) if n.startswith("part"))


def test_exports(spark, tmp_path):
    rows = [
        (7, None, 4, "boom", "kernel", "raw 7", "s"),
        (8, None, 1, 'say "hi", ok', 'foo"bar', "raw 8", "s"),
        (9, None, 0, "x", None, "raw 9", "s"),
    ]
    df = spark.createDataFrame(
        rows, "line_number long, timestamp timestamp, level int, message string, component string, raw_line string, source_id string"
    ).repartition(3)
    write_csv(df, f"{tmp_path}/csv")
    assert _text(f"{tmp_path}/csv").splitlines() == [
        "Line,Timestamp,Level,Component,Message", '7,"",ERR,"kernel","boom"', '8,"",INFO,"foo""bar","say ""hi"", ok"',
        '9,"",DBG,"","x"',
    ]
    write_json(df, f"{tmp_path}/json")
    assert _text(f"{tmp_path}/json").splitlines()[0] == '{"component":"kernel","level":"Error","line":7,"message":"boom"}'
    write_text(df, f"{tmp_path}/text")
    assert _text(f"{tmp_path}/text") == "raw 7\nraw 8\nraw 9\n"
