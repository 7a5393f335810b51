"""Lines and the records they give."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from timberline.formats import LogFormat, detect_format, parse_logs, register_format, struct_parse, unregister_format
from timberline.operators import component_dictionary, encode_components
from timberline.schema import parsed_struct

LINES = [
    # line, level, component, message
    ("2026-05-17 06:12:33 harbour Ferry[841]: ramp lowered", 1, "Ferry", "ramp lowered"),
    ("Informal note on tides", 1, None, "Informal note on tides"),
    ("Debugged pump failed again", 4, None, "Debugged pump failed again"),
    ("2026-05-17 06:12:34 ERROR ballast low", 4, None, "ballast low"),
    ("2026-05-17 06:12:34 ERROR ballast: low", 1, "ballast", "low"),
    ("May 17 06:12:34 harbour winch[9]: Errors: zero", 1, "winch", "Errors: zero"),
    ("[WARN] fog", 3, None, "fog"),
    ("CRITICAL rudder: jammed", 5, "rudder", "jammed"),
    ("[ERROR]: crane: swung", 4, "crane", "swung"),
    ("ERROR", 4, None, ""),
    ("INFO: ftp://pier.example/tide", 1, None, "ftp://pier.example/tide"),
    ("May 16 05:01:10 harbour winch[9]: <Error> Rope frayed", 4, "winch", "<Error> Rope frayed"),
    ("May 16 05:01:11 harbour winch[9]: <Notice> Rope spliced", 1, "winch", "<Notice> Rope spliced"),
    ("May 16 05:01:12 harbour winch[9] <Warning>: rope short", 3, "winch", "rope short"),
    (
        "2026-05-18T21:40:09.015Z [ERROR] radard: Lost the echo of buoy: 0xE00002D8 — antenna stalled",
        4, "radard", "Lost the echo of buoy: 0xE00002D8 — antenna stalled",
    ),
    ("2026-05-18 21:40:09.015 helm[3]: NOTICE: port: rail wet", 2, "helm", "rail wet"),
    ("2026-05-18 21:40:09.015 galley: soup served", 1, "galley", "soup served"),
    ("[2026-05-19 03:30:00.250] [info] Bell rung twice", 1, None, "Bell rung twice"),
    ("[2026-05-19 03:30:01 INFO anchor-chain] let go", 1, "anchor-chain", "let go"),
    ("[Dock] 2026-05-19 03:30:02 [info] gate opened", 1, "Dock", "gate opened"),
    ('time="2026-05-19T03:30:03+02:00" level=info msg="cry \\"ahoy\\""', 1, None, 'cry "ahoy"'),
    ('time="2026-05-19T03:30:03+02:00" level=loud msg=plain deck', 1, None, "plain deck"),
    ("Tue May 19 03:30:04.700 [gangway]/52 it timed out", 3, "gangway", "it timed out"),
    ("  [WARN] nul \u0000 inside: kept \u0000 whole", 3, None, "nul \u0000 inside: kept \u0000 whole"),
    ("2026-05-19 03:30:05 harbour a\u0000b[1]: y", 1, "a\u0000b", "y"),
]


def lines_df(spark, by_source):
    rows = [(s, i + 1, line) for s, lines in by_source.items() for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "source_id string, line_number long, raw_line string")


def test_plain_lines(spark):
    df = parse_logs(lines_df(spark, {"s": [row[0] for row in LINES]}), "plain", now="2026-06-01")
    got = [(r.level, r.component, r.message) for r in df.orderBy("line_number").collect()]
    assert got == [row[1:] for row in LINES]


def test_times(spark):
    lines = [
        "Apr  2 04:05:06 pier q[2]: y",
        "Nov 30 22:10:00 pier q[2]: y",
        "2026-02-11 09:20:31-05 harbour Tide Clock[14]: y",
        "[2026-02-12T07:08:09.5+0200] y",
        "2026-06-20 10:11:12 pier q: y",
    ]
    df = parse_logs(lines_df(spark, {"s": lines}), "plain", tz="America/New_York", now="2026-04-01")
    got = [r[0] for r in df.orderBy("line_number").select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.S")).collect()]
    assert got == [
        "2025-04-02 08:05:06.0", "2025-12-01 03:10:00.0", "2026-02-11 14:20:31.0", "2026-02-12 05:08:09.5",
        "2026-06-20 14:11:12.0",
    ]


def test_file_formats(spark):
    files = {
        "sccm": [
            '<![LOG[Moored]LOG]!><time="06:15:20.118+060" date="05-17-2026" component="Quay" context="" type="2" thread="77" file="quay.cpp">',
            "mooring failed",
        ],
        "json": ['{"ts":1779000000456,"Severity":"FATAL","msg":"keel","tid":31}', '{"message":null,"text":"hull","lvl":"loud"}'],
        "unified": ['{"timestamp":"2026-05-17 06:15:20.118000-0400","messageType":"Fault","eventMessage":"oar","processImagePath":"/opt/sea/rower","threadID":5},'],
        "csv": ["timestamp,level,component,message", '2026-05-17 06:15:20,WARN,sail,"torn, patched, and set once more"', "p,q"],
        "ips": ['{"timestamp":"2026-05-17 06:15:20.00 -0400","app_name":"Sextant","bug_type":"110","incident_id":"f00d"}', "{"],
        "diag": ["Date/Time:        2026-05-17 06:15:20.250 -0400", "2026-05-17 06:15:22 hang at the lock", "panic!"],
        "plain": ["ahoy"],
    }
    lines = lines_df(spark, files)
    found = {r.source_id: r.format for r in detect_format(lines).collect()}
    assert found == {name: name for name in files}
    rows = {
        (r.source_id, r.line_number): r for r in parse_logs(lines, "auto").collect()
    }
    sccm = rows["sccm", 1]
    assert (sccm.level, sccm.thread_id, sccm.source_ref, sccm.message) == (3, "77", "quay.cpp", "Moored")
    assert sccm.timestamp == datetime(2026, 5, 17, 6, 15, 20, 118000)
    assert rows["sccm", 2].level == 4
    assert (rows["json", 1].level, rows["json", 1].thread_id, rows["json", 1].message) == (5, "31", "keel")
    assert (rows["json", 2].level, rows["json", 2].message) == (1, "hull")
    assert (rows["unified", 1].level, rows["unified", 1].component) == (5, "rower")
    assert rows["csv", 1].message == "CSV Header: timestamp,level,component,message"
    assert (rows["csv", 2].level, rows["csv", 2].component, rows["csv", 2].message) == (3, "sail", "torn, patched, and set once more")
    top = rows["ips", 0]
    assert (top.level, top.source_ref, top.message) == (5, "header", "Sextant — bug_type 110 · incident f00d")
    assert rows["ips", 2].timestamp == datetime(2026, 5, 17, 10, 15, 20)
    assert [rows["diag", i].level for i in (1, 2, 3)] == [1, 3, 5]
    assert rows["diag", 2].timestamp == datetime(2026, 5, 17, 6, 15, 22)
    shifted = parse_logs(lines.where("source_id = 'sccm'"), "sccm", honor_offset=True).orderBy("line_number").first()
    assert shifted.timestamp == datetime(2026, 5, 17, 7, 15, 20, 118000)


def test_only_top_lines_detect(spark):
    lines = ["text"] * 60 + ["<![LOG[x]LOG]!>"] * 200
    assert detect_format(lines_df(spark, {"s": lines})).first().format == "plain"


def test_registered_format(spark):
    pipe = LogFormat(
        "pipe",
        lambda s: F.when(s.first.contains("|"), 0.99).otherwise(0.0),
        struct_parse(lambda raw, line: parsed_struct(level=F.lit(2), message=F.split(raw, r"\|")[1])),
    )
    register_format(pipe)
    try:
        df = parse_logs(lines_df(spark, {"p": ["a|b", "c|d"], "q": ["ERROR x"]}), "auto")
        got = sorted((r.source_id, r.level, r.message) for r in df.collect())
        assert got == [("p", 2, "b"), ("p", 2, "d"), ("q", 4, "x")]
    finally:
        unregister_format("pipe")
    with pytest.raises(ValueError):
        parse_logs(lines_df(spark, {"p": ["x"]}), "pipe")


def test_parsed_columns_can_be_joined_and_filtered(spark):
    """Planning must stay short when keys and filters come from a parse."""
    df = parse_logs(lines_df(spark, {"s": [row[0] for row in LINES]}), "auto", now="2026-05-01")
    df = df.withColumn("entry_id", F.col("line_number"))
    ids = component_dictionary(df.where("level >= 1"))
    named = sum(1 for _, level, component, _ in LINES if level >= 3 and component)
    assert encode_components(df.where("level >= 3"), ids).where("component_id > 0").count() == named
