"""Streams run to the end, batch by batch."""

import time

import pandas as pd
from pyspark.sql import functions as F

from timberline.formats import parse_logs
from timberline.plans import views as V
from timberline.streaming import LiveLog, rate_and_stall, stream_log_lines, stream_table, time_windows, to_table
from timberline.streaming.live import LiveHistogram
from timberline.streaming.rates import _combine, tick

SF = "/root/testdata/sf0.001"


def batches(spark, tmp_path, groups):
    (tmp_path / "in").mkdir()
    for i, lines in enumerate(groups):
        (tmp_path / "in" / f"{i}.log").write_text("\n".join(lines) + "\n")
    return stream_log_lines(spark, f"{tmp_path}/in/{{0,1,2,3}}.log", files_per_trigger=1)


def test_pause_between_batches(spark, tmp_path):
    groups = [["ERROR a", "b"], ["c", "", "d", "e"], ["f"], ["INFO g"]]
    lines = batches(spark, tmp_path, groups).withColumn("_o", F.col("raw_line"))
    asked = iter([False, True, True, False])
    live = LiveLog(f"{tmp_path}/log", lambda: [F.col("_o")], paused=lambda: next(asked), capacity=3)
    query = lines.writeStream.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True)
    query.foreachBatch(live).start().awaitTermination()
    rows = live.rows(spark).orderBy("line_number").collect()
    # Files arrive in any order within a run of equal times, so check shape, not names.
    assert [r.line_number for r in rows] == list(range(1, len(rows) + 1))
    status = [live.status(spark, b).first() for b in range(4)]
    assert [s.held for s in status][0] == 0 and max(s.held for s in status) <= 3 and status[3].held == 0
    assert sorted(r.level for r in rows if r.message in ("a", "g")) in ([1, 4], [4], [1])
    assert all(r.level is not None for r in rows)
    arrived = sum(1 for g in groups for x in g if x)
    assert len(rows) + status[2].dropped == arrived == 7


def test_live_histogram_remembers_peaks(spark, tmp_path):
    log = V.as_events_log(stream_table(spark, f"{SF}/events.parquet"))
    handler = LiveHistogram(f"{tmp_path}/h", buckets=10)
    query = time_windows(log, "1 day").writeStream.outputMode("complete").trigger(availableNow=True)
    query.option("checkpointLocation", f"{tmp_path}/cp").foreachBatch(handler).start().awaitTermination()
    bars = spark.read.parquet(f"{tmp_path}/h/bars/batch=0")
    assert bars.count() <= 10 and bars.agg(F.sum("total")).first()[0] == V.events_log(spark, SF).count()
    # A spike in the bars of one batch shadows the calmer bars of the next.
    windows = [(i * 10, i * 10 + 10, 0, 0, 200 if i == 5 else 5) for i in range(30)]
    schema = "start_us long, end_us long, err long, warn long, info long"
    handler = LiveHistogram(f"{tmp_path}/g", buckets=30)
    handler(spark.createDataFrame(windows, schema), 0)
    more = windows[:-1] + [(i * 10, i * 10 + 10, 0, 0, 5) for i in range(29, 60)]
    more[5] = (50, 60, 0, 0, 50)
    handler(spark.createDataFrame(more, schema), 1)
    assert [(r.bucket, r.peak_count) for r in spark.read.parquet(f"{tmp_path}/g/shadows/batch=1").collect()] == [(2, 200)]


def test_rate_ticks():
    state = (0.0, 100, 0, 0)
    state = tick(*state, 100, 10)
    assert state == (0.0, 100, 10, 0)
    state = tick(*state, 101, 0)
    assert state == (4.0, 101, 0, 0)
    rate, second, pending, idle = tick(*state, 107, 3)
    assert (second, pending, idle) == (107, 3, 6) and abs(rate - 4.0 * 0.6**6) < 1e-9
    combined = list(_combine(iter([pd.DataFrame({"source_id": ["a", "a", "b"], "n": [1, 1, 1]})])))
    assert combined[0]["n"].tolist() == [2, 1]


def test_rate_stream(spark, tmp_path):
    lines = batches(spark, tmp_path, [["a", "b"], ["c"], [], []])
    out = []
    # The timers that notice silence go on for ever, so the query is stopped, not awaited.
    query = rate_and_stall(lines).writeStream.outputMode("update").trigger(processingTime="1 second")
    query = query.option("checkpointLocation", f"{tmp_path}/cp").foreachBatch(lambda df, _: out.extend(df.collect()))
    running = query.start()
    try:
        for _ in range(60):
            time.sleep(0.5)
            if sum(r.lines for r in out) == 3 and any(r.idle_seconds > 0 for r in out):
                break
    finally:
        running.stop()
    assert sum(r.lines for r in out) == 3 and any(r.idle_seconds > 0 for r in out)


def test_each_live_source_has_its_own_header(spark, tmp_path):
    groups = [
        ["timestamp,level,component,message", f"2026-05-0{n} 08:00:00,WARN,pump,flow {n}", f"2026-05-0{n} 09:00:00,INFO,pump,flow again"]
        for n in (1, 2, 3)
    ]
    lines = batches(spark, tmp_path, groups)
    live = LiveLog(f"{tmp_path}/log", lambda: [F.col("raw_line").startswith("2026"), F.col("raw_line")])
    query = lines.writeStream.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True)
    query.foreachBatch(live).start().awaitTermination()
    rows = live.rows(spark).orderBy("line_number").collect()
    assert [r.line_number for r in rows] == list(range(1, 10))
    assert sum(r.message.startswith("CSV Header: ") for r in rows) == 3
    assert sorted(r.level for r in rows if r.component == "pump") == [1, 1, 1, 3, 3, 3]


def test_reports_on_a_stream_keep_their_text(spark, tmp_path):
    lines = batches(spark, tmp_path, [["Date/Time: 2026-05-01 08:00:00", "stuck"], ["{", "x"]])
    for fmt in ("diag", "ips", "unheard"):
        out = to_table(parse_logs(lines.withColumn("format", F.lit(fmt)), "column"), label="reports")
        assert sorted((r.level, r.message) for r in out.collect()) == [(1, "Date/Time: 2026-05-01 08:00:00"), (1, "stuck"), (1, "x"), (1, "{")]
    assert to_table(parse_logs(lines, "diag"), label="reports").where("message = raw_line").count() == 4
