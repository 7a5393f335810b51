"""What a query does for each row or file, so that its time grows with the input alone."""

from timberline.formats import parse_logs
from timberline.plans import views as V


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_report_headers_are_read_once(spark):
    lines = V.report_lines(spark, "/root/testdata/sf0.001", "ips")
    plan = _optimized(parse_logs(lines, "ips"))
    # Once for the lines, once for the titles: not again for each member or for the filter on titles.
    assert plan.count("from_json(") == 2
    # Only the first line of a report is looked at.
    assert "<= 50" not in plan


def test_folders_are_listed_in_few_tasks(spark, tmp_path):
    from timberline.sources import read_log_lines

    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    spark.conf.unset(key)
    for i in range(40):
        (tmp_path / f"file={i}").mkdir()
        (tmp_path / f"file={i}" / "a.txt").write_text("one\ntwo\n")
    assert read_log_lines(spark, f"{tmp_path}/file=*").count() == 80
    assert int(spark.conf.get(key)) == 4 * spark.sparkContext.defaultParallelism
    # A number that somebody sets stays.
    spark.conf.set(key, "7")
    read_log_lines(spark, f"{tmp_path}/file=*")
    assert spark.conf.get(key) == "7"
    spark.conf.unset(key)


def test_live_log_sorts_a_batch_once_and_parses_one_format(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from timberline.streaming import live

    sorts, kinds = [], []
    sort, parse = live.number_sorted, live.parse_logs
    monkeypatch.setattr(live, "number_sorted", lambda *a, **k: (sorts.append(a[4]), sort(*a, **k))[1])
    monkeypatch.setattr(live, "parse_logs", lambda *a, **k: (kinds.append(a[1]), parse(*a, **k))[1])
    log = live.LiveLog(f"{tmp_path}/log", lambda: [F.col("raw_line")], format="plain")
    for batch in range(2):
        rows = [("a", f"2024-01-01 00:00:0{i} INFO [c] {batch}") for i in range(3)] + [("b", "x")]
        log(spark.createDataFrame(rows, "source_id string, raw_line string"), batch)
    assert sorts == ["batch", "batch"] and kinds == ["plain", "plain"]
    rows = sorted((r.entry_id, r.line_number, r.source_id) for r in log.rows(spark).collect())
    assert [r[:2] for r in rows] == [(i, i + 1) for i in range(8)]
    # A source keeps the format it had, whatever is named later.
    other = live.LiveLog(f"{tmp_path}/log", lambda: [F.col("raw_line")], format="json")
    other(spark.createDataFrame([("a", "2024-01-01 00:00:09 ERROR [c] late")], "source_id string, raw_line string"), 2)
    assert kinds[-1] == "column" and log.rows(spark).where("line_number = 9").first().level == 4
