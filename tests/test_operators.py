"""Operators against small cases and brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from timberline import functions as fn
from timberline import operators as op
from timberline.functions.codes import parse_code
from timberline.operators.error_tables import Code

T0 = datetime(2026, 4, 1)


def log(spark, rows, schema="entry_id long, timestamp timestamp, level int, message string, component string, source_id string"):
    return spark.createDataFrame(rows, schema).withColumn("line_number", F.col("entry_id") + 1)


@pytest.fixture(scope="module")
def small(spark):
    return log(spark, [
        (0, T0, 1, "boot ok", "a", "s1"), (1, T0, 3, "cache warming", None, "s1"), (2, T0, 4, "Disk failure", "a", "s2"),
        (3, T0, 1, "Disk ok, CACHE ok", "b", "s2"), (4, None, 0, "cache trace", "b", "s3"), (5, T0, -1, "odd", None, None),
    ])


def ids(df):
    return sorted(r.entry_id for r in df.collect())


def test_filters(small):
    def run(**kw):
        return ids(op.apply_filter(small, op.LogFilter(**kw)))

    assert run(min_level="warning") == [1, 2]
    assert run(min_level="debug") == [0, 1, 2, 3, 4]
    assert run(text="FAILURE") == [2] and run(text="FAILURE", case_sensitive=True) == []
    assert run(text="(?i)(disk|cache)", regex=True, case_sensitive=True) == [1, 2, 3, 4]
    assert run(text="(unclosed", regex=True) == []
    assert run(component="a") == [0, 2]
    assert run(hidden_sources={"s1", "s2"}) == [4, 5]
    assert run() == [0, 1, 2, 3, 4, 5] and not op.LogFilter().is_active
    flt = op.LogFilter(levels={"error"}, text="x")
    preset = op.FilterPreset.from_json(op.FilterPreset.save("p", flt).to_json())
    assert preset.matches(flt) and preset.apply(op.LogFilter(min_level=2)).levels == {4}
    assert op.toggle_level(op.toggle_level(op.LogFilter(), 4), 4).levels == op.LogFilter().levels


def test_empty_results(spark, small):
    none = small.where("level > 9")
    assert op.histogram(none).count() == 0 and op.histogram(small).count() == 0
    assert [r.rows for r in op.level_counts(none).collect()] == [0] * 7
    assert op.nearest_rows(none, [0], keys=[]).first().row is None
    assert op.preset_counts(small, [op.FilterPreset("x", text="(", regex=True)]).first()["rows"] == 0


def test_histogram_totals(spark):
    rows = [(i, T0 + timedelta(seconds=i), [1, 3, 4, 5, -1][i % 5], "m", None, "s") for i in range(100)]
    bars = op.histogram(log(spark, rows), 10).collect()
    assert len(bars) == 10 and sum(b.total for b in bars) == 100
    assert all(b.total == b.err + b.warn + b.info for b in bars)
    one = op.histogram(log(spark, [(i, T0, 1, "m", None, "s") for i in range(20)]))
    assert one.count() == 0


def test_spikes_and_shadows(spark):
    rows = [(i, T0 + timedelta(seconds=i % 600), 1, "m", None, "s") for i in range(1200)]
    rows += [(2000 + i, T0 + timedelta(seconds=300), 1, "m", None, "s") for i in range(500)]
    bars = op.histogram(log(spark, rows))
    peaks = op.spikes(bars).collect()
    assert len(peaks) == 1 and peaks[0].peak_count > 500
    at = datetime(1970, 1, 1) + timedelta(microseconds=peaks[0].peak_us)
    assert abs((at - T0).total_seconds() - 300) < 10
    calm = op.histogram(log(spark, rows[:1200]))
    assert op.peak_shadows(calm, op.spikes(bars)).count() == 1
    assert op.peak_shadows(bars, op.spikes(bars)).count() == 0


def test_out_of_order(spark):
    seconds = [0, 2, 3, 4, 1, 5, 6, 7, 8, 9, 10, 11]
    df = log(spark, [(i, T0 + timedelta(seconds=s), 1, "m", None, "s") for i, s in enumerate(seconds)])
    us = int((T0 - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    found = op.first_in_ranges(df, [(us + 1_000_000, us + 2_000_000), (us + 10**9, us + 10**10)]).collect()
    assert [r.first_row for r in found] == [4, None]
    bad = op.time_inversions(df).first()
    assert (bad.out_of_order, bad.inversions, bad.worst_us) == (True, 1, 3_000_000)


def test_nearest(spark):
    us = int((T0 - datetime(1970, 1, 1)).total_seconds()) * 1_000_000

    def nearest(offsets, target):
        rows = [(i, None if o is None else T0 + timedelta(seconds=o), 1, "m", None, "s") for i, o in enumerate(offsets)]
        return op.nearest_rows(log(spark, rows), [us + int(target * 1e6)]).first().row

    assert nearest([-3, -2, -1], 0) == 2
    assert nearest([1, 2, 3], 0) == 0
    assert nearest([0, 1, 2, 3, 4], 2.5) == 2
    assert nearest([0, 1, 1, 1, 2], 1) == 3
    assert nearest([None, None], 0) is None


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_running_matches_brute_force(spark, width):
    random.seed(width)
    rows = [(k, i, random.choice([None, i])) for k in (None, "x", "y") for i in random.sample(range(-50, 200_000), 120)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    runs = {
        "n": op.Run("sum", F.lit(1).cast("long")), "before": op.Run("last", F.col("v"), inclusive=False),
        "after": op.Run("first", F.col("v"), inclusive=False), "here": op.Run("last", F.col("v")),
    }
    for r in op.running(df, "o", runs, keys=["k"], width=width).collect():
        mine = sorted((o, v) for k, o, v in rows if k == r.k)
        upto = [v for o, v in mine if o <= r.o]
        past = [v for o, v in mine if o < r.o and v is not None]
        later = [v for o, v in mine if o > r.o and v is not None]
        seen = [v for v in upto if v is not None]
        assert (r.n, r.before, r.after, r.here) == (
            len(upto), past[-1] if past else None, later[0] if later else None, seen[-1] if seen else None
        )


def test_asof_with_hot_times(spark):
    random.seed(3)
    def rows(n):
        out = []
        for i in range(n):
            s = 500 if i % 3 == 0 else random.randrange(1000)
            out.append((i, None if i % 50 == 49 else T0 + timedelta(seconds=s, microseconds=random.randrange(3)), 1, f"m{i}", None, "s"))
        return out
    left, right = rows(200), [r for r in rows(150) if r[1] is None or r[1] > T0 + timedelta(seconds=100)]
    got = {r.entry_id: r.near_entry_id for r in op.asof_join(log(spark, left), log(spark, right), ["entry_id"]).collect()}
    timed = sorted((r[1], r[0]) for r in right if r[1] is not None)
    first = min(i for _, i in timed)
    for i, ts, *_ in left:
        want = None if ts is None else next((j for t, j in reversed(timed) if t <= ts), first)
        assert got[i] == want


def test_merge(spark):
    a = log(spark, [(i, T0, 1, f"a{i}", None, "x") for i in range(30)])
    b = log(spark, [(i, T0 if i % 2 else None, 1, f"b{i}", None, "x") for i in range(30)])
    merged = op.merge_logs({"a": a, "b": b})
    rows = merged.orderBy("line_number").collect()
    assert [r.line_number for r in rows] == list(range(1, 46))
    assert [r.message for r in rows] == [f"a{i}" for i in range(30)] + [f"b{i}" for i in range(1, 30, 2)]
    assert [r.source_id for r in op.source_list(merged).collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        op.merge_logs({"a": a})
    with pytest.raises(ValueError):
        op.merge_logs({"m": merged, "a": a})
    assert op.merge_label(list("abc")) == "a + b + c" and op.merge_label(list("abcd")) == "a + b + 2 more"


def test_partitions_do_not_matter(spark):
    df = log(spark, [(i, T0 + timedelta(seconds=i * 7 % 40), i % 6, f"m{i}", f"c{i % 5}", "s") for i in range(300)])
    seen = []
    for n in (1, 7, 50):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        spread = df.repartition(n)
        merged = op.merge_logs({"a": spread, "b": spread}).orderBy("line_number")
        seen.append((merged.collect(), sorted(op.neighbouring_errors(spread).collect()), sorted(op.histogram(spread).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1] == seen[2]


def test_pause(spark):
    def replay(marks, capacity, stopped=None):
        rows = [(i, m) for i, m in enumerate(marks)]
        df = spark.createDataFrame(rows, "o long, m string")
        df = op.pause_state(df, "o", F.col("m") == "P", F.col("m") == "R").where("m NOT IN ('P', 'R')")
        return [r.m for r in op.pause_buffer(df, "o", capacity, stopped).orderBy("live_number").collect()], op.pause_drops(df, capacity).collect()

    assert replay("P123R", 3)[0] == list("123")
    got, drops = replay("P12345R", 3)
    assert got == list("345") and drops[0].dropped == 2
    got, drops = replay("aPPbcdeRf", 2)
    assert got == list("adef") and (drops[0].buffered, drops[0].dropped) == (2, 2)
    assert replay("aPbR", 0)[0] == ["a", "b"]
    assert replay("aPb", 5, stopped=F.lit(True))[0] == ["a"]


def test_rates(spark):
    arrivals = [0, 0, 0, 1, 8, 8, 400]
    df = spark.createDataFrame([(T0 + timedelta(seconds=s),) for s in arrivals], "timestamp timestamp")
    rows = op.line_rates(df).orderBy("second").collect()
    rate, per = 0.0, {s: arrivals.count(s) for s in set(arrivals)}
    want = {}
    for s in range(401):
        rate = 0.6 * rate + 0.4 * per.get(s, 0)
        if s in per:
            want[s] = rate
    assert [r.rate for r in rows] == pytest.approx([want[s] for s in sorted(want)])
    assert [(r.idle_before, r.stalled_before) for r in rows] == [(0, False), (0, False), (6, True), (391, True)]


def test_error_codes(spark):
    asked = spark.createDataFrame([("13",), (" eacces ",), ("0xE00002BC",), ("404",), ("",), ("-1001",)], "t string")
    got = {}
    for r in op.error_lookup(asked, "t").orderBy("match_rank").collect():
        got.setdefault(r.t, []).append((r.domain, r.symbol, r.hex))
    assert ("errno", "EACCES", "0xD") in got["13"] and got[" eacces "] == [("errno", "EACCES", "0xD")]
    assert got["0xE00002BC"] == [("IOReturn", "kIOReturnError", "0xE00002BC")]
    assert got["404"][0] == ("HTTP", "Not Found", None) and got["-1001"][0][0] == "CFNetwork" and "" not in got
    own = [Code("Shop", 7, "E_SEVEN", "seven")]
    said = spark.createDataFrame([(0, "errno=7"), (1, "error 7")], "i int, message string")
    rows = op.decode_codes(said, codes=own).orderBy("i").collect()
    assert rows[0].code_token is None and rows[1].matches[0].symbol == "E_SEVEN"


def test_marks(spark, small):
    marks = small.where("entry_id IN (0, 1, 2)")
    again = op.toggle_bookmarks(marks, small.where("entry_id IN (1, 3)"))
    assert ids(op.bookmarked(small, again)) == [0, 2, 3]
    rows = op.bookmarks_by_source(again).orderBy("source_id", "position").collect()
    assert [(r.source_id, r.line_number, r.position, r.total) for r in rows] == [("s1", 1, 1, 1), ("s2", 3, 1, 2), ("s2", 4, 2, 2)]
    assert op.highlight(small, []).where("highlight_rule IS NOT NULL").count() == 0


def test_display(spark):
    def show(column):
        return spark.range(1).select(column).first()[0]

    assert [show(fn.compact_count(F.lit(n))) for n in (999, 1000, 1150, 1250, 1350, 9999, 34567)] == [
        f"{n}" if n < 1000 else (f"{n // 1000}k" if n >= 10_000 else f"{n / 1000:.1f}k".replace(".0k", "k"))
        for n in (999, 1000, 1150, 1250, 1350, 9999, 34567)
    ]
    assert [show(fn.format_bytes(F.lit(n))) for n in (512, 1280, 1536, 120 * 2**20)] == ["512 B", "1.2 KB", "1.5 KB", "120 MB"]
    assert show(fn.split_csv_row(F.lit('a,"b,c",""'))) == ["a", "b,c", ""] and show(fn.basename(F.lit("/a/b/"))) == "b"


def test_long_hexadecimal_tokens(spark):
    texts = ["0x" + "f" * n for n in (4, 15, 16, 17, 32, 64)] + ["0x" + "0" * 30 + "e00002bc", "0x0", "12", "0xg", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = [r[0] for r in df.orderBy("i").select(parse_code(F.col("t"))).collect()]
    assert got == [0xFFFF, 16**15 - 1, None, None, None, None, 0xE00002BC - 2**32, 0, 12, None, None]


def test_nothing_is_capped_unless_asked(spark):
    df = spark.range(70_000).select(F.col("id").alias("entry_id"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("component"))
    assert op.component_dictionary(df, keys=[]).agg(F.max("component_id")).head()[0] == 70_000
    assert op.component_dictionary(df, cap=65_535, keys=[]).count() == 65_535
    held = spark.range(12_000).select(F.col("id").alias("o"), F.lit(True).alias("paused"), F.lit(1).alias("pause_id"))
    assert op.pause_buffer(held, "o").count() == 12_000
    assert [tuple(r) for r in op.pause_drops(held).collect()] == [(1, 12_000, 0)]
    assert [tuple(r) for r in op.pause_drops(held, 10_000).collect()] == [(1, 10_000, 2_000)]


@pytest.mark.parametrize("parts", [1, 7, 200])
def test_navigation_stays_in_its_file(spark, parts):
    rows = [(i, T0 + timedelta(seconds=i), 4 if i % 2 else 1, f"{name} {i}", name, name) for name in ("a", "b") for i in range(5)]
    df = log(spark, rows).repartition(parts)
    step = {(r.source_id, r.line_number): (r.next_error, r.previous_error) for r in op.neighbouring_errors(df).collect()}
    assert step == {
        (s, n): v for s in ("a", "b") for n, v in {1: (2, None), 2: (4, None), 3: (4, 2), 4: (None, 2), 5: (None, 4)}.items()
    }
    shown = op.visible_position(df, F.col("level") == 1)
    assert sorted((r.source_id, r.line_number, r.position) for r in shown.where("position is not null").collect()) == [
        (s, n, (n - 1) // 2) for s in ("a", "b") for n in (1, 3, 5)
    ]
    found = op.match_list(df, F.col("level") == 4).collect()
    assert sorted((r.source_id, r.line_number, r.match_index, r.match_count, r.next_match, r.previous_match) for r in found) == [
        (s, *v) for s in ("a", "b") for v in ((2, 0, 2, 4, 4), (4, 1, 2, 2, 2))
    ]
    first = op.bucket_representatives(df, buckets=2).orderBy("bucket").collect()
    assert [(r.source_id, r.target, r.rolled) for r in first] == [("a", 1, False), ("a", 3, False)]


def test_rates_by_the_recurrence(spark):
    """Over blocks, long silences and sources with their own clocks; null keys and times."""
    import random

    rnd = random.Random(4)
    seconds = {"a": [], None: [], "b": [10**6]}
    for key in ("a", None):
        s = rnd.randrange(-3000, 3000)
        for _ in range(400):
            seconds[key] += [s] * rnd.choice([1, 1, 3])
            s += rnd.choice([1, 1, 1, 2, 6, 40, 511, 512, 513, 700])
    rows = [(k, s * 1_000_000 + rnd.randrange(10**6)) for k, ss in seconds.items() for s in ss] + [("a", None)]
    df = spark.createDataFrame(rows, "source_id string, us long").withColumn("timestamp", F.timestamp_micros("us")).repartition(3)
    got = {(r.source_id, r.second): r for r in op.rate_seconds(df, keys=["source_id"], until=F.timestamp_micros(F.lit(10**12 + 10**7))).where("source_id = 'b' or second < 100000").collect()}
    sparse = {(r.source_id, r.second): r for r in op.line_rates(df, keys=["source_id"]).collect()}
    for key, ss in seconds.items():
        count, rate, idle, last = {}, 0.0, 0, None
        for s in ss:
            count[s] = count.get(s, 0) + 1
        for s in range(min(ss), min(max(ss), 99_999) + 1 if key != "b" else 10**6 + 11):
            n = count.get(s, 0)
            rate = 0.6 * rate + 0.4 * n
            idle = 0 if n else idle + 1
            r = got.pop((key, s))
            assert (r.lines, r.idle_seconds, r.stalled) == (n, idle, idle >= 5)
            assert abs(r.rate - rate) <= 1e-12 * rate + 1e-300
            if n:
                r = sparse.pop((key, s))
                assert r.lines == n and abs(r.rate - rate) <= 1e-12 * rate and r.idle_before == (0 if last is None else s - last - 1)
                last = s
    assert all(s >= max(seconds[k]) for k, s in got)
    assert op.line_rates(df.limit(0)).count() == 0 and op.rate_seconds(df.limit(0)).count() == 0


def test_codes_from_a_table(spark):
    """The same matches from a DataFrame of codes as from a list, sent to all tasks or joined."""
    from timberline.operators import errorcodes

    asked = spark.createDataFrame([(t,) for t in ("13", " eacces ", "0xE00002BC", "404", "", "-1001", "nowhere", None)], "t string")
    said = spark.createDataFrame(
        [(i, m) for i, m in enumerate(["failed errno=13 then -9999999", "error -1001 and errno=2", "nothing", None, "OSStatus -50 -1001", "99999 0xE00002BC"])], "i int, message string"
    )
    within = spark.createDataFrame([("13", "errno"), ("ENOENT", "errno"), ("404", "HTTP"), ("404", "errno"), (None, "errno")], "t string, d string")
    own = op.code_table(spark)

    def all_three(codes):
        return (
            sorted(map(str, op.error_lookup(asked, "t", codes).select("t", "domain", "code", "symbol", "hex").collect())),
            sorted((r.i, r.code_token, sorted(m.symbol for m in r.matches or [])) for r in op.decode_codes(said, codes=codes).collect()),
            sorted(map(str, op.error_lookup_in(within, "t", "d", codes).collect())),
        )

    want = all_three(None)
    assert all_three(own) == want
    limit, errorcodes.SENT_KEYS = errorcodes.SENT_KEYS, 0
    try:
        assert all_three(own) == want
    finally:
        errorcodes.SENT_KEYS = limit
    assert all_three(own.limit(0))[0] == []


def test_a_million_codes(spark):
    codes = spark.range(1_000_000).select(
        F.lit("Own").alias("domain"), F.col("id").cast("int").alias("code"), F.concat(F.lit("OWN_"), "id").alias("symbol"), F.lit("x").alias("description")
    )
    said = spark.range(20_000).select("id", F.concat(F.lit("disk failed: OWN_x error "), (F.col("id") * 50).cast("string")).alias("message"))
    rows = op.decode_codes(said, codes=codes)
    assert rows.where("matches[0].code = id * 50 and size(matches) = 1").count() == 20_000
