import pytest
from conftest import at, by_seq, stream_rows
from pyspark.sql import functions as F

from telltale.operators import labeling as lb
from telltale.schemas import EVENT_LOG
from telltale.sources import logs


def log(spark, *events):
    rows = [(i, at(t), kind, "") for i, (t, kind) in enumerate(events)]
    return spark.createDataFrame(rows, EVENT_LOG).withColumn("session_id", F.lit("s"))


def ticks(spark, *seconds):
    return stream_rows(spark, [{"t": t} for t in seconds])


def spans(df):
    return sorted(((r.start_ts.timestamp(), r.end_ts.timestamp()) for r in df.collect()))


def relative(df):
    zero = at(0).timestamp()
    return [(a - zero, b - zero) for a, b in spans(df.select(F.col("start_ts"), F.col("end_ts")))]


NESTED = [(0, "anomaly_start"), (10, "anomaly_start"), (20, "anomaly_end"), (30, "anomaly_end")]


def test_nested_starts(spark):
    ev, st = log(spark, *NESTED), ticks(spark, 0, 50)
    assert relative(lb.pair_periods(ev, st)) == [(0, 10), (10, 20)]
    assert [(r.seq, r.issue) for r in lb.orphan_events(ev).orderBy("seq").collect()] == [(0, "unclosed_start"), (3, "end_without_start")]


def test_outer_nesting(spark):
    ev = log(spark, (-5, "anomaly_end"), *NESTED, (40, "Anomaly_Start"))
    assert relative(lb.pair_periods(ev, ticks(spark, 0, 50), nesting="outer")) == [(0, 30), (40, 50)]


def test_unclosed_start_runs_to_stream_end(spark):
    assert relative(lb.pair_periods(log(spark, (0, "anomaly_start")), ticks(spark, 0, 50))) == [(0, 50)]


def test_no_anomaly_events(spark):
    st = ticks(spark, 0, 1, 2)
    out = lb.label_windows(st, lb.pair_periods(log(spark, (0, "normal_start"), (1, "normal_end")), st))
    assert set(by_seq(out, "label").values()) == {0}


def test_buffer_edges_and_all_processes(spark):
    st = stream_rows(spark, [{"t": 7.9}, {"t": 8}, {"t": 15, "pid": 2}, {"t": 22}, {"t": 22.1}])
    out = lb.label_windows(st, lb.pair_periods(log(spark, (10, "anomaly_start"), (20, "anomaly_end")), st), 2)
    assert by_seq(out, "label") == {0: 0, 1: 1, 2: 1, 3: 1, 4: 0}


def brute(st, periods, buffer):
    edges = [(r.session_id, r.start_ts.timestamp() - buffer, r.end_ts.timestamp() + buffer) for r in periods.collect()]
    return {r.seq: int(any(r.session_id == s and a <= r.timestamp.timestamp() <= b for s, a, b in edges)) for r in st.collect()}


def many(spark):
    st = stream_rows(spark, [{"t": i * 3.7 % 400, "session_id": f"s{i % 2}"} for i in range(200)])
    kinds = ["anomaly_start", "anomaly_end", "anomaly_start", "x"]
    rows = [(i, at(i * 11.0), kinds[i % 4], "", f"s{i % 2}") for i in range(36)]
    ev = spark.createDataFrame(rows, "seq long, timestamp timestamp, event_type string, details string, session_id string")
    return st, ev


def test_many_periods_match_brute_force(spark):
    st, ev = many(spark)
    periods = lb.pair_periods(ev, st)
    for buffer in (0, 2, 30):
        assert by_seq(lb.label_windows(st, periods, buffer), "label") == brute(st, periods, buffer)


def test_blocks_and_shuffle_joins_give_the_same_labels(spark, small_blocks, no_broadcast):
    st, ev = many(spark)
    periods = lb.pair_periods(ev, st)
    assert by_seq(lb.label_windows(st, periods, 6), "label") == brute(st, periods, 6)


def test_period_counts_overlaps_twice(spark):
    st = ticks(spark, *range(40))
    periods = lb.pair_periods(log(spark, (5, "anomaly_start"), (10, "anomaly_start"), (20, "anomaly_end")), st)
    got = sorted((r.seconds, r.rows_labeled) for r in lb.period_summary(st, periods, 2).collect())
    assert got == [(5.0, 10), (10.0, 15)]
    total = lb.period_totals(st, periods, 2).first()
    assert (total.periods, total.rows_with_overlaps, total.rows_labeled) == (2, 25, 20)


def test_ragged_lines(spark, tmp_path):
    (tmp_path / "log.txt").write_text("x\nbad,anomaly_start\n2024-01-01T00:00:05.000001+00:00,anomaly_start,a,b\n")
    rows = logs.scan_event_log(spark, str(tmp_path / "log.txt"), "s").collect()
    assert len(rows) == 1 and rows[0].event_type == "anomaly_start" and rows[0].details == "a,b"
    assert rows[0].timestamp.microsecond == 1


def test_csv_stream_drops_undated_rows(spark, tmp_path):
    head = ",".join(f.name for f in logs.PROCESS_STREAM.fields)
    line = "s,1,,1.5,2.5,/bin/a,0,0.0,1,2,3,4,5,6,7,8,9,running"
    (tmp_path / "p.csv").write_text(f"{head}\n2024-01-01T00:00:01.500000+00:00,{line}\njunk,{line}\n")
    rows = logs.scan_process_stream(spark, str(tmp_path / "p.csv")).collect()
    assert len(rows) == 1 and rows[0].cpu == 1.5 and rows[0].ppid is None and rows[0].num_fds == 7


def test_event_files_are_read_by_name_whatever_their_size(spark, tmp_path):
    (tmp_path / "part-0").write_text("2024-01-01T00:00:00+00:00,anomaly_start\n")
    (tmp_path / "part-1").write_text("2024-01-01T00:01:00+00:00,anomaly_end,a long detail that makes this file the larger one\n"
                                     "2024-01-01T00:02:00+00:00,normal_start\n")
    from telltale.sources import logs
    got = logs.scan_event_log(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.seq, r.event_type) for r in got] == [(0, "anomaly_start"), (1, "anomaly_end"), (2, "normal_start")]


def test_sessions_round_trip_as_csv(spark, tmp_path):
    from telltale.sources import logs, sinks
    rows = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 1.5), ("b", 3, 2.5), ("b", 4, 3.5)], "session_id string, pid long, cpu double")
    for fmt in ("csv", "parquet"):
        back = logs.scan_sessions(spark, sinks.sink_labeled(rows, str(tmp_path / fmt), fmt), fmt=fmt)
        assert {(r.session_id, int(r.pid), float(r.cpu)) for r in back.collect()} == {tuple(r) for r in rows.collect()}
    with pytest.raises(FileNotFoundError):
        logs.scan_sessions(spark, str(tmp_path / "csv"), ["session_id=absent"])


def test_many_sessions_are_one_scan(spark, tmp_path):
    from telltale.sources import logs
    for i, name in enumerate(["night", "day+1", "a b", "x%20y", "_hidden"]):
        df = spark.createDataFrame([(i, float(i))], "seq long, cpu double")
        (df if i else df.withColumn("mem", F.lit(1.5))).write.parquet(str(tmp_path / "root dir" / name))
    back = logs.scan_sessions(spark, str(tmp_path / "root dir"))
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan and "- Filter" not in plan and ") Filter" not in plan
    assert {(r.seq, r.cpu, r.mem, r.session) for r in back.collect()} == {
        (0, 0.0, 1.5, "night"), (1, 1.0, None, "day+1"), (2, 2.0, None, "a b"), (3, 3.0, None, "x%20y")}
    some = logs.scan_sessions(spark, str(tmp_path / "root dir"), ["night", "gone", "a b"])
    assert {r.session for r in some.collect()} == {"night", "a b"}


def test_csv_sessions_with_other_headers(spark, tmp_path):
    from telltale.sources import logs
    for name, text in (("a", "cpu,seq\n1.5,1\n"), ("b", "cpu,seq\n2.5,2\n"), ("c", "seq,mem\n3,9\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.csv").write_text(text)
    back = logs.scan_sessions(spark, str(tmp_path), fmt="csv")
    assert back._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
    assert {(r.seq, r.cpu, r.mem, r.session) for r in back.collect()} == {("1", "1.5", None, "a"), ("2", "2.5", None, "b"), ("3", None, "9", "c")}


def test_logs_and_streams_of_many_sessions(spark, tmp_path):
    from telltale.sources import logs
    for i, name in enumerate(("s1", "s2")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "events.txt").write_text("".join(f"2024-01-01T00:00:0{k}+00:00,anomaly_start,pid={i}\n" for k in range(3)))
        (tmp_path / name / "snapshots.csv").write_text("timestamp,session_id,pid\n" + "".join(f"2024-01-01T00:00:0{k}+00:00,,{i}\n" for k in range(2)))
    events = logs.scan_event_log(spark, str(tmp_path / "*" / "events.txt"), by_folder=True).collect()
    assert {(r.session_id, r.details) for r in events} == {("s1", "pid=0"), ("s2", "pid=1")} and len({r.seq for r in events}) == 6
    rows = logs.scan_process_stream(spark, str(tmp_path / "*" / "snapshots.csv"), by_folder=True)
    assert {(r.session_id, r.pid) for r in rows.collect()} == {("s1", 0), ("s2", 1)} and rows.count() == 4 and "_metadata" not in rows.columns


def test_labels_take_two_actions_at_most_before_the_query(spark, tmp_path):
    """One for hot sessions of the log, one to write the spans; the stream is not read before the join."""
    rows = stream_rows(spark, [{"t": t, "session_id": s} for s in "ab" for t in range(100)])
    rows.write.parquet(str(tmp_path / "stream"))
    log(spark, *NESTED).withColumn("session_id", F.lit("a")).write.parquet(str(tmp_path / "log"))
    stream, events = spark.read.parquet(str(tmp_path / "stream")), spark.read.parquet(str(tmp_path / "log"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # with it every shuffle counts as a job
    try:
        def jobs():
            return len(spark.sparkContext.statusTracker().getJobIdsForGroup("labels"))
        spark.sparkContext.setJobGroup("labels", "")
        out = lb.label_windows(stream, lb.pair_periods(events, stream))
        assert jobs() <= 4  # the writing action broadcasts and reads a file's footer beside its own job
        assert {(r.session_id, r.label): r["count"] for r in out.groupBy("session_id", "label").count().collect()} == {
            ("a", 1): 23, ("a", 0): 77, ("b", 0): 100}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.sparkContext._jsc.clearJobGroup()


def test_spans_that_overlap_add_no_rows(spark):
    st = ticks(spark, *range(300))
    periods = spark.createDataFrame([("s", at(a), at(b)) for a in range(0, 200, 7) for b in (a + 3, a + 150)] + [("s", None, at(5)), (None, at(0), at(9))],
                                    "session_id string, start_ts timestamp, end_ts timestamp")
    out = lb.label_windows(st, periods, 2, 10)
    assert by_seq(out, "label") == {i: int(i <= 196 + 152) for i in range(300)} and out.count() == 300
