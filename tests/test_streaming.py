import numpy as np
import pandas as pd
import pytest
from conftest import by_seq, stream_rows
from pyspark.sql import functions as F

from telltale.operators.learning import fit_gbt
from telltale.plans import live
from telltale.session import scratch_path
from telltale.sources import fixtures as fx
from telltale.sources.logs import stream_process_snapshots
from telltale.sources.sinks import save_model
from telltale.streaming.alerts import LiveDetector, alert_once, alert_rows, alert_totals, first_alerts, rule_scorer, threshold_alerts
from telltale.streaming import history
from telltale.streaming.features import live_features
from telltale.streaming.history import HistoryProcessor, batch_history, live_history

INPUTS = ["cpu", "mem", "num_fds", "num_connections"]
WEIGHTS = {"cpu": 0.4, "mem": 0.3, "num_fds": 0.2, "num_connections": 0.1}


def test_live_rules_differ_from_batch(spark):
    rows = [{"cpu": float(c), "io_write_bytes": b} for c, b in zip((1, 2, 3, 4, 10), (0, 100, 5, 6, 7))]
    got = live_features(batch_history(stream_rows(spark, rows))).orderBy("seq").collect()
    assert got[2].io_write_rate == 0.0  # counter reset is clamped
    assert got[3].cpu_mean_5 == 0.0 and got[4].cpu_mean_5 == 4.0  # needs five samples
    assert got[4].cpu_std_5 == pytest.approx(np.std([1, 2, 3, 4, 10]))  # population deviation
    assert got[4].cpu_spike == 2.5 and got[4].cpu_trend == 9.0 and got[4].cpu_mean_10 == 0.0
    assert got[4].proc_age == 4.0 and got[4].cpu_norm_parent == 0.0


def test_baseline_slides_once_full(spark):
    got = live_features(batch_history(stream_rows(spark, [{"cpu": float(i)} for i in range(30)]))).orderBy("seq").collect()
    assert got[10].cpu_baseline == 2.0 and got[29].cpu_baseline == np.mean([10, 11, 12, 13, 14])
    assert got[29].cpu_burst == 1 and got[8].cpu_burst == 0


def test_bursts_match_percentile(spark):
    rng = np.random.default_rng(2)
    cpu, io = np.round(rng.gamma(1, 20, 80), 1), np.cumsum(rng.integers(0, 50, 80))
    rows = [{"cpu": float(c), "io_write_bytes": int(b) if i % 20 else int(b) // 50} for i, (c, b) in enumerate(zip(cpu, io))]
    got = live_features(batch_history(stream_rows(spark, rows))).orderBy("seq").collect()
    for i, r in enumerate(got):
        held = slice(max(0, i - 19), i + 1)
        full = i >= 9
        assert r.cpu_burst == int(full and cpu[i] > np.percentile(cpu[held], 95))
        past = [x["io_write_bytes"] for x in rows[held]]
        assert r.io_write_burst == int(full and r.io_write_rate > np.percentile(past, 95))


def test_batch_twin_in_blocks(spark, sf):
    p = fx.process_view(spark, sf)
    plain = live_features(batch_history(p)).select("seq", "cpu_mean_10", "cpu_baseline", "io_write_burst", "proc_age", "held")
    split = live_features(batch_history(p, limit=6)).select(*plain.columns)
    assert plain.exceptAll(split).count() == 0 and split.count() == plain.count()


def test_stream_equals_batch_twin_and_alerts_once(spark, sf):
    p = fx.process_view(spark, sf)
    score = rule_scorer(20000.0)
    detector = LiveDetector(score, scratch_path(spark, "live"), INPUTS, WEIGHTS, threshold=0.3)
    # many files and several micro-batches a slice: none may be lost or taken out of order
    live.replay(spark, p, live.time_slices(p, 2), detector, files=150, batch_bytes=400_000)
    twin = live.batch_twin(p, score)
    got = detector.feature_table(spark).drop("batch").toPandas().set_index("seq").sort_index()
    want = twin.toPandas().set_index("seq").sort_index()
    assert len(got) == len(want) and set(got.columns) == set(want.columns)
    for c in want.columns:
        if want[c].dtype.kind in "fiu":
            assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True), c
    expected = alert_rows(first_alerts(threshold_alerts(twin, 0.3)), INPUTS, WEIGHTS)
    alerts = detector.alert_table(spark)
    assert sorted(by_seq(alerts, "anomaly_score").items()) == sorted(by_seq(expected, "anomaly_score").items())
    assert alert_totals(alerts).first().alerted_processes == alerts.count() > 0
    assert detector.late_table(spark).count() == 0 and got.index.is_unique
    assert detector.feature_table(spark).select("batch").distinct().count() > 2


def run(stream, out, checkpoint):
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()


def test_alert_once_in_state(spark):
    landing = scratch_path(spark, "alerts")
    rows = stream_rows(spark, [{"pid": 1, "t": 5}, {"pid": 1, "t": 1}, {"pid": 2, "t": 2}, {"pid": 1, "t": 90000}, {"pid": 1, "t": 90001}])
    for i, part in enumerate((rows.where("seq < 3"), rows.where("seq >= 3"))):
        live.land(part, landing)
        source = stream_process_snapshots(spark, landing, "parquet", schema=rows.schema)
        for horizon, name in ((None, "ever"), (3600, "hour")):
            run(alert_once(source, horizon_seconds=horizon).select("pid", "seq"), f"{landing}-{name}", f"{landing}-{name}-cp")
    assert {(r.pid, r.seq) for r in spark.read.parquet(f"{landing}-ever").collect()} == {(1, 1), (2, 2)}
    assert {(r.pid, r.seq) for r in spark.read.parquet(f"{landing}-hour").collect()} == {(1, 1), (2, 2), (1, 3)}


def test_late_rows_are_marked_not_dropped(spark):
    landing, out, cp = (scratch_path(spark, n) for n in ("late", "late-out", "late-cp"))
    parts = [[{"seq": 0, "t": 0}, {"seq": 1, "t": 1}], [{"seq": 2, "t": 10_000, "pid": 9}], [{"seq": 3, "t": 20_000}],
             [{"seq": 4, "t": 5}, {"seq": 5, "t": 19_995}, {"seq": 6, "t": 5, "pid": 8}]]
    for part in parts:
        df = stream_rows(spark, part)
        live.land(df, landing)
        source = stream_process_snapshots(spark, landing, "parquet", schema=df.schema)
        run(live_history(source, late_seconds=10, idle_seconds=15_000).select("seq", "held", "late"), out, cp)
    assert by_seq(spark.read.parquet(out), "held", "late") == {
        0: (1, False), 1: (2, False), 2: (1, False), 3: (1, False), 4: (0, True), 5: (2, False), 6: (1, False)}


def test_live_detection_by_a_stored_model(spark):
    rng = np.random.default_rng(6)
    rows = [{"pid": int(p), "seq": i, "t": i, "cpu": float(rng.gamma(1, 20)), "mem": float(rng.gamma(1, 10)), "num_fds": int(rng.integers(0, 90)),
             "child_entropy": 0.5} for i, p in enumerate(rng.integers(1, 15, 300))]
    p = stream_rows(spark, rows)
    train = live_features(batch_history(p)).withColumn("label", (F.col("cpu") + F.col("cpu_mean_5") > 45).cast("int"))
    names = ["cpu", "mem", "cpu_mean_5", "num_fds", "not_live"]  # one that live rows never have
    path = save_model(fit_gbt(train.withColumn("not_live", F.lit(0.0)), names, maxIter=4, maxDepth=3), scratch_path(spark, "stored"))
    detector = live.stored_model_detector(path, scratch_path(spark, "by-model"), threshold=0.5, state_partitions=2)
    live.replay(spark, p, live.time_slices(p, 2), detector, files=2)
    columns = ("session_id", "pid", "seq", "anomaly_score", "confidence_band", "suspicious_metrics", "attack")
    got, want = (sorted(map(str, df.select(*columns).collect())) for df in (detector.alert_table(spark), live.batch_alerts(p, detector)))
    assert got == want and 5 < len(got) <= 14 and any("cpu=" in r for r in got)


def test_replay_of_two_months_keeps_time_order(spark):
    rows = [{"t": 86_400 * d, "cpu": float(d), "child_entropy": 1.5} for d in range(0, 60, 2)]
    p = stream_rows(spark, rows)
    detector = LiveDetector(rule_scorer(20000.0), scratch_path(spark, "months"), INPUTS, WEIGHTS, keep_history=True)
    live.replay(spark, p, live.time_slices(p, 2), detector, files=3)
    got = detector.feature_table(spark).orderBy("seq").collect()
    assert [r.held for r in got] == [min(i + 1, 20) for i in range(30)]
    assert got[-1].cpu_hist == [float(2 * d) for d in range(10, 30)] and got[-1].child_entropy == 1.5


class Kept(dict):
    """Stands in for both kinds of state."""
    getValue, updateValue, removeKey = dict.get, dict.__setitem__, dict.__delitem__

    def exists(self):
        return "one" in self

    def get(self, key="one", default=None):
        return dict.get(self, key, default)

    def update(self, value):
        self["one"] = value


def _processor(deep, **settings):
    p = HistoryProcessor(int(60e6), deep=deep, **settings)
    p.buffer, p.waiting, p.seen = Kept(), Kept(), []
    p._framed = lambda key, part, first, held, before, hists, late: (p.seen.append(len(part)), HistoryProcessor._framed(
        key, part, first, held, before, hists, late))[1]
    return p


@pytest.mark.parametrize("idle", [None, 40.0])
def test_a_hot_process_is_taken_in_pieces(idle, monkeypatch):
    rng, ordered = np.random.default_rng(4), []
    monkeypatch.setattr(history, "_ordered", lambda frames, of=history._ordered: (ordered.append(sum(map(len, frames))), of(frames))[1])
    n = 5000
    t = np.r_[rng.integers(0, 10**6, n // 2), rng.integers(5 * 10**8, 5 * 10**8 + 10**5, n // 4), np.full(90, 77), rng.integers(0, 10**9, n // 4 - 90)]
    rows = pd.DataFrame({c: rng.random(n) for c in history.PREVIOUS}).assign(
        seq=rng.permutation(n), timestamp=pd.to_datetime(t * 1000, unit="us"), ppid=1, exe="a", status=None, child_entropy=0.0)
    def run(p):
        out = [pd.concat(p.handleInputRows(("s", 1), iter([rows[i:min(i + 130, to)] for i in range(at, to, 130)]), None))
               for at, to in ((0, 3000), (3000, n))]
        return pd.concat(out).sort_values("seq", ignore_index=True), p
    (want, plain), (got, cut) = run(_processor(10**6, idle_seconds=idle)), run(_processor(100, idle_seconds=idle))
    assert len(got) == n and got["late"].any() and not got["late"].all()
    for c in got.columns:
        assert all(np.array_equal(a, b, equal_nan=True) for a, b in zip(got[c], want[c])) if c.endswith("_hist") else got[c].equals(want[c]), c
    assert ordered[:2] == [3000, 2000] and max(ordered[2:]) <= 100
    assert plain.buffer == cut.buffer and not cut.waiting


def test_stream_of_a_hot_process_equals_its_batch_twin(spark):
    rng = np.random.default_rng(5)
    rows = stream_rows(spark, [{"pid": int(i % 50 == 0), "t": float(t), "cpu": float(t % 7)} for i, t in enumerate(rng.permutation(1500))])
    landing, out, cp = (scratch_path(spark, n) for n in ("hot", "hot-out", "hot-cp"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        for part in live.time_slices(rows, 2):
            live.land(part, landing, 3)
            run(live_history(stream_process_snapshots(spark, landing, "parquet", schema=rows.schema), late_seconds=1e6, deep=100), out, cp)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    columns = ("held", "first_us", "prev_cpu", "cpu_hist")
    assert by_seq(spark.read.parquet(out).fillna(-1, "prev_cpu"), *columns) == by_seq(batch_history(rows).fillna(-1, "prev_cpu"), *columns)


def test_one_call_lays_out_many_processes():
    rng, n = np.random.default_rng(9), 900
    rows = pd.DataFrame({c: rng.random(n) for c in history.PREVIOUS}).assign(
        seq=rng.permutation(n), timestamp=pd.to_datetime(rng.integers(0, 10**8, n) * 1000, unit="us"), ppid=1, exe="a", status=None,
        child_entropy=0.0, session_id="s", pid=rng.integers(0, 60, n)).assign(**{history.PROCESS: lambda d: d["pid"].astype(str)})
    def together(deep):
        p, frames = history.HistoriesProcessor(int(30e6), 5.0, deep), []
        p.buffers, p.waiting = Kept(), Kept()
        for at in (0, 500):
            some = rows[at:at + 500]
            frames += p.handleInputRows((7,), iter([some[i:i + 130] for i in range(0, len(some), 130)]), None)
        assert len(p.buffers) == 60 and not p.waiting  # state is still one entry a process
        return frames
    def one_by_one():
        for pid, of in rows.groupby("pid"):
            p = HistoryProcessor(int(30e6), 5.0)
            p.buffer, p.waiting = Kept(), Kept()
            for some in (of[of.index < 500], of[of.index >= 500]):
                if len(some):
                    yield from p.handleInputRows(("s", pid), iter([some]), None)
    order = lambda frames: pd.concat(frames).sort_values("seq", ignore_index=True)
    want, whole, cut = order(one_by_one()), together(history.DEEP), together(100)
    assert len(whole) <= 4  # calls and frames go with rows, not with processes
    for got in (order(whole), order(cut)):
        assert got["late"].any() and len(got) == n
        for c in want.columns:
            assert all(np.array_equal(a, b, equal_nan=True) for a, b in zip(got[c], want[c])) if c.endswith("_hist") else got[c].equals(want[c]), c


def test_rows_without_process_id_are_a_process(spark):
    rows = stream_rows(spark, [{"pid": None if i % 2 else 5, "t": i, "cpu": float(i)} for i in range(12)])
    landing, out, cp = (scratch_path(spark, n) for n in ("null", "null-out", "null-cp"))
    live.land(rows, landing)
    run(live_history(stream_process_snapshots(spark, landing, "parquet", schema=rows.schema)).select("seq", "pid", "held"), out, cp)
    assert by_seq(spark.read.parquet(out), "pid", "held") == {i: (None if i % 2 else 5, i // 2 + 1) for i in range(12)}
