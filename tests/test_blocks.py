"""Equal-depth ranges, routing of hot groups, and carries that keep whole rows."""

import math
import random

import numpy as np
import pytest
from conftest import by_seq, stream_rows
from pyspark.sql import functions as F

from telltale.operators import blocks, features as ft, metrics as mt, ordering as od, quantiles as qt
from telltale.operators.blocks import BLOCK, HALO, Series, equal_depth, process_series
from telltale.plans import prepare


def jumps_by_hand(rows, frame=20):
    """rows: (session, pid, t, seq, delta) -> 1 where delta is above all of the 19 rows before it in the whole order."""
    rows = sorted(rows)
    return [(*r, int(i >= frame - 1 and r[-1] > max(x[-1] for x in rows[i - frame + 1:i]))) for i, r in enumerate(rows)]


def two_sessions(spark, n=60):
    r = random.Random(4)
    rows = [{"session_id": s, "pid": r.choice([1, 1, 1, 2, 3, 4]), "t": i, "seq": i, "cpu": float(r.randrange(50)), "mem": 1.0}
            for s in ("a", "b") for i in range(n)]
    return stream_rows(spark, rows)


@pytest.mark.parametrize("limit", ["1000000", "6"])
def test_jumps_of_two_sessions_with_the_same_seq(spark, limit):
    spark.conf.set("spark.telltale.rowsPerBlock", limit)
    try:
        df = two_sessions(spark)
        got = od.global_jump(ft.deltas(ft.series_for_features(df), ("delta_cpu", "delta_mem"))).collect()
    finally:
        spark.conf.unset("spark.telltale.rowsPerBlock")
    rows = [(x.session_id, x.pid, x.timestamp, x.seq, x.delta_cpu, x.cpu_jump) for x in got]
    assert len(rows) == 120 and sorted(rows) == jumps_by_hand([x[:5] for x in rows]) and any(x[5] for x in rows)


def test_training_features_of_two_sessions_with_the_same_seq(spark):
    df = prepare.engineer(two_sessions(spark, 30)).withColumn("label", F.lit(0))
    out = prepare.training_features(df)
    assert out.count() == 60 and out.select("session_id", "seq").distinct().count() == 60


def depths(df):
    return [x["count"] for x in df.groupBy(BLOCK).count().collect()]


def test_ranges_are_of_equal_depth_whatever_the_values(spark):
    values = np.random.default_rng(7).exponential(1.0, 20_000) ** 3
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    cut = equal_depth(df, ["x"], 100)
    assert max(depths(cut)) <= 100 and cut.count() == 20_000
    ends = sorted((tuple(x[BLOCK]), x.lo, x.hi) for x in cut.groupBy(BLOCK).agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect())
    assert all(a[2] < b[1] for a, b in zip(ends, ends[1:]))  # numbers follow the order
    s = Series(df.withColumn("g", F.lit(1)), ("g",), ("x",), limit=100)
    assert max(depths(s.df.where(~F.col(HALO)))) <= 100
    for q in (0.25, 0.5, 0.95):
        assert qt.exact_quantiles(df, [], "x", {"q": q}, 100).first().q == pytest.approx(np.quantile(values, q))


def test_ties_stay_together_and_deep_ranges_are_split_again(spark):
    rows = [(1.0, i) for i in range(500)] + [(2.0, 0)] * 300 + [(3.0, i) for i in range(50)]
    df = spark.createDataFrame(rows, "x double, y int")
    cut = equal_depth(df, ["x", "y"], 40)
    assert 300 <= sorted(depths(cut))[-1] < 340 and sorted(depths(cut))[-2] <= 40 and cut.count() == len(rows)


def test_clustered_scores_in_blocks(spark):
    spark.conf.set("spark.telltale.rowsPerBlock", "50")
    try:
        rows = [(i, i % 3 == 0, math.exp(-20 * ((i * 37 % 1000) / 1000))) for i in range(1000)]
        df = spark.createDataFrame([(i, int(y), s) for i, y, s in rows], "seq long, label int, score double")
        pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
        want = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
        assert mt.roc_auc(df).first().roc_auc == pytest.approx(want)
    finally:
        spark.conf.unset("spark.telltale.rowsPerBlock")


def test_only_the_hot_process_is_written(spark, monkeypatch):
    rows = [{"pid": 1, "t": i, "cpu": float(i % 9)} for i in range(200)] + [{"pid": p, "t": i, "cpu": 1.0} for p in range(2, 60) for i in range(5)]
    df = stream_rows(spark, rows)
    plain = by_seq(ft.base_features(ft.series_for_features(df)).done(), "cpu_ema", "cpu_burst", "cpu_baseline", "proc_age", "cpu_std_10")
    written = []
    real = blocks.materialized

    def seen(table, name):
        out = real(table, name)
        written.append((name, out))
        return out

    monkeypatch.setattr(blocks, "materialized", seen)
    s = ft.base_features(ft.series_for_features(df, limit=20))
    for name, table in written:
        assert "pid" not in table.columns or {x.pid for x in table.select("pid").distinct().collect()} == {1}, name
    assert sum(t.count() for n, t in written if n == "ranges") < 2 * 200
    assert s.cold.select("pid").distinct().count() == 58
    got = by_seq(s.done(), "cpu_ema", "cpu_burst", "cpu_baseline", "proc_age", "cpu_std_10")
    assert got.keys() == plain.keys() and all(got[k] == pytest.approx(plain[k], abs=1e-9) for k in plain)


def test_null_keys_are_a_group(spark):
    df = stream_rows(spark, [{"pid": None if i < 30 else 2, "t": i} for i in range(34)])
    s = process_series(df.withColumn("pid", F.when(F.col("seq") >= 30, 2)), halo=2, limit=10)
    s.running(F.sum, total=F.lit(1)).whole(n=F.count(F.lit(1))).add(back=F.lag("seq", 2).over(s.w))
    got = by_seq(s.done(), "total", "n", "back")
    assert got == {i: ((i + 1, 30, i - 2 if i > 1 else None) if i < 30 else (i - 29, 4, i - 2 if i > 31 else None)) for i in range(34)}


def test_use_utc_sets_what_was_left_at_sparks_defaults(spark):
    from telltale.session import WIDE_ROWS, use_utc
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "65535")
        use_utc(spark)
        assert spark.conf.get(name) == WIDE_ROWS[name] == "8000"
        spark.conf.set(name, "1234")
        use_utc(spark)
        assert spark.conf.get(name) == "1234"
    finally:
        spark.conf.set(name, before)


def test_global_jump_orders_processes_not_rows(spark, monkeypatch):
    """Short processes, null keys among them, against the whole table in one order; only keys and values of tails are written."""
    import random
    from telltale.operators import ordering
    from telltale.operators.blocks import process_series
    rng, rows, seq = random.Random(3), [], 0
    for pid in [None, *range(30)]:
        for t in range(rng.choice([1, 2, 5, 19, 20, 33])):
            rows.append((seq, "s" if pid != 7 else None, pid, t, rng.choice([None, float(rng.randint(0, 60))]), float(rng.randint(0, 60)), "x"))
            seq += 1
    df = spark.createDataFrame(rows, "seq long, session_id string, pid long, t long, delta_cpu double, delta_mem double, exe string"
                               ).withColumn("timestamp", ordering.F.timestamp_seconds("t"))
    written, write = [], ordering.materialized
    monkeypatch.setattr(ordering, "materialized", lambda d, name: written.append(d.columns) or write(d, name))
    low = lambda x: (x is not None, x if x is not None else "")
    order = sorted(rows, key=lambda r: (low(r[1]), (r[2] is not None, r[2] or 0), r[3], r[0]))
    expected = {}
    for at, r in enumerate(order):
        past = order[max(0, at - 19):at]
        start = sum(1 for p in order[:at] if p[1:3] == r[1:3])

        def above(c):
            known = [p[c] for p in (past if start < 19 else past[-19:]) if p[c] is not None]
            return int(r[c] is not None and bool(known) and r[c] > max(known) and len(past) == 19)
        expected[r[0]] = (above(4), above(5))
    for limit in (None, 25):
        got = ordering.global_jump(process_series(df, halo=19, limit=limit))
        assert {r.seq: (r.cpu_jump, r.mem_jump) for r in got.collect()} == expected
        assert got.columns == [*df.columns, "cpu_jump", "mem_jump"]
    assert written and all("exe" not in c for c in written)


def test_percentile_rank_sorts_once_a_column(spark):
    from telltale.operators.features import percentile_rank
    df = spark.createDataFrame([("s", 1, 5.0, 1.0), ("s", 1, 5.0, None), ("s", 1, 2.0, 3.0), ("s", 2, None, 0.0), ("s", 2, -0.0, -0.0)],
                               "session_id string, pid long, cpu double, mem double")
    out = percentile_rank(df)
    assert sorted((r.pid, r.cpu or 0, r.cpu_pct_rank, r.mem_pct_rank) for r in out.na.fill(-1, ["cpu_pct_rank", "mem_pct_rank"]).collect()) == [
        (1, 2.0, 1 / 3, 1.0), (1, 5.0, 2.5 / 3, -1.0), (1, 5.0, 2.5 / 3, 0.5), (2, 0, -1.0, 0.75), (2, 0, 1.0, 0.75)]
    assert out._jdf.queryExecution().sparkPlan().toString().count("Window [") == 4
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Sort [") <= 3, plan


def test_global_jump_keeps_the_order_of_equal_times(spark):
    """Two rows of one time and seq: the first has the change, the second none, and the next process sees the second alone."""
    from telltale.operators import ordering
    from telltale.operators.blocks import process_series
    rows = [("s", 1, 0, 0, 90.0, 0.0), ("s", 1, 0, 0, 0.0, 0.0)] + [("s", 2, t, 10 + t, 1.0, 0.0) for t in range(18)] + [("s", 3, 0, 50, 50.0, 0.0)]
    df = spark.createDataFrame(rows, "session_id string, pid long, t long, seq long, delta_cpu double, delta_mem double").coalesce(1)
    got = ordering.global_jump(process_series(df.withColumn("timestamp", ordering.F.timestamp_seconds("t")), halo=19))
    assert [r.cpu_jump for r in got.where("pid = 3").collect()] == [1]
