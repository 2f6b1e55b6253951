import numpy as np
import pandas as pd
import pytest
from conftest import at, by_seq, stream_rows
from pyspark.sql import functions as F

from telltale.functions import scalars as sc
from telltale.operators import features as ft, ordering as od, quantiles as qt, stats as st, tree
from telltale.operators.blocks import Series, process_series
from telltale.plans import prepare
from telltale.schemas import ENGINEERED
from telltale.sources import fixtures as fx


def features(df):
    return ft.base_features(ft.series_for_features(df)).done()


def test_single_row_process(spark):
    row = features(stream_rows(spark, [{"cpu": 5.0, "mem": 2.0}])).first()
    assert row.cpu_std_5 == row.delta_cpu == row.cpu_burst == row.proc_age == 0
    assert row.cpu_ema == pytest.approx(5.0)


def test_counter_reset_is_negative_in_batch(spark):
    df = stream_rows(spark, [{"io_write_bytes": 100}, {"io_write_bytes": 5}])
    assert by_seq(features(df), "io_write_rate") == {0: 0.0, 1: -95.0}


def test_zero_denominator_gives_zero(spark):
    df = stream_rows(spark, [{"io_read_count": 5}, {"io_read_count": 4}])
    assert by_seq(features(df), "io_bytes_per_op")[1] == 0.0


def test_ema_burst_and_std_match_pandas(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.gamma(1.0, 20.0, 700), 2)
    df = stream_rows(spark, [{"cpu": float(v), "mem": float(v) / 2} for v in values])
    s = ft.rolling_burst(ft.deltas(ft.ema(ft.rolling_std(ft.series_for_features(df)))))
    got = s.done().toPandas().sort_values("seq")
    x = pd.Series(values)
    assert np.allclose(got.cpu_ema, x.ewm(span=10).mean(), atol=1e-11)
    assert np.allclose(got.cpu_std_10, x.rolling(10, min_periods=1).std().fillna(0), atol=1e-9)
    change = x.diff().fillna(0)
    assert (got.cpu_burst.values == (change > change.rolling(20, min_periods=1).quantile(0.95)).astype(int)).all()


def test_tied_ranks(spark):
    df = stream_rows(spark, [{"cpu": 1.0}, {"cpu": 1.0}, {"cpu": 3.0}])
    assert by_seq(ft.percentile_rank(df), "cpu_pct_rank") == {0: 0.5, 1: 0.5, 2: 1.0}


def test_ranks_leave_nulls_out_in_both_paths(spark):
    df = stream_rows(spark, [{"cpu": v} for v in (None, 3.0, 1.0, None, 1.0, 5.0, 2.0, None, 4.0)])
    want = {0: None, 1: 4 / 6, 2: 0.25, 3: None, 4: 0.25, 5: 1.0, 6: 0.5, 7: None, 8: 5 / 6}
    for limit in ("1000", "4"):
        spark.conf.set("spark.telltale.rowsPerBlock", limit)
        got = by_seq(ft.percentile_rank(df, columns=("cpu",)), "cpu_pct_rank")
        assert got.keys() == want.keys() and all(v is None if want[k] is None else abs(v - want[k]) < 1e-12 for k, v in got.items()), limit
    spark.conf.unset("spark.telltale.rowsPerBlock")


def test_fill_forward_back(spark):
    df = stream_rows(spark, [{"cpu": None}, {"cpu": 4.0}, {"cpu": None}, {"cpu": None, "pid": 2}])
    assert by_seq(ft.fill_forward_back(process_series(df)).done(), "cpu") == {0: 4.0, 1: 4.0, 2: 4.0, 3: 0.0}


def test_parent_zero_missing_and_null(spark):
    df = stream_rows(spark, [{"pid": 1, "cpu": 0.0}, {"pid": 2, "ppid": 1, "cpu": 8.0}, {"pid": 3, "ppid": 99, "cpu": 8.0},
                             {"pid": 4, "ppid": 2, "cpu": 4.0}])
    assert by_seq(tree.parent_normalize(df), "cpu_norm_parent") == {0: 0.0, 1: 0.0, 2: 0.0, 3: 0.5}


def test_parent_last_value_or_as_of(spark):
    df = stream_rows(spark, [{"pid": 1, "cpu": 2.0, "t": 0}, {"pid": 2, "ppid": 1, "cpu": 8.0, "t": 1}, {"pid": 1, "cpu": 4.0, "t": 2}])
    assert by_seq(tree.parent_normalize(df), "cpu_norm_parent")[1] == 2.0
    assert by_seq(tree.parent_normalize(df, as_of=True), "cpu_norm_parent")[1] == 4.0


def test_entropy(spark):
    snap = spark.createDataFrame([(1, 1, None, "p"), (1, 2, 1, "a"), (1, 3, 1, "a"), (1, 4, 1, "b")], "snap_ts int, pid long, ppid long, exe string")
    got = {r.pid: (r.num_children, round(r.child_entropy, 6)) for r in tree.child_tree_join(snap).collect()}
    assert got[1] == (3, 0.918296) and got[2] == (0, 0.0)


def test_clean_and_coerce(spark):
    df = spark.createDataFrame([("1.5", float("inf")), ("x", float("nan")), (None, 2.0)], "cpu string, y double")
    rows = sc.clean(sc.coerce_metrics(df, ["cpu", "mem"])).collect()
    assert [(r.cpu, r.mem, r.y) for r in rows] == [(1.5, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 2.0)]


def test_status_is_a_zero_feature(spark):
    df = stream_rows(spark, [{"cpu": 1.0}]).withColumn("label", F.lit(1))
    row = sc.select_features(df).first()
    assert row.status == 0.0 and row.cpu == 1.0 and row.label == 1


def test_format_rounds_half_even_on_binary_value(spark):
    values = [0.125, 1.005, 2.5, -0.001, 1234567.891]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.s for r in df.select(sc.format_metric("m", F.col("v")).alias("s")).collect()]
    assert got == [f"m={v:.2f}" for v in values]


def _same(a, b):
    a, b = (x.toPandas().set_index("seq").sort_index() for x in (a, b))
    for c in a.columns:
        if a[c].dtype.kind in "fiu":
            assert np.allclose(a[c].astype(float), b[c].astype(float), atol=1e-9, equal_nan=True), c


def test_blocks_change_nothing(spark, sf):
    def build():
        p = fx.process_view(spark, sf)
        s = ft.temporal_features(ft.base_features(ft.series_for_features(ft.percentile_rank(p))))
        return od.global_jump(s).drop("timestamp", "exe", "status", "session_id")

    plain = build().toPandas()
    spark.conf.set("spark.telltale.rowsPerBlock", "6")
    try:
        assert ft.series_for_features(fx.process_view(spark, sf)).hot is not None
        split = build().toPandas()
    finally:
        spark.conf.unset("spark.telltale.rowsPerBlock")
    _same(spark.createDataFrame(plain), spark.createDataFrame(split))


def test_hot_process_is_split(spark, small_blocks):
    rows = [{"cpu": float(i % 7), "pid": 1, "t": i} for i in range(60)] + [{"cpu": 1.0, "pid": 2, "t": i} for i in range(3)]
    s = process_series(stream_rows(spark, rows), halo=3)
    sizes = s.df.where(~F.col("_halo")).groupBy("pid", "_blk").count().collect()
    assert len([r for r in sizes if r.pid == 1]) >= 8 and max(r["count"] for r in sizes) <= 12
    s.running(F.sum, total=F.lit(1)).add(back=F.lag("seq", 3).over(s.w))
    got = by_seq(s.done(), "total", "back")
    assert all(got[i] == (i + 1, i - 3 if i >= 3 else None) for i in range(60))


def test_blocks_of_unequal_size_keep_the_halo(spark, small_blocks):
    times = [0] + [1000 + i for i in range(5)] + [5000 + i * 0.01 for i in range(30)] + [90000, 90001]
    df = stream_rows(spark, [{"t": t} for t in times])
    s = process_series(df, halo=20)
    s.add(back=F.lag("seq", 20).over(s.w), held=F.least(s.index, F.lit(20)))
    assert by_seq(s.done(), "back", "held") == {i: (i - 20 if i >= 20 else None, min(i + 1, 20)) for i in range(len(times))}


def test_quantiles_of_large_groups(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(v)) for g in ("a", "b") for v in np.round(rng.normal(0, 50, 400 if g == "a" else 7), 1)]
    df = spark.createDataFrame(rows, "g string, x double")
    for limit in (10_000, 20):
        got = {r.g: (r.lo, r.mid) for r in qt.exact_quantiles(df, ["g"], "x", {"lo": 0.25, "mid": 0.5}, limit).collect()}
        for g in ("a", "b"):
            x = [v for k, v in rows if k == g]
            assert got[g] == pytest.approx((np.quantile(x, 0.25), np.quantile(x, 0.5)))
    assert qt.exact_quantiles(df, [], "x", {"q": 0.95}, 20).first().q == pytest.approx(np.quantile([v for _, v in rows], 0.95))


def test_order_and_partitions_do_not_matter(spark, sf):
    p = fx.process_view(spark, sf)
    shuffled = p.orderBy(F.md5(F.col("seq").cast("string"))).repartition(7)
    _same(prepare.engineer(p).select("seq", *ENGINEERED), prepare.engineer(shuffled).select("seq", *ENGINEERED))


def test_feature_plan_has_one_exchange(spark, sf):
    p = fx.events(spark, sf).select(F.col("event_id").alias("seq"), "timestamp", F.lit("s").alias("session_id"),
                                    F.col("user_id").alias("pid"), F.col("value").alias("cpu"), F.col("value").alias("mem"),
                                    *[F.col("event_id").alias(c) for c in set(ft.DELTAS.values()) - {"cpu", "mem"}])
    df = ft.temporal_features(ft.base_features(ft.series_for_features(p))).done()
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("\n") and plan.count("- Sort [") == 1


def test_process_stats_with_blocks(spark, small_blocks):
    df = stream_rows(spark, [{"cpu": float(i * i % 13), "mem": float(i), "t": i} for i in range(40)]).withColumn("proc_age", F.lit(1.0))
    row = st.process_stats_join(df).first()
    x = np.array([i * i % 13 for i in range(40)], dtype=float)
    assert row.cpu_median == np.median(x) and row.cpu_mean == pytest.approx(x.mean()) and row.cpu_std == pytest.approx(x.std(ddof=1))
    assert row.observation_count == 40 and at(0) is not None
