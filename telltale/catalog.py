"""Every operator as a named query over the driver's tables, with its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telltale import oracles as o
from telltale.functions import scalars as sc
from telltale.functions.scalars import rounded
from telltale.operators import (attack, features as ft, labeling as lb, learning as ml, metrics as mt, neighbours as nb,
                                ordering as od, rules, sampling as sp, scaling as sca, stats as st, tree)
from telltale.operators.blocks import process_series
from telltale.plans import live, prepare, train as training
from telltale.schemas import ENGINEERED, METRICS, MODEL_FEATURES, PROCESS_STREAM
from telltale.session import ROW_GROUP, materialized, scratch_path
from telltale.sources import fixtures as fx, logs, sinks
from telltale.streaming.alerts import LiveDetector, alert_totals, rule_scorer, threshold_alerts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def _r(*names: str) -> list[Column]:
    return [rounded(F.col(n)).alias(n) for n in names]


def _rs(*names: str) -> str:
    return ", ".join(f"{o.r(n)} as {n}" for n in names)


def _r8(*names: str) -> list[Column]:
    return [rounded(F.col(n), 8).alias(n) for n in names]


def _rs8(*names: str) -> str:
    return ", ".join(f"{o.r(n, 8)} as {n}" for n in names)


def _dated(df: DataFrame) -> DataFrame:
    """Timestamps without a zone, as the tables hold them."""
    return df.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema.fields
                           if f.dataType.typeName() == "timestamp"})


def _series(spark, sf, halo=True):
    p = fx.process_view(spark, sf)
    return ft.series_for_features(p) if halo else process_series(p)


def _periods(spark, sf) -> DataFrame:
    return lb.pair_periods(fx.event_log(spark, sf), fx.process_view(spark, sf))


def _labeled(spark, sf) -> DataFrame:
    return lb.label_windows(fx.process_view(spark, sf), _periods(spark, sf))


_WRITTEN: dict[tuple, DataFrame] = {}


def _once(spark, sf, name, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, written to the shared folder once per application and input."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _WRITTEN:
        _WRITTEN[key] = materialized(build(), name, ROW_GROUP)
    return _WRITTEN[key]


def _dataset(spark, sf) -> DataFrame:
    """The labeled, feature-complete dataset that rules and models start from."""
    return _once(spark, sf, "dataset", lambda: prepare.prepare_dataset(fx.process_view(spark, sf), fx.event_log(spark, sf)))


def _marked(spark, sf) -> DataFrame:
    """seq and a label taken from the row's own kind."""
    return fx.process_view(spark, sf).select("seq", "session_id", "timestamp", (F.col("exe") == "error").cast("int").alias("label"))


# ---- sources and sinks -------------------------------------------------------------------------
STREAM_COLS = ["session_id", "pid", "ppid", "cpu", "mem", "exe", "num_children", "num_connections", "num_threads", "num_fds",
               "io_write_bytes", "io_read_bytes", "io_write_count", "io_read_count", "ctx_switches_voluntary",
               "ctx_switches_involuntary", "status"]
STREAM_SQL = o.sql(f"select seq, ts, {', '.join(STREAM_COLS)} from v_proc", o.V_PROC)


def _stream_file_columns(p: DataFrame) -> DataFrame:
    return p.select("seq", *[F.col(f.name) if f.name in p.columns else F.lit(0).cast(f.dataType).alias(f.name)
                             for f in PROCESS_STREAM.fields])


@query("scan_process_stream", STREAM_SQL)
def _(spark, sf):
    path = scratch_path(spark, "stream")
    _stream_file_columns(fx.process_view(spark, sf)).write.option("header", True).option(
        "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").csv(path)
    back = logs.scan_process_stream(spark, path, with_seq=True)
    return _dated(back.select("seq", F.col("timestamp").alias("ts"), *STREAM_COLS))


LINES_SQL = """lines as (
  select event_id as seq, case event_type when 'view' then 'x' when 'click' then 'bad,anomaly_start'
           when 'purchase' then concat(t, ',normal_end') else concat(t, ',anomaly_', event_type, ',pid=', cast(user_id as varchar), ',k=1') end as value
  from (select *, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' as t from events) e)"""


def _lines(spark, sf) -> DataFrame:
    t = F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    kind = F.col("event_type")
    value = (F.when(kind == "view", "x").when(kind == "click", "bad,anomaly_start")
             .when(kind == "purchase", F.concat(t, F.lit(",normal_end")))
             .otherwise(F.concat(t, F.lit(",anomaly_"), kind, F.lit(",pid="), F.col("user_id").cast("string"), F.lit(",k=1"))))
    return fx.events(spark, sf).select(F.col("event_id").alias("seq"), value.alias("value"))


@query("scan_event_log", o.sql("""
select seq, ts, event_type, details from (
  select seq, try_cast(split_part(value, ',', 1) as timestamp) as ts, split_part(value, ',', 2) as event_type,
         array_to_string(string_split(value, ',')[3:], ',') as details
  from (select value, row_number() over (order by seq) - 1 as seq from lines) n where contains(value, ',')) t
where ts is not null""", LINES_SQL))
def _(spark, sf):
    path = scratch_path(spark, "eventlog")
    # several files of unequal size: the reader takes the largest first
    lines = _lines(spark, sf)
    part = F.floor(F.sqrt(F.col("seq") / (lines.agg(F.max("seq")).first()[0] + 1)) * 5).cast("int")
    for i in range(5):
        one = lines.where(part == i).coalesce(1).sortWithinPartitions("seq")
        one.select("value").write.text(f"{path}/n={i}")
    return _dated(logs.scan_event_log(spark, f"{path}/*").select("seq", F.col("timestamp").alias("ts"), "event_type", "details"))


@query("parse_timestamps", o.sql("""
select seq, ts from (select seq, try_cast(split_part(value, ',', 1) as timestamp) as ts from lines) t where ts is not null""", LINES_SQL))
def _(spark, sf):
    parsed = _lines(spark, sf).select("seq", logs.parse_timestamp(F.split("value", ",")[0]).alias("ts"))
    return _dated(logs.drop_unparsed(parsed, "ts"))


@query("scan_labeled", o.sql("select seq, cpu, mem, cast(io_write_bytes as double) as io_write_bytes, 0.0::double as child_entropy, label from v_proc join v_label using (seq)", *o.LABEL_CTE))
def _(spark, sf):
    path = sinks.sink_results(_labeled(spark, sf), scratch_path(spark, "labeled"))
    back = logs.scan_labeled(spark, path, columns=METRICS)
    return back.select("seq", "cpu", "mem", "io_write_bytes", "child_entropy", "label")


@query("scan_sessions", o.sql("select seq, session_id, cpu, session_id as session from v_proc", o.V_PROC))
def _(spark, sf):
    root = sinks.sink_labeled(fx.process_view(spark, sf).select("seq", "session_id", "cpu"), scratch_path(spark, "sessions"))
    found = logs.scan_sessions(spark, root).withColumn("session", F.regexp_replace("session", "session_id=", ""))
    return found.select("seq", "session_id", "cpu", "session")


@query("sink_labeled", o.sql("select seq, session_id, pid, cpu, label from v_proc join v_label using (seq)", *o.LABEL_CTE))
def _(spark, sf):
    path = sinks.sink_labeled(_labeled(spark, sf), scratch_path(spark, "dataset"), by_time=True)
    return spark.read.parquet(path).select("seq", "session_id", "pid", "cpu", "label")


@query("sink_results", o.sql(f"select model, {_rs('roc_auc', 'avg_precision', 'f1', 'mcc', 'fpr', 'fnr')}, tp, tn, fp, fn from v_results", o.V_PROC, o.RESULTS))
def _(spark, sf):
    path = sinks.sink_results(_results(spark, sf), scratch_path(spark, "results"))
    return spark.read.parquet(path).select("model", *_r(*mt.TABLE), "tp", "tn", "fp", "fn")


# ---- scalar expressions ------------------------------------------------------------------------
@query("filter_anomaly_events", o.sql("""
select seq, event_type from (select seq, case when seq % 5 = 0 then null when seq % 5 = 1 then upper(event_type) else event_type end as event_type from v_evlog) t
where coalesce(contains(lower(event_type), 'anomaly'), false)""", o.V_EVLOG))
def _(spark, sf):
    kind = F.when(F.col("seq") % 5 != 0, F.when(F.col("seq") % 5 == 1, F.upper("event_type")).otherwise(F.col("event_type")))
    return fx.event_log(spark, sf).select("seq", kind.alias("event_type")).where(sc.is_anomaly_event(F.col("event_type")))


@query("coerce_numeric", "select event_id as seq, coalesce(try_cast(case when event_type = 'click' then 'n/a' else cast(value as varchar) end as double), 0) as cpu, "
       "coalesce(try_cast(props as double), 0) as mem, 0.0::double as num_fds from events")
def _(spark, sf):
    raw = fx.events(spark, sf).select(
        F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "n/a").otherwise(F.col("value").cast("string")).alias("cpu"),
        F.col("props").alias("mem"))
    return sc.coerce_metrics(raw, ["cpu", "mem", "num_fds"])


@query("clean_inf_nan", "select event_id as seq, case event_type when 'error' then 0 when 'click' then 0 when 'view' then 0 when 'signup' then 0 else value end::double as x from events")
def _(spark, sf):
    x = (F.when(F.col("event_type") == "error", float("inf")).when(F.col("event_type") == "click", float("nan"))
         .when(F.col("event_type") == "signup", float("-inf")).when(F.col("event_type") == "purchase", F.col("value")))
    return sc.clean(fx.events(spark, sf).select(F.col("event_id").alias("seq"), x.alias("x"))).select("seq", "x")


@query("select_features", o.sql("""
select seq, cpu, mem, cast(num_children as double) as num_children, cast(num_connections as double) as num_connections,
  cast(num_threads as double) as num_threads, cast(num_fds as double) as num_fds, cast(io_write_bytes as double) as io_write_bytes,
  cast(io_read_bytes as double) as io_read_bytes, cast(io_write_count as double) as io_write_count, cast(io_read_count as double) as io_read_count,
  cast(ctx_switches_voluntary as double) as ctx_switches_voluntary, cast(ctx_switches_involuntary as double) as ctx_switches_involuntary,
  0.0::double as status, label from v_proc join v_label using (seq)""", *o.LABEL_CTE))
def _(spark, sf):
    return sc.select_features(_labeled(spark, sf), keep=("seq",))


@query("has_children", o.sql("select seq, cast(num_children > 0 as int) as has_children from v_proc", o.V_PROC))
def _(spark, sf):
    return fx.process_view(spark, sf).select("seq", sc.has_children().alias("has_children"))


@query("relative_rates", o.sql(f"select seq, {_rs('cpu_rate', 'mem_rate')} from f_all", *o.FEATURES_CTE))
def _(spark, sf):
    s = ft.rolling_std(ft.rolling_mean(_series(spark, sf), (5,)), (5,))
    s.add(cpu_rate=sc.relative_rate("cpu"), mem_rate=sc.relative_rate("mem"))
    return s.done().select("seq", *_r("cpu_rate", "mem_rate"))


@query("ema_spike", o.sql(f"select seq, {_rs('cpu_spike', 'mem_spike')} from f_all", *o.FEATURES_CTE))
def _(spark, sf):
    s = ft.ema(_series(spark, sf)).add(cpu_spike=sc.ema_spike("cpu"), mem_spike=sc.ema_spike("mem"))
    return s.done().select("seq", *_r("cpu_spike", "mem_spike"))


def _rates(spark, sf):
    s = ft.deltas(_series(spark, sf))
    return s.add(io_total_rate=sc.io_total_rate(), ctx_total_rate=sc.ctx_total_rate())


@query("io_bytes_per_op", o.sql(f"select seq, {_rs('io_bytes_per_op')} from f_all", *o.FEATURES_CTE))
def _(spark, sf):
    return _rates(spark, sf).done().select("seq", rounded(sc.io_bytes_per_op()).alias("io_bytes_per_op"))


@query("rate_totals", o.sql("select seq, io_total_rate, ctx_total_rate from f_all", *o.FEATURES_CTE))
def _(spark, sf):
    return _rates(spark, sf).done().select("seq", "io_total_rate", "ctx_total_rate")


@query("ctx_involuntary_ratio", o.sql(f"select seq, {_rs('ctx_involuntary_ratio')} from f_all", *o.FEATURES_CTE))
def _(spark, sf):
    return _rates(spark, sf).done().select("seq", rounded(sc.ctx_involuntary_ratio()).alias("ctx_involuntary_ratio"))


BASELINE = ["cpu_baseline", "mem_baseline", "io_baseline"]
DEVIATION = ["cpu_dev_from_baseline", "mem_dev_from_baseline", "io_dev_from_baseline", "cpu_pct_dev_baseline", "mem_pct_dev_baseline"]


@query("baseline_deviation", o.sql(f"select seq, {_rs(*DEVIATION)} from f_all", *o.FEATURES_CTE))
def _(spark, sf):
    return ft.process_baseline(_rates(spark, sf)).add(**sc.baseline_deviation()).done().select("seq", *_r(*DEVIATION))


@query("usage_per_age", o.sql(f"select seq, {_rs('cpu_per_age', 'mem_per_age', 'io_per_age')} from f_all", *o.FEATURES_CTE))
def _(spark, sf):
    return ft.process_age(_rates(spark, sf)).add(**sc.usage_per_age()).done().select("seq", *_r("cpu_per_age", "mem_per_age", "io_per_age"))


@query("interactions", o.sql(f"select seq, {o.r('cpu * mem')} as cpu_mem_product, {o.r('cpu / (mem + 1e-6)', 4)} as cpu_mem_ratio, {o.r('cpu + mem')} as resource_pressure from v_proc", o.V_PROC))
def _(spark, sf):
    x = sc.interactions()
    return fx.process_view(spark, sf).select("seq", rounded(x["cpu_mem_product"]).alias("cpu_mem_product"),
                                             rounded(x["cpu_mem_ratio"], 4).alias("cpu_mem_ratio"), rounded(x["resource_pressure"]).alias("resource_pressure"))


@query("format_metric", o.sql("select seq, printf('cpu=%.2f', cpu) as shown, printf('CPU usage: %.1f%%', cpu) as indicator from v_proc", o.V_PROC))
def _(spark, sf):
    return fx.process_view(spark, sf).select("seq", sc.format_metric("cpu", F.col("cpu")).alias("shown"),
                                             F.concat(F.lit("CPU usage: "), attack._shown("cpu", "0.0"), F.lit("%")).alias("indicator"))


@query("confidence_band", o.sql("select seq, case when score > 0.9 then 'HIGH' when score > 0.8 then 'MEDIUM' else 'LOW' end as confidence from v_scored", o.V_PROC, o.V_SCORED))
def _(spark, sf):
    return fx.scored(fx.process_view(spark, sf)).select("seq", sc.confidence_band(F.col("score")).alias("confidence"))


@query("add_session_tag", o.sql("select seq, session_id, 'night' as session from v_proc", o.V_PROC))
def _(spark, sf):
    return sc.with_session_tag(fx.process_view(spark, sf).select("seq", "session_id"), "night")


# ---- joins -------------------------------------------------------------------------------------
@query("label_windows", o.sql("select seq, label from v_label", *o.LABEL_CTE))
def _(spark, sf):
    return _labeled(spark, sf).select("seq", "label")


@query("baseline_join", o.sql(f"select seq, {_rs(*BASELINE)} from f_all", *o.FEATURES_CTE))
def _(spark, sf):
    return ft.process_baseline(_rates(spark, sf)).done().select("seq", *_r(*BASELINE))


@query("parent_normalize", o.sql(f"select seq, {_rs('cpu_norm_parent', 'mem_norm_parent')} from f_all", *o.FEATURES_CTE))
def _(spark, sf):
    return tree.parent_normalize(fx.process_view(spark, sf)).select("seq", *_r("cpu_norm_parent", "mem_norm_parent"))


@query("parent_normalize_as_of", o.sql(f"""
select seq, {o.r('coalesce(cpu / nullif(pc, 0), 0)')} as cpu_norm_parent, {o.r('coalesce(mem / nullif(pm, 0), 0)')} as mem_norm_parent from (
  select a.seq, a.cpu, a.mem, arg_max(b.cpu, (b.ts, b.seq)) as pc, arg_max(b.mem, (b.ts, b.seq)) as pm
  from v_proc a left join v_proc b on a.session_id = b.session_id and a.ppid = b.pid and b.ts <= a.ts group by a.seq, a.cpu, a.mem) t""", o.V_PROC))
def _(spark, sf):
    return tree.parent_normalize(fx.process_view(spark, sf), as_of=True).select("seq", *_r("cpu_norm_parent", "mem_norm_parent"))


STATS_SQL = """v_stats as (
  select session_id, pid, avg(cpu) as cpu_mean, stddev_samp(cpu) as cpu_std, max(cpu) as cpu_max, min(cpu) as cpu_min, median(cpu) as cpu_median,
         avg(mem) as mem_mean, stddev_samp(mem) as mem_std, max(mem) as mem_max, min(mem) as mem_min, median(mem) as mem_median,
         avg(num_children) as num_children_mean, max(num_children) as num_children_max, max(proc_age) as proc_age_max, count(ts) as observation_count
  from (select *, (epoch_us(ts) - epoch_us(min(ts) over (partition by session_id, pid))) / 1e6 as proc_age from v_proc) p group by all)"""
STATS = ["cpu_mean", "cpu_std", "cpu_max", "cpu_min", "cpu_median", "mem_mean", "mem_std", "mem_max", "mem_min", "mem_median",
         "num_children_mean", "proc_age_max"]


def _aged(spark, sf):
    return ft.process_age(_series(spark, sf, halo=False)).done()


@query("process_stats_join", o.sql(f"select seq, {_rs8(*STATS)}, num_children_max, observation_count from v_proc join v_stats using (session_id, pid)", o.V_PROC, STATS_SQL))
def _(spark, sf):
    return st.process_stats_join(_aged(spark, sf)).select("seq", *_r8(*STATS), "num_children_max", "observation_count")


@query("child_tree_join", o.sql(f"""
select s.snap_ts, s.pid, s.ppid, s.exe, coalesce(c.n, 0) as num_children, {o.r('coalesce(e.h, 0)')} as child_entropy from v_snapshot s
left join (select snap_ts, ppid, count(*) as n from v_snapshot group by all) c on c.snap_ts = s.snap_ts and c.ppid = s.pid
left join (select snap_ts, ppid, -sum(p * log2(p)) as h from (
  select snap_ts, ppid, exe, count(*) / sum(count(*)) over (partition by snap_ts, ppid) as p from v_snapshot group by snap_ts, ppid, exe) x group by all) e
  on e.snap_ts = s.snap_ts and e.ppid = s.pid""", o.V_PROC, o.V_SNAPSHOT))
def _(spark, sf):
    return _dated(tree.child_tree_join(fx.snapshots(fx.process_view(spark, sf)))).select(
        "snap_ts", "pid", "ppid", "exe", "num_children", *_r("child_entropy"))


# ---- aggregations ------------------------------------------------------------------------------
@query("process_baseline", o.sql(f"select session_id, pid, {_rs(*BASELINE)} from f_base", *o.FEATURES_CTE))
def _(spark, sf):
    return ft.baselines(_rates(spark, sf)).select("session_id", "pid", *_r(*BASELINE))


@query("last_per_process", o.sql("select session_id, pid, arg_max(cpu, (ts, seq)) as last_cpu, arg_max(mem, (ts, seq)) as last_mem from v_proc group by all", o.V_PROC))
def _(spark, sf):
    return tree.last_per_process(fx.process_view(spark, sf))


@query("process_stats", o.sql(f"select session_id, pid, {_rs8(*STATS)}, num_children_max, observation_count from v_stats", o.V_PROC, STATS_SQL))
def _(spark, sf):
    return st.process_stats(_aged(spark, sf)).select("session_id", "pid", *_r8(*STATS), "num_children_max", "observation_count")


@query("deviation_from_avg", o.sql(f"select seq, {o.r('cpu - cpu_mean', 8)} as cpu_dev_from_avg, {o.r('mem - mem_mean', 8)} as mem_dev_from_avg from v_proc join v_stats using (session_id, pid)", o.V_PROC, STATS_SQL))
def _(spark, sf):
    s = _series(spark, sf, halo=False).whole(cpu_mean=F.avg("cpu"), mem_mean=F.avg("mem"))
    return st.deviation_from_avg(s.done()).select("seq", *_r8("cpu_dev_from_avg", "mem_dev_from_avg"))


@query("child_count", o.sql("select snap_ts, ppid, count(*) as num_children from v_snapshot where ppid is not null group by all", o.V_PROC, o.V_SNAPSHOT))
def _(spark, sf):
    return _dated(tree.child_count(fx.snapshots(fx.process_view(spark, sf))))


@query("child_exe_entropy", o.sql(f"""
select snap_ts, ppid, cast(sum(n) as bigint) as num_children, {o.r('-sum(p * log2(p))')} as child_entropy from (
  select snap_ts, ppid, exe, count(*) as n, count(*) / sum(count(*)) over (partition by snap_ts, ppid) as p
  from v_snapshot where ppid is not null group by snap_ts, ppid, exe) x group by all""", o.V_PROC, o.V_SNAPSHOT))
def _(spark, sf):
    return _dated(tree.child_exe_entropy(fx.snapshots(fx.process_view(spark, sf)))).select("snap_ts", "ppid", "num_children", *_r("child_entropy"))


@query("session_breakdown", o.sql(f"select session_id, count(*) as total, cast(sum(label) as bigint) as anomalies, {o.r('avg(label)', 4)} as anomaly_rate from v_proc join v_label using (seq) group by 1", *o.LABEL_CTE))
def _(spark, sf):
    return st.session_breakdown(_labeled(spark, sf))


@query("class_distribution", o.sql(f"select label, count(*) as n, {o.r('count(*) * 100.0 / sum(count(*)) over ()')} as pct, {o.r('sum(sum(label)) over () * 100.0 / sum(count(*)) over ()')} as anomaly_rate from v_label group by 1", *o.LABEL_CTE))
def _(spark, sf):
    return st.class_distribution(_labeled(spark, sf)).select("label", "n", *_r("pct", "anomaly_rate"))


@query("class_weight", o.sql(f"select count(*) filter (label = 0) as negatives, count(*) filter (label = 1) as positives, {o.r('count(*) filter (label = 0) / greatest(count(*) filter (label = 1), 1)')} as weight from v_label", *o.LABEL_CTE))
def _(spark, sf):
    return st.class_weight(_labeled(spark, sf)).select("negatives", "positives", *_r("weight"))


PERIOD_SQL = f"""
select q.session_id, start_ts, end_ts, {o.r('(epoch_us(end_ts) - epoch_us(start_ts)) / 1e6')} as seconds,
  (select count(*) from v_proc p where p.session_id = q.session_id and p.ts between q.start_ts - interval 30 second and q.end_ts + interval 30 second) as rows_labeled
from periods q"""


@query("period_summary", o.sql(PERIOD_SQL, o.V_PROC, o.V_EVLOG, o.PERIODS))
def _(spark, sf):
    out = lb.period_summary(fx.process_view(spark, sf), _periods(spark, sf), 30)
    return _dated(out).select("session_id", "start_ts", "end_ts", *_r("seconds"), "rows_labeled")


@query("period_totals", o.sql(f"""
select (select count(*) from per) as periods, (select cast(sum(rows_labeled) as bigint) from per) as rows_with_overlaps,
  (select count(*) from v_proc p where exists (select 1 from periods q where q.session_id = p.session_id
     and p.ts between q.start_ts - interval 30 second and q.end_ts + interval 30 second)) as rows_labeled,
  (select count(*) from v_proc) as rows_total""", o.V_PROC, o.V_EVLOG, o.PERIODS, f"per as ({PERIOD_SQL})"))
def _(spark, sf):
    return lb.period_totals(fx.process_view(spark, sf), _periods(spark, sf), 30)


# ---- windows -----------------------------------------------------------------------------------
@query("fill_forward_back", o.sql("""
select seq, coalesce(last_value(x ignore nulls) over (partition by session_id, pid order by ts, seq),
                     first_value(x ignore nulls) over (partition by session_id, pid order by ts, seq rows between current row and unbounded following), 0)::double as cpu
from (select *, case when num_children < 4 then null else cpu end as x from v_proc) t""", o.V_PROC))
def _(spark, sf):
    p = fx.process_view(spark, sf).withColumn("cpu", F.when(F.col("num_children") >= 4, F.col("cpu")))
    return ft.fill_forward_back(process_series(p), ("cpu",)).done().select("seq", "cpu")


ROLL = [f"{c}_{{}}_{n}" for n in (5, 10) for c in ("cpu", "mem")]


@query("rolling_mean", o.sql(f"select seq, {_rs(*[x.format('mean') for x in ROLL])} from f_all", *o.FEATURES_CTE))
def _(spark, sf):
    return ft.rolling_mean(_series(spark, sf)).done().select("seq", *_r(*[x.format("mean") for x in ROLL]))


@query("rolling_std", o.sql(f"select seq, {_rs(*[x.format('std') for x in ROLL])} from f_all", *o.FEATURES_CTE))
def _(spark, sf):
    return ft.rolling_std(_series(spark, sf)).done().select("seq", *_r(*[x.format("std") for x in ROLL]))


EXTREMA = [f"{c}_{m}_{n}" for n in (3, 10, 20) for c, m in (("cpu", "max"), ("cpu", "min"), ("mem", "max"))]


@query("rolling_extrema", o.sql("select seq, " + ", ".join(f"{o.over(x.split('_')[1], int(x.split('_')[2]), x.split('_')[0])} as {x}" for x in EXTREMA) + " from v_proc", o.V_PROC))
def _(spark, sf):
    return ft.rolling_extrema(_series(spark, sf)).done().select("seq", *EXTREMA)


@query("rolling_burst", o.sql("select seq, io_write_burst, cpu_burst, mem_burst from f_all", *o.FEATURES_CTE))
def _(spark, sf):
    return ft.rolling_burst(ft.deltas(_series(spark, sf))).done().select("seq", *ft.BURSTS)


@query("ema_span10", o.sql(f"select seq, {_rs('cpu_ema', 'mem_ema')} from f_ema", o.V_PROC, o.F_DELTA, o.F_EMA))
def _(spark, sf):
    return ft.ema(_series(spark, sf)).done().select("seq", *_r("cpu_ema", "mem_ema"))


@query("deltas", o.sql(f"select seq, {_rs(*ft.DELTAS)} from f_delta", o.V_PROC, o.F_DELTA))
def _(spark, sf):
    return ft.deltas(_series(spark, sf)).done().select("seq", *_r(*ft.DELTAS))


TREND_SQL = f"""v_trend as (select *, coalesce(cpu - lag(cpu, 5) over ({o.KEY}), 0) as cpu_trend, coalesce(mem - lag(mem, 5) over ({o.KEY}), 0) as mem_trend from v_proc)"""


@query("trend5", o.sql(f"select seq, {_rs('cpu_trend', 'mem_trend')} from v_trend", o.V_PROC, TREND_SQL))
def _(spark, sf):
    return ft.trend(_series(spark, sf)).done().select("seq", *_r("cpu_trend", "mem_trend"))


@query("acceleration", o.sql(f"select seq, {o.r(f'coalesce(cpu_trend - lag(cpu_trend) over ({o.KEY}), 0)')} as cpu_acceleration from v_trend", o.V_PROC, TREND_SQL))
def _(spark, sf):
    return ft.acceleration(ft.trend(_series(spark, sf))).done().select("seq", *_r("cpu_acceleration"))


@query("volatility", o.sql("select seq, " + ", ".join(f"{o.r('coalesce(' + o.over('stddev_samp', 10, c) + ', 0)')} as {c}_volatility" for c in ("cpu", "mem")) + " from v_proc", o.V_PROC))
def _(spark, sf):
    return ft.volatility(_series(spark, sf)).done().select("seq", *_r("cpu_volatility", "mem_volatility"))


def _rank_sql(c: str) -> str:
    expr = (f"(case when {c} is not null then rank() over (partition by session_id, pid order by {c} nulls last) end + (count(*) over (partition by session_id, pid, {c}) - 1) / 2.0)"
            f" / count({c}) over (partition by session_id, pid)")
    return f"{o.r(expr)} as {c}_pct_rank"


@query("percentile_rank", o.sql(f"select seq, {_rank_sql('cpu')}, {_rank_sql('mem')} from v_proc", o.V_PROC))
def _(spark, sf):
    return ft.percentile_rank(fx.process_view(spark, sf)).select("seq", *_r("cpu_pct_rank", "mem_pct_rank"))


def _jump_sql(c: str) -> str:
    order = "order by session_id, pid, ts, seq"
    return (f"cast(case when count(*) over ({order} rows between 19 preceding and current row) = 20 and "
            f"{c} > {o.q95(c, order)} then 1 else 0 end as int)")


@query("global_jump", o.sql(f"select seq, {_jump_sql('delta_cpu')} as cpu_jump, {_jump_sql('delta_mem')} as mem_jump from f_delta", o.V_PROC, o.F_DELTA))
def _(spark, sf):
    return od.global_jump(ft.deltas(_series(spark, sf), ("delta_cpu", "delta_mem"))).select("seq", "cpu_jump", "mem_jump")


@query("process_jump", o.sql("select seq, cast(rn >= 20 and cpu_burst = 1 as int) as cpu_jump, cast(rn >= 20 and mem_burst = 1 as int) as mem_jump from f_all", *o.FEATURES_CTE))
def _(spark, sf):
    s = ft.deltas(_series(spark, sf), ("delta_cpu", "delta_mem"))
    s.add(**{f"{c}_jump": F.when(s.index >= 20, ft.above_rolling_q95(F.col(f"delta_{c}"), s.before(19))).otherwise(0) for c in ("cpu", "mem")})
    return s.done().select("seq", "cpu_jump", "mem_jump")


@query("process_age", o.sql(f"select seq, {_rs('proc_age')} from f_all", *o.FEATURES_CTE))
def _(spark, sf):
    return _aged(spark, sf).select("seq", *_r("proc_age"))


@query("pair_periods", o.sql("select session_id, start_ts, end_ts from periods", o.V_PROC, o.V_EVLOG, o.PERIODS))
def _(spark, sf):
    return _dated(_periods(spark, sf))


@query("pair_periods_outer", o.sql("""
select session_id, open_ts as start_ts, coalesce(close_ts, stream_end) as end_ts from (
  select session_id, kind, ts as open_ts, lead(ts) over (partition by session_id order by seq) as close_ts,
         (select max(ts) from v_proc p where p.session_id = z.session_id) as stream_end from (
    select *, s - m as depth, lag(m, 1, 0) over (partition by session_id order by seq) as was from (
      select *, least(0, min(s) over (partition by session_id order by seq)) as m from (
        select *, sum(case kind when 'start' then 1 else -1 end) over (partition by session_id order by seq) as s from kept) x) y) z
  where (kind = 'start' and depth = 1) or (kind = 'end' and depth = 0 and m = was)) t
where kind = 'start'""", o.V_PROC, o.V_EVLOG, o.KEPT))
def _(spark, sf):
    return _dated(lb.pair_periods(fx.event_log(spark, sf), fx.process_view(spark, sf), nesting="outer"))


@query("orphan_events", o.sql("""
select session_id, seq, issue from (
  select session_id, seq, case when kind = 'start' and coalesce(lead(kind) over w, 'start') = 'start' then 'unclosed_start'
    when kind = 'end' and coalesce(lag(kind) over w, 'end') = 'end' then 'end_without_start' end as issue
  from kept window w as (partition by session_id order by seq)) t where issue is not null""", o.V_EVLOG, o.KEPT))
def _(spark, sf):
    return lb.orphan_events(fx.event_log(spark, sf))


# ---- order and top-k ---------------------------------------------------------------------------
@query("order_series", o.sql(f"select seq, session_id, pid, cast(row_number() over ({o.KEY}) as int) as place from v_proc", o.V_PROC))
def _(spark, sf):
    s = process_series(od.order_series(fx.process_view(spark, sf).select("seq", "session_id", "pid", "timestamp")))
    s.running(F.sum, place=F.lit(1))
    return s.done().select("seq", "session_id", "pid", F.col("place").cast("int").alias("place"))


@query("order_combined", o.sql("select seq, cast(row_number() over (order by ts, seq) - 1 as bigint) as row_index from v_proc", o.V_PROC))
def _(spark, sf):
    p = fx.process_view(spark, sf).select("seq", "timestamp")
    return od.order_combined(od.global_index(p)).select("seq", F.col("row_index").cast("long").alias("row_index"))


TOP_INPUTS = ["cpu", "mem", "num_children", "num_connections", "num_threads", "num_fds", "delta_cpu", "delta_mem", "io_write_rate", "cpu_burst"]
IMPORTANCE = {c: w for c, w in zip(TOP_INPUTS, (0.2, 0.15, 0.1, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05, 0.05))}
TOP_SQL = f"""v_long as (
  select seq, name, value, i, imp * (abs(value) / (abs(value) + 1)) as contribution from (
    {" union all ".join(f"select seq, '{c}' as name, cast({c} as double) as value, {i} as i, {IMPORTANCE[c]}::double as imp from f_all" for i, c in enumerate(TOP_INPUTS))}) u),
v_top as (select seq, list(printf('%s=%.2f', name, value) order by k) filter (k <= 5 and contribution > 0.01) as metrics from (
  select *, row_number() over (partition by seq order by contribution desc, i) as k from v_long) t group by seq)"""


def _suspicious(spark, sf) -> DataFrame:
    s = ft.rolling_burst(ft.deltas(_series(spark, sf)))
    return s.done().withColumn("suspicious_metrics", attack.top_metrics(TOP_INPUTS, IMPORTANCE))


@query("top_metrics_per_row", o.sql("select seq, coalesce(array_to_string(metrics, ';'), '') as metrics from v_top", *o.FEATURES_CTE, TOP_SQL))
def _(spark, sf):
    return _suspicious(spark, sf).select("seq", F.array_join("suspicious_metrics", ";").alias("metrics"))


@query("high_metrics_per_row", o.sql("select seq, coalesce(string_agg(printf('%s=%.2f', name, value), ';' order by i) filter (abs(value) > 10), '') as metrics from v_long group by seq", *o.FEATURES_CTE, TOP_SQL))
def _(spark, sf):
    s = ft.rolling_burst(ft.deltas(_series(spark, sf)))
    return s.done().select("seq", F.array_join(attack.top_metrics(TOP_INPUTS), ";").alias("metrics"))


def _models(spark, sf) -> DataFrame:
    """Three scorers over the same rows, one row per model and sample."""
    p = fx.process_view(spark, sf)
    hit = F.col("exe") == "error"
    scores = F.array(
        F.struct(F.lit("blend").alias("model"), ((F.col("mem") + F.when(hit, 20).otherwise(0)) / 120.0).alias("score")),
        F.struct(F.lit("cpu").alias("model"), F.least(F.col("cpu") / 500.0, F.lit(1.0)).alias("score")),
        F.struct(F.lit("mem").alias("model"), (F.col("mem") / 100.0).alias("score")))
    return (p.select("seq", hit.cast("int").alias("label"), F.inline(scores))
            .withColumn("pred", (F.col("score") >= 0.5).cast("int")))


def _results(spark, sf) -> DataFrame:
    return mt.evaluate(_models(spark, sf))


@query("rank_models", o.sql(f"select model, {_rs('roc_auc')}, cast(row_number() over (order by roc_auc desc, model) as int) as position from v_results", o.V_PROC, o.RESULTS))
def _(spark, sf):
    return mt.rank_models(_results(spark, sf)).select("model", *_r("roc_auc"), "position")


# ---- set operations and sampling ---------------------------------------------------------------
@query("union_sessions", o.sql("select seq, session_id, cpu, cast(null as double) as mem from v_proc where session_id <> 's1' union all select seq, session_id, cpu, mem from v_proc where session_id = 's1'", o.V_PROC))
def _(spark, sf):
    p = fx.process_view(spark, sf)
    bare, full = p.where(F.col("session_id") != "s1"), p.where(F.col("session_id") == "s1")
    return sp.union_sessions([bare.select("seq", "session_id", "cpu"), full.select("cpu", "mem", "seq", "session_id")])


MARKED_SQL = "v_mark as (select seq, case when exe = 'error' then 1 else 0 end as label from v_proc)"


def _draw_sql(seed: str) -> str:
    return f"md5(concat('{seed}:', cast(seq as varchar)))"


@query("balance_classes", o.sql(f"""
select seq, label from (select *, row_number() over (partition by label order by {_draw_sql('42')}, seq) as rk from v_mark) t
where rk <= (select min(n) from (select count(*) as n from v_mark group by label) c)""", o.V_PROC, MARKED_SQL))
def _(spark, sf):
    return sp.balance_classes(_marked(spark, sf).select("seq", "label"))


@query("sample_fraction", o.sql(f"select seq from v_proc where substr({_draw_sql('42')}, 1, 8) < '4ccccccc'", o.V_PROC))
def _(spark, sf):
    return sp.sample_fraction(fx.process_view(spark, sf).select("seq"), 0.3)


SPLIT_SQL = f"""v_cut as (select seq, label, case when rk <= floor(n * 0.25 + 0.5) then 'test' else 'train' end as split from (
  select *, count(*) over (partition by label) as n, row_number() over (partition by label order by {_draw_sql('42')}, seq) as rk from v_mark) t)"""


@query("stratified_split", o.sql("select seq, label, split from v_cut", o.V_PROC, MARKED_SQL, SPLIT_SQL))
def _(spark, sf):
    return sp.stratified_split(_marked(spark, sf).select("seq", "label"))


@query("validation_split", o.sql(f"""
select seq, label, case when rk <= floor(n * 0.2 + 0.5) then 'validation' else 'train' end as split from (
  select seq, label, count(*) over (partition by label) as n, row_number() over (partition by label order by {_draw_sql('42v')}, seq) as rk
  from v_cut where split = 'train') t""", o.V_PROC, MARKED_SQL, SPLIT_SQL))
def _(spark, sf):
    cut = sp.stratified_split(_marked(spark, sf).select("seq", "label"))
    return sp.validation_split(cut.where(F.col("split") == "train"))


@query("dedup_sessions", o.sql("select distinct session_id from v_proc", o.V_PROC))
def _(spark, sf):
    return sp.dedup_sessions(fx.process_view(spark, sf))


# ---- weighted rules ----------------------------------------------------------------------------
def _rule_input(spark, sf) -> DataFrame:
    """The prepared dataset, split into train and test."""
    return sp.stratified_split(_dataset(spark, sf))


def _ruled(spark, sf) -> DataFrame:
    rows = _rule_input(spark, sf)
    return rules.rule_score(rows, rules.fit_io_threshold(rows.where(F.col("split") == "train")))


@query("fit_io_threshold", o.sql(f"select {_rs('io_threshold')} from v_io", *o.RULE_CTE))
def _(spark, sf):
    rows = _rule_input(spark, sf)
    return rules.fit_io_threshold(rows.where(F.col("split") == "train")).select(*_r("io_threshold"))


@query("rule_score", o.sql("select seq, score from v_ruled", *o.RULE_CTE))
def _(spark, sf):
    return _ruled(spark, sf).select("seq", "score")


@query("rule_predict", o.sql("select seq, label, pred from v_ruled", *o.RULE_CTE))
def _(spark, sf):
    return _ruled(spark, sf).select("seq", "label", "pred")


@query("rule_probability", o.sql(f"select seq, {_rs('probability')}, {o.r('1 - probability')} as probability_normal from v_ruled", *o.RULE_CTE))
def _(spark, sf):
    return _ruled(spark, sf).select("seq", *_r("probability", "probability_normal"))


TRIGGER_SQL = ", ".join(f"count(*) filter ({c} > {'io_threshold' if lim is None else lim}) as {n}" for n, (_, c, lim) in list(rules.RULES.items())[:7])


@query("rule_trigger_stats", o.sql(f"select {TRIGGER_SQL}, {o.r('avg(score)')} as mean_score, max(score) as max_score from v_ruled where split = 'test'", *o.RULE_CTE))
def _(spark, sf):
    rows = _rule_input(spark, sf)
    limit = rules.fit_io_threshold(rows.where(F.col("split") == "train"))
    out = rules.rule_trigger_stats(rows.where(F.col("split") == "test"), limit)
    return out.select(*rules.REPORTED, *_r("mean_score"), "max_score")


@query("rule_confusion", o.sql("""
select count(*) filter (label = 1 and pred = 1) as tp, count(*) filter (label = 0 and pred = 0) as tn,
  count(*) filter (label = 0 and pred = 1) as fp, count(*) filter (label = 1 and pred = 0) as fn from v_ruled where split = 'test'""", *o.RULE_CTE))
def rule_confusion(spark, sf):
    """How well do the weighted rules find the labeled windows?"""
    return mt.confusion_matrix(_ruled(spark, sf).where(F.col("split") == "test"))


# ---- evaluation --------------------------------------------------------------------------------
def _scored(spark, sf) -> DataFrame:
    return fx.scored(fx.process_view(spark, sf))


SCORED_CTE = [o.V_PROC, o.V_SCORED]
CM_ONE = "v_cm as (select count(*) filter (label = 1 and pred = 1) as tp, count(*) filter (label = 0 and pred = 0) as tn, count(*) filter (label = 0 and pred = 1) as fp, count(*) filter (label = 1 and pred = 0) as fn from v_scored)"
RANK_ONE = o.RANKED.format(rows="(select 'm' as model, * from v_scored)")


@query("confusion_matrix", o.sql("select tp, tn, fp, fn from v_cm", *SCORED_CTE, CM_ONE))
def _(spark, sf):
    return mt.confusion_matrix(_scored(spark, sf))


REPORT_SQL = """
select 'normal' as class, round(pn, 6) as precision, round(rn, 6) as recall, round(fn1, 6) as f1, tn + fp as support from p
union all select 'anomaly', round(pp, 6), round(rp, 6), round(fp1, 6), tp + fn from p
union all select 'accuracy', round((tp + tn) / n, 6), round((tp + tn) / n, 6), round((tp + tn) / n, 6), n from p
union all select 'macro_avg', round((pn + pp) / 2, 6), round((rn + rp) / 2, 6), round((fn1 + fp1) / 2, 6), n from p
union all select 'weighted_avg', round((pn * (tn + fp) + pp * (tp + fn)) / n, 6), round((rn * (tn + fp) + rp * (tp + fn)) / n, 6),
  round((fn1 * (tn + fp) + fp1 * (tp + fn)) / n, 6), n from p"""


@query("classification_report", o.sql(REPORT_SQL, *SCORED_CTE, CM_ONE, """p as (select *, tp + tn + fp + fn as n, tn / (tn + fn)::double as pn, tn / (tn + fp)::double as rn,
  2.0 * tn / (2 * tn + fp + fn) as fn1, tp / (tp + fp)::double as pp, tp / (tp + fn)::double as rp, 2.0 * tp / (2 * tp + fp + fn) as fp1 from v_cm)"""))
def _(spark, sf):
    return mt.classification_report(mt.confusion_matrix(_scored(spark, sf))).select("class", *_r("precision", "recall", "f1"), "support")


@query("roc_auc", o.sql(f"select {o.r(o.AUC)} as roc_auc from v_rank", *SCORED_CTE, RANK_ONE))
def _(spark, sf):
    return mt.roc_auc(_scored(spark, sf)).select(*_r("roc_auc"))


@query("average_precision", o.sql(f"select {o.r(o.AP)} as avg_precision from v_rank", *SCORED_CTE, RANK_ONE))
def _(spark, sf):
    return mt.average_precision(_scored(spark, sf)).select(*_r("avg_precision"))


@query("f1_mcc", o.sql(f"select {o.r(o.F1)} as f1, {o.r(o.MCC)} as mcc from v_cm", *SCORED_CTE, CM_ONE))
def _(spark, sf):
    return mt.f1_mcc(mt.confusion_matrix(_scored(spark, sf))).select(*_r("f1", "mcc"))


@query("fpr_fnr", o.sql(f"select {o.r('fp / (fp + tn)::double')} as fpr, {o.r('fn / (fn + tp)::double')} as fnr from v_cm", *SCORED_CTE, CM_ONE))
def _(spark, sf):
    return mt.fpr_fnr(mt.confusion_matrix(_scored(spark, sf))).select(*_r("fpr", "fnr"))


@query("composite_score", o.sql(f"select model, {o.r('(roc_auc + avg_precision + f1 + (1 + mcc) / 2) / 4')} as composite_score from v_results", o.V_PROC, o.RESULTS))
def _(spark, sf):
    return _results(spark, sf).select("model", *_r("composite_score"))


@query("roc_points", o.sql(f"select {o.r('fp / all_neg')} as fpr, {o.r('tp / all_pos')} as tpr, {o.r('score')} as threshold from v_rank union all select 0, 0, null", *SCORED_CTE, RANK_ONE))
def _(spark, sf):
    return mt.roc_points(_scored(spark, sf)).select(*_r("fpr", "tpr", "threshold"))


@query("pr_points", o.sql(f"""select {o.r('tp / all_pos')} as recall, {o.r('tp / (tp + fp)')} as precision, {o.r('score')} as threshold, {o.r('all_pos / (all_pos + all_neg)')} as base_rate from v_rank
union all select 0, 1, null, {o.r('max(all_pos) / (max(all_pos) + max(all_neg))')} from v_rank""", *SCORED_CTE, RANK_ONE))
def _(spark, sf):
    return mt.pr_points(_scored(spark, sf)).select(*_r("recall", "precision", "threshold", "base_rate"))


@query("confusion_percent", o.sql(f"""
select label as actual, pred as predicted, count(*) as n, {o.r('count(*) * 100.0 / sum(count(*)) over (partition by label)')} as pct,
  {o.r('sum(sum(cast(label = pred as int))) over () / sum(count(*)) over ()')} as accuracy from v_scored group by 1, 2""", *SCORED_CTE))
def _(spark, sf):
    return mt.confusion_percent(_scored(spark, sf)).select("actual", "predicted", "n", *_r("pct", "accuracy"))


@query("metric_comparison", o.sql(f"""
select model, metric, {o.r('value')} as value, cast(rank() over (partition by metric order by value desc) as int) as position from (
  {" union all ".join(f"select model, '{m}' as metric, {m} as value from v_results" for m in mt.COMPARED)}) t""", o.V_PROC, o.RESULTS))
def _(spark, sf):
    return mt.metric_comparison(_results(spark, sf)).select("model", "metric", *_r("value"), "position")


@query("performance_table", o.sql("select model, " + ", ".join(mt.TABLE) + ", " + ", ".join(
    f"cast({c} = {'min' if c in mt.LOWER_IS_BETTER else 'max'}({c}) over () as int) as best_{c}" for c in mt.TABLE)
    + " from (select model, " + ", ".join(f"{o.r(c, 4)} as {c}" for c in mt.TABLE) + " from v_results) t", o.V_PROC, o.RESULTS))
def _(spark, sf):
    out = mt.performance_table(_results(spark, sf))
    return out.select("model", *[rounded(F.col(c), 4).alias(c) for c in mt.TABLE], *[f"best_{c}" for c in mt.TABLE])


@query("precision_recall", o.sql(f"select {o.r('tp / (tp + fp)::double')} as precision, {o.r('tp / (tp + fn)::double')} as recall from v_cm", *SCORED_CTE, CM_ONE))
def _(spark, sf):
    return mt.precision_recall(mt.confusion_matrix(_scored(spark, sf))).select(*_r("precision", "recall"))


@query("evaluate_models", o.sql(f"select model, {_rs(*mt.TABLE)}, tp, tn, fp, fn from v_results", o.V_PROC, o.RESULTS))
def _(spark, sf):
    return _results(spark, sf).select("model", *_r(*mt.TABLE), "tp", "tn", "fp", "fn")


# ---- attack types ------------------------------------------------------------------------------
_has = lambda *w: f"len(list_filter(metrics, lambda m: regexp_matches(lower(m), '{'|'.join(w)}'))) > 0"
CLASS_SQL = f"""v_attack as (
  select f.seq, f.num_connections, f.num_fds, case
    when {_has('child')} and num_children > 5 then 'Process Injection / Hollowing'
    when len(list_filter(metrics, lambda m: contains(lower(m), 'cpu') and regexp_matches(lower(m), 'spike|burst'))) > 0 and cpu > 70 then 'Cryptocurrency Mining'
    when num_threads > 100 or num_children > 20 then 'Fork Bomb / DoS'
    when {_has('io')} and {_has('connection', 'network')} then 'Data Exfiltration'
    when io_write_rate > 5000000 or ({_has('io')} and num_fds > 100) then 'Ransomware'
    when num_connections > 10 then 'Network Scanning / C2'
    when {_has('mem')} and mem > 60 then 'Memory Scraping'
    when num_fds > 200 then 'File Descriptor Leak' else 'Unknown Anomaly' end as attack_type
  from f_all f join (select seq, coalesce(metrics, []) as metrics from v_top) t using (seq))"""
DIM_SQL = "v_dim as (" + " union all ".join(
    f"select '{n}' as attack_type, {c}::double as confidence, '{d}' as description, {len(rec)} as steps" for n, c, d, rec in attack.ATTACKS) + ")"


@query("classify_attack", o.sql("select seq, attack_type from v_attack", *o.FEATURES_CTE, TOP_SQL, CLASS_SQL))
def _(spark, sf):
    return attack.classify_attack(_suspicious(spark, sf)).select("seq", "attack_type")


@query("attack_lookup", o.sql("select seq, attack_type, confidence, description, steps from v_attack join v_dim using (attack_type)", *o.FEATURES_CTE, TOP_SQL, CLASS_SQL, DIM_SQL))
def _(spark, sf):
    out = attack.attack_lookup(attack.classify_attack(_suspicious(spark, sf)))
    return out.select("seq", "attack_type", "confidence", "description", F.size("recommendations").alias("steps"))


# ---- whole datasets ----------------------------------------------------------------------------
@query("prepare_dataset", o.sql(f"select seq, label, {_rs(*ENGINEERED)} from f_all join v_label using (seq)", *o.LABEL_CTE, o.F_DELTA, o.F_EMA, o.F_ALL))
def _(spark, sf):
    out = prepare.prepare_dataset(fx.process_view(spark, sf), fx.event_log(spark, sf))
    return out.select("seq", "label", *_r(*ENGINEERED))


# ---- streaming ---------------------------------------------------------------------------------
LIVE_THRESHOLD = 0.4
LIVE_IO_LIMIT = 20000.0
LIVE_ROLLING = [f"{c}_{m}_{n}" for n in (5, 10) for c in ("cpu", "mem") for m in ("mean", "std")] + [
    "cpu_rate", "mem_rate", "cpu_spike", "mem_spike", "cpu_max_10", "cpu_min_10", "mem_max_10"]
LIVE_BASELINE = [*BASELINE, *DEVIATION]
_DETECTORS: dict[tuple, LiveDetector] = {}


def _snapshots(spark, sf) -> DataFrame:
    """What the live job's agent lands; written once, as every slice reads it."""
    return _once(spark, sf, "snapshots", lambda: fx.process_view(spark, sf).withColumn("child_entropy", F.col("mem") / 50))


def _detector(spark, sf) -> LiveDetector:
    """The live job, run once per application and input; each query below reads what it wrote."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _DETECTORS:
        p = _snapshots(spark, sf)
        detector = LiveDetector(rule_scorer(LIVE_IO_LIMIT), scratch_path(spark, "live"), TOP_INPUTS, IMPORTANCE,
                                threshold=LIVE_THRESHOLD, keep_history=True, state_partitions=spark.sparkContext.defaultParallelism)
        _DETECTORS[key] = live.replay(spark, p, live.time_slices(p, 2), detector, files=150)
    return _DETECTORS[key]


def _live(spark, sf) -> DataFrame:
    return _detector(spark, sf).feature_table(spark)


@query("stream_process_snapshots", STREAM_SQL)
def _(spark, sf):
    landing, out = scratch_path(spark, "snapshots"), scratch_path(spark, "copied")
    _stream_file_columns(fx.process_view(spark, sf)).write.option("header", True).option(
        "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").csv(landing)
    schema = T.StructType([T.StructField("seq", T.LongType())] + PROCESS_STREAM.fields)
    stream = logs.stream_process_snapshots(spark, landing, schema=schema)
    stream.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "cp")).trigger(
        availableNow=True).start(out).awaitTermination()
    return _dated(spark.read.parquet(out).select("seq", F.col("timestamp").alias("ts"), *STREAM_COLS))


@query("live_history", o.sql(f"select seq, cast(held as int) as held, cpu_hist[1] as oldest_cpu, {o.r('list_sum(cpu_hist)', 4)} as cpu_held from v_live", *o.LIVE_CTE))
def _(spark, sf):
    total = F.aggregate("cpu_hist", F.lit(0.0), lambda a, x: a + x)
    return _live(spark, sf).select("seq", "held", F.element_at("cpu_hist", 1).alias("oldest_cpu"), rounded(total, 4).alias("cpu_held"))


@query("live_deltas", o.sql("select seq, " + ", ".join(f"{o.r('l_' + n)} as {n}" for n in ft.DELTAS) + f", {_rs('io_total_rate', 'ctx_total_rate', 'ctx_involuntary_ratio')} from v_live", *o.LIVE_CTE))
def _(spark, sf):
    return _live(spark, sf).select("seq", *_r(*ft.DELTAS, "io_total_rate", "ctx_total_rate", "ctx_involuntary_ratio"))


@query("live_rolling", o.sql(f"select seq, {_rs(*LIVE_ROLLING)}, {o.r('cpu_mean_10')} as cpu_ema, {o.r('cpu_std_10')} as cpu_volatility from v_live", *o.LIVE_CTE))
def _(spark, sf):
    return _live(spark, sf).select("seq", *_r(*LIVE_ROLLING, "cpu_ema", "cpu_volatility"))


@query("live_trend", o.sql(f"select seq, {_rs('cpu_trend', 'mem_trend')} from v_live", *o.LIVE_CTE))
def _(spark, sf):
    return _live(spark, sf).select("seq", *_r("cpu_trend", "mem_trend"))


@query("live_baseline", o.sql(f"select seq, {_rs(*LIVE_BASELINE)} from v_live", *o.LIVE_CTE))
def _(spark, sf):
    return _live(spark, sf).select("seq", *_r(*LIVE_BASELINE))


@query("live_bursts", o.sql("select seq, cpu_burst, mem_burst, io_write_burst, cpu_burst as cpu_jump, mem_burst as mem_jump from v_live", *o.LIVE_CTE))
def _(spark, sf):
    return _live(spark, sf).select("seq", "cpu_burst", "mem_burst", "io_write_burst", "cpu_jump", "mem_jump")


@query("live_age", o.sql(f"select seq, {_rs('proc_age')} from v_live", *o.LIVE_CTE))
def _(spark, sf):
    return _live(spark, sf).select("seq", *_r("proc_age"))


@query("live_row_features", o.sql(f"""select seq, cast(num_children > 0 as int) as has_children, {o.r('cpu * mem')} as cpu_mem_product, {o.r('cpu + mem')} as resource_pressure,
  {o.r('cpu / (proc_age + 1)')} as cpu_per_age, {o.r('l_io_write_rate / (proc_age + 1)')} as io_per_age, {_rs('io_bytes_per_op')}, {o.r('mem / 50')} as child_entropy, 0.0::double as cpu_norm_parent, 0.0::double as cpu_max_20 from v_live""", *o.LIVE_CTE))
def _(spark, sf):
    return _live(spark, sf).select("seq", "has_children", *_r("cpu_mem_product", "resource_pressure", "cpu_per_age", "io_per_age", "io_bytes_per_op", "child_entropy"),
                                   "cpu_norm_parent", "cpu_max_20")


@query("threshold_alerts", o.sql("select seq, probability from v_alarm where probability >= 0.4", *o.LIVE_CTE))
def _(spark, sf):
    return threshold_alerts(_live(spark, sf), LIVE_THRESHOLD).select("seq", "probability")


@query("alert_once", o.sql("select session_id, pid, seq from v_first", *o.LIVE_CTE))
def _(spark, sf):
    return _detector(spark, sf).alert_table(spark).select("session_id", "pid", "seq")


ALERT_TOP = ("a_long as (select seq, name, value, i, imp * (abs(value) / (abs(value) + 1)) as contribution from ("
             + " union all ".join(f"select seq, '{c}' as name, cast({'l_' + c if c in ft.DELTAS else c} as double) as value, {i} as i, {IMPORTANCE[c]}::double as imp from v_first"
                                  for i, c in enumerate(TOP_INPUTS))
             + ") u), a_top as (select seq, list(printf('%s=%.2f', name, value) order by k) filter (k <= 5 and contribution > 0.01) as metrics from ("
               "select *, row_number() over (partition by seq order by contribution desc, i) as k from a_long) t group by seq)")


@query("alert_rows", o.sql("""select session_id, pid, ppid, exe, f.seq, probability as anomaly_score,
  case when probability > 0.9 then 'HIGH' when probability > 0.8 then 'MEDIUM' else 'LOW' end as confidence_band, array_to_string(metrics, ';') as metrics
from v_first f join a_top t on f.seq = t.seq""", *o.LIVE_CTE, ALERT_TOP))
def _(spark, sf):
    a = _detector(spark, sf).alert_table(spark)
    return a.select("session_id", "pid", "ppid", "exe", "seq", "anomaly_score", "confidence_band", F.array_join("suspicious_metrics", ";").alias("metrics"))


@query("sink_alerts", o.sql("select a.seq, a.attack_type as type, confidence from v_attack a join v_dim using (attack_type)", *o.LIVE_CTE, ALERT_TOP,
                            CLASS_SQL.replace("from f_all f", "from (select * replace (l_io_write_rate as io_write_rate) from v_first) f").replace("from v_top", "from a_top"), DIM_SQL))
def _(spark, sf):
    return _detector(spark, sf).alert_table(spark).select("seq", "attack.type", "attack.confidence")


@query("live_model_alerts")
def _(spark, sf):
    """Train on the prepared dataset, store, load, and detect on the stream with the stored model."""
    key = (spark.sparkContext.applicationId, sf, "model")
    if key not in _DETECTORS:
        path = sinks.save_model(_gbt(spark, sf), scratch_path(spark, "live-model"))
        p = _snapshots(spark, sf)
        detector = live.stored_model_detector(path, scratch_path(spark, "live-alerts"), threshold=LIVE_THRESHOLD,
                                              state_partitions=spark.sparkContext.defaultParallelism)
        _DETECTORS[key] = live.replay(spark, p, live.time_slices(p, 2), detector, files=150)
    told = _DETECTORS[key].alert_table(spark)
    return told.select("session_id", "pid", "seq", *_r("anomaly_score"), "confidence_band", F.array_join("suspicious_metrics", ";").alias("metrics"),
                       F.col("attack.type").alias("attack_type"))


@query("alert_totals", o.sql("select count(*) as alerted_processes from v_first", *o.LIVE_CTE))
def _(spark, sf):
    return alert_totals(_detector(spark, sf).alert_table(spark))


@query("trigger_cadence", o.sql("select seq, cpu from v_proc", o.V_PROC))
def _(spark, sf):
    landing, out = scratch_path(spark, "cadence"), scratch_path(spark, "polled")
    fx.process_view(spark, sf).select("seq", "timestamp", "cpu").write.parquet(landing)
    stream = logs.stream_process_snapshots(spark, landing, "parquet", schema=spark.read.parquet(landing).schema)
    job = (stream.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "cp"))
           .trigger(processingTime="1 second").start(out))
    job.processAllAvailable()
    job.stop()
    return spark.read.parquet(out).select("seq", "cpu")


# ---- machine learning --------------------------------------------------------------------------
# Every query fits its whole preset, the stored parameters or what is drawn from the whole space.
MODEL_COLUMNS = [c for c in MODEL_FEATURES if c != "status"]
_MODELS: dict[tuple, object] = {}


def _parts(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, validation and test rows of the prepared dataset."""
    cut = _once(spark, sf, "parts", lambda: sp.stratified_split(_dataset(spark, sf)))
    inner = _once(spark, sf, "inner", lambda: sp.validation_split(cut.where(F.col("split") == "train")))
    return (inner.where(F.col("split") == "train").drop("split"), inner.where(F.col("split") == "validation").drop("split"),
            cut.where(F.col("split") == "test").drop("split"))


def _fitted(spark, sf, name: str, fit: Callable[[], object]):
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _MODELS:
        _MODELS[key] = fit()
    return _MODELS[key]


def _gbt(spark, sf, preset: str = "primary"):
    return _fitted(spark, sf, preset, lambda: ml.fit_gbt(_parts(spark, sf)[0], MODEL_COLUMNS, preset))


def _gbt_scores(spark, sf, preset: str) -> DataFrame:
    return ml.score_rows(_parts(spark, sf)[2], _gbt(spark, sf, preset)).select("seq", "label", *_r("score"), "pred")


SCALED = ["cpu", "mem", "num_fds", "io_read_bytes", "label_const"]


@query("robust_scale", o.sql("select seq, " + ", ".join(
    f"{o.r(f'({c} - m_{c}) / case when s_{c} = 0 then 1 else s_{c} end')} as {c}" for c in SCALED[:4])
    + ", 0.0::double as label_const from v_proc join v_cut using (seq) cross join v_fit",
    o.V_PROC, MARKED_SQL, SPLIT_SQL, "v_fit as (select " + ", ".join(
        f"quantile_cont({c}, 0.5) as m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) as s_{c}" for c in SCALED[:4])
    + " from v_proc join v_cut using (seq) where split = 'train')"))
def _(spark, sf):
    p = fx.process_view(spark, sf).withColumns({"label": (F.col("exe") == "error").cast("int"), "label_const": F.lit(7.0)})
    cut = _once(spark, sf, "scaled", lambda: sp.stratified_split(p.select("seq", "label", *SCALED)))
    fitted = sca.fit_robust_scaler(cut.where(F.col("split") == "train"), SCALED)
    return sca.robust_scale(cut, fitted).select("seq", *_r(*SCALED))


@query("smote_neighbours", """
select a.vec_id as id, b.vec_id as neighbour, round(d, 5) as distance, cast(rank as int) as rank from (
  select x.vec_id as aid, y.vec_id as bid, list_distance(x.embedding::double[], y.embedding::double[]) as d,
         row_number() over (partition by x.vec_id order by list_distance(x.embedding::double[], y.embedding::double[]), y.vec_id) as rank
  from embeddings x join embeddings y on x.vec_id <> y.vec_id) t join embeddings a on a.vec_id = aid join embeddings b on b.vec_id = bid
where rank <= 5""")
def _(spark, sf):
    near = nb.nearest_neighbours(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding", 5)
    return near.select("id", "neighbour", rounded(F.col("distance"), 5).alias("distance"), "rank")


SMOTE_FEATURES = ["cpu", "mem", "num_connections"]
SMOTE_SQL = f"""
select seq, {o.r('cpu')} as cpu, {o.r('mem')} as mem, {o.r('num_connections')} as num_connections, label, 0 as synthetic from s_train
union all
select c.seq, {o.r('c.cpu + u * (n.cpu - c.cpu)')}, {o.r('c.mem + u * (n.mem - c.mem)')}, {o.r('c.num_connections + u * (n.num_connections - c.num_connections)')}, 1, 1
from (select *, cast(('0x' || substr(d, 1, 8)) as bigint) % 5 + 1 as pick, cast(('0x' || substr(d, 9, 8)) as bigint) / 4294967296.0::double as u from (
    select *, md5(concat('42n:', cast(seq as varchar), ':', cast(copy as varchar))) as d from (
      select *, unnest(range(1, cast(need // few + case when rk <= need % few then 1 else 0 end as bigint) + 1)) as copy from s_few) x) y) c
join s_near on s_near.seq = c.seq and rank = pick join s_few n on n.seq = s_near.other"""
SMOTE_CTE = ["s_train as (select seq, cpu, mem, cast(num_connections as double) as num_connections, label from v_proc join v_cut using (seq) where split = 'train')",
             f"""s_few as (select *, count(*) over () as few, (select count(*) from s_train where label = 0) - count(*) over () as need,
  row_number() over (order by {_draw_sql('42')}, seq) as rk from s_train where label = 1)""",
             """s_near as (select * from (select a.seq, b.seq as other, row_number() over (partition by a.seq order by
  pow(a.cpu - b.cpu, 2) + pow(a.mem - b.mem, 2) + pow(a.num_connections - b.num_connections, 2), b.seq) as rank
  from s_few a join s_few b on a.seq <> b.seq) t where rank <= 5)"""]


@query("smote_oversample", o.sql(SMOTE_SQL, o.V_PROC, MARKED_SQL, SPLIT_SQL, *SMOTE_CTE))
def _(spark, sf):
    p = fx.process_view(spark, sf).withColumn("label", (F.col("exe") == "error").cast("int"))
    train = sp.stratified_split(p.select("seq", *SMOTE_FEATURES, "label")).where(F.col("split") == "train")
    out = nb.smote_oversample(train, SMOTE_FEATURES)
    return out.select("seq", *_r(*SMOTE_FEATURES), "label", "synthetic")


@query("gbt_primary")
def _(spark, sf):
    return _gbt_scores(spark, sf, "primary")


@query("gbt_secondary")
def _(spark, sf):
    return _gbt_scores(spark, sf, "secondary")


@query("gbt_plain")
def _(spark, sf):
    return _gbt_scores(spark, sf, "plain")


@query("mlp")
def _(spark, sf):
    train, _, test = _parts(spark, sf)
    fitted = _fitted(spark, sf, "mlp", lambda: ml.fit_mlp(train, MODEL_COLUMNS))
    return ml.score_mlp(test.select("seq", "label", *MODEL_COLUMNS), fitted).select("seq", "label", *_r("score"), "pred")


@query("voting_soft")
def _(spark, sf):
    train, _, test = _parts(spark, sf)
    voters = _fitted(spark, sf, "voting", lambda: ml.fit_voting(train, MODEL_COLUMNS))
    return ml.voting_soft(test, voters).select("seq", "label", *_r("score_0", "score_1", "score_2", "score"), "pred")


@query("average_scores", o.sql(f"select seq, {o.r('(mem / 100.0 + least(cpu / 500.0, 1.0) + (num_fds / 300.0)) / 3')} as score from v_proc", o.V_PROC))
def _(spark, sf):
    p = fx.process_view(spark, sf).select("seq", (F.col("mem") / 100).alias("a"), F.least(F.col("cpu") / 500, F.lit(1.0)).alias("b"),
                                          (F.col("num_fds") / 300).alias("c"))
    return ml.average_scores(p, ["a", "b", "c"]).select("seq", *_r("score"))


@query("stacking")
def _(spark, sf):
    train, _, test = _parts(spark, sf)
    fitted = _fitted(spark, sf, "stacking", lambda: ml.fit_stacking(train, MODEL_COLUMNS))
    return ml.score_stacking(test, fitted).select("seq", "label", *_r("score"), "pred")


@query("train_tuned")
def _(spark, sf):
    train, validation, test = _parts(spark, sf)
    _, scored = _fitted(spark, sf, "tuned", lambda: training.train_tuned(train.unionByName(validation), test, MODEL_COLUMNS))
    return scored.select("model", "seq", "label", *_r("score"), "pred")


def _trials(spark, sf):
    train, validation, test = _parts(spark, sf)
    return _fitted(spark, sf, "tune", lambda: training.tune_and_refit(train, validation, test, MODEL_COLUMNS))


@query("tune")
def _(spark, sf):
    return _trials(spark, sf)[2].select("model", "seq", "label", *_r("score"), "pred")


@query("tuning_history")
def _(spark, sf):
    return ml.tuning_history(spark, _trials(spark, sf)[0]).select("trial", F.size("params").alias("parameters"), *_r("roc_auc", "gain"), "best")


@query("feature_importance")
def _(spark, sf):
    return ml.feature_importance(spark, _gbt(spark, sf)).select("feature", *_r("importance"))


@query("top_features")
def _(spark, sf):
    return ml.top_features(ml.feature_importance(spark, _gbt(spark, sf))).select("feature", *_r("importance"))


@query("score_rows")
def _(spark, sf):
    """Live rows lack some training features; those are 0."""
    return ml.score_rows(_parts(spark, sf)[2].drop("cpu_norm_parent", "mem_norm_parent"), _gbt(spark, sf)).select("seq", *_r("score"), "pred")


@query("model_store")
def _(spark, sf):
    path = sinks.save_model(_gbt(spark, sf), scratch_path(spark, "model"))
    return ml.score_rows(_parts(spark, sf)[2], sinks.load_model(path)).select("seq", "label", *_r("score"), "pred")


@query("select_best_model", o.sql(f"select model, {_rs('roc_auc')} from v_results order by v_results.roc_auc desc, model limit 1", o.V_PROC, o.RESULTS))
def _(spark, sf):
    return mt.select_best_model(_results(spark, sf)).select("model", *_r("roc_auc"))


@query("early_stop")
def _(spark, sf):
    train, validation, test = _parts(spark, sf)
    model, rounds = _fitted(spark, sf, "early", lambda: ml.early_stop(train, validation, MODEL_COLUMNS))
    return ml.score_rows(test, model).select("seq", "label", *_r("score"), "pred").withColumn("rounds", F.lit(rounds))


TRAIN_EXTRA = [*EXTREMA, "cpu_trend", "mem_trend", "cpu_acceleration", "cpu_volatility", "mem_volatility", "cpu_pct_rank", "mem_pct_rank",
               "resource_pressure", "cpu_jump", "mem_jump"]
EXTRA_SQL = ("select seq, " + ", ".join(f"{o.r(o.over(x.split('_')[1], int(x.split('_')[2]), x.split('_')[0]))} as {x}" for x in EXTREMA)
             + f", {_rs('cpu_trend', 'mem_trend')}, {o.r(f'coalesce(cpu_trend - lag(cpu_trend) over ({o.KEY}), 0)')} as cpu_acceleration, "
             + ", ".join(f"{o.r('coalesce(' + o.over('stddev_samp', 10, c) + ', 0)')} as {c}_volatility" for c in ("cpu", "mem"))
             + f", {_rank_sql('cpu')}, {_rank_sql('mem')}, {o.r('cpu + mem')} as resource_pressure, {_jump_sql('delta_cpu')} as cpu_jump, {_jump_sql('delta_mem')} as mem_jump, "
             + ", ".join(f"{o.r(f'{c} - avg({c}) over (partition by session_id, pid)', 8)} as {c}_dev_from_avg" for c in ("cpu", "mem")) + " from x_trend")
EXTRA_TREND = TREND_SQL.replace("v_trend", "x_trend").replace("from v_proc", "from f_delta")


@query("training_features", o.sql(EXTRA_SQL, o.V_PROC, o.F_DELTA, EXTRA_TREND))
def _(spark, sf):
    out = prepare.training_features(_dataset(spark, sf))
    flags = ("cpu_jump", "mem_jump")
    return out.select("seq", *_r(*[c for c in TRAIN_EXTRA if c not in flags]), *flags, *_r8("cpu_dev_from_avg", "mem_dev_from_avg"))


@query("training_flow")
def _(spark, sf):
    """Prepared dataset, training features, split, early-stopped fits, comparison, best model kept."""
    extra = [c for c in TRAIN_EXTRA if c not in MODEL_COLUMNS] + ["cpu_dev_from_avg", "mem_dev_from_avg"]
    table = training.train_and_keep(_dataset(spark, sf), scratch_path(spark, "kept"), MODEL_COLUMNS + extra)
    return table.select("model", *_r(*mt.TABLE), "tp", "tn", "fp", "fn", "trees", "kept")


@query("combine_sessions", o.sql(f"""
select seq, label from (select *, row_number() over (partition by label order by {_draw_sql('42')}, seq) as rk from v_mark) t
where rk <= (select min(n) from (select count(*) as n from v_mark group by label) c) and substr({_draw_sql('42s')}, 1, 8) < '80000000'""", o.V_PROC, MARKED_SQL))
def _(spark, sf):
    root = sinks.sink_labeled(_marked(spark, sf), scratch_path(spark, "to-combine"))
    return prepare.combine_sessions(logs.scan_sessions(spark, root), balance=True, fraction=0.5).select("seq", "label")
