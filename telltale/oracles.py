"""SQL building blocks that state the same results for an independent engine."""

from __future__ import annotations

V_PROC = """v_proc as (
  select seq, ts, session_id, pid, ppid, cpu, cast(k as double) as mem, exe,
         k % 7 as num_children, k % 15 as num_connections, k as num_threads, k * 3 as num_fds,
         cast(sum(cast(round(cpu * 100) as bigint)) over w as bigint) as io_write_bytes,
         cast(sum(k * 10) over w as bigint) as io_read_bytes,
         cast(row_number() over w as bigint) as io_write_count,
         cast(sum(k % 4) over w as bigint) as io_read_count,
         cast(sum(k % 11) over w as bigint) as ctx_switches_voluntary,
         cast(sum(k % 5) over w as bigint) as ctx_switches_involuntary,
         case when k % 2 = 0 then 'running' else 'sleeping' end as status
  from (select event_id as seq, ts,
               concat('s', cast(cast(floor((extract(day from ts) - 1) / 10) as int) as varchar)) as session_id,
               user_id as pid,
               case when user_id = 0 then null else cast(floor(user_id / 4) as bigint) end as ppid,
               value as cpu, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k, event_type as exe
        from events) b
  window w as (partition by session_id, pid order by ts, seq))"""

V_EVLOG = """v_evlog as (
  select event_id as seq, ts,
         concat('s', cast(cast(floor((extract(day from ts) - 1) / 10) as int) as varchar)) as session_id,
         case event_type when 'error' then 'anomaly_start' when 'signup' then 'anomaly_end' else 'normal_start' end as event_type,
         concat('cpu,pid=', cast(user_id as varchar), ',duration=20') as details
  from events)"""

V_SNAPSHOT = """v_snapshot as (
  select snap_ts, pid, ppid, exe from (
    select date_trunc('day', ts) as snap_ts, pid, ppid, exe,
           row_number() over (partition by date_trunc('day', ts), pid order by ts desc, seq desc) as rn
    from v_proc) t where rn = 1)"""

V_SCORED = """v_scored as (
  select seq, label, score, case when score >= 0.5 then 1 else 0 end as pred from (
    select seq, case when exe = 'error' then 1 else 0 end as label,
           (mem + case when exe = 'error' then 20 else 0 end) / 120.0 as score from v_proc) b)"""

V_MODELS = """v_models as (
  select model, seq, label, score, case when score >= 0.5 then 1 else 0 end as pred from (
    select 'blend' as model, seq, case when exe = 'error' then 1 else 0 end as label,
           (mem + case when exe = 'error' then 20 else 0 end) / 120.0 as score from v_proc
    union all select 'cpu', seq, case when exe = 'error' then 1 else 0 end, least(cpu / 500.0, 1.0) from v_proc
    union all select 'mem', seq, case when exe = 'error' then 1 else 0 end, mem / 100.0 from v_proc) m)"""

KEPT = """kept as (
  select session_id, seq, ts, case when contains(lower(event_type), 'start') then 'start' else 'end' end as kind
  from v_evlog where contains(lower(event_type), 'anomaly')
    and (contains(lower(event_type), 'start') or contains(lower(event_type), 'end')))"""

PERIODS = KEPT + """,
periods as (
  select session_id, ts as start_ts, coalesce(nxt, stream_end) as end_ts from (
    select k.*, lead(ts) over (partition by session_id order by seq) as nxt,
           (select max(ts) from v_proc p where p.session_id = k.session_id) as stream_end from kept k) t
  where kind = 'start')"""

KEY = "partition by session_id, pid order by ts, seq"


def r(expr: str, digits: int = 6) -> str:
    """Rounded, and never minus zero."""
    return f"round(cast({expr} as double), {digits}) + 0.0"


def d(column: str) -> str:
    return f"cast(coalesce({column} - lag({column}) over (partition by session_id, pid order by ts, seq), 0) as double)"


DELTA_SOURCES = {
    "delta_cpu": "cpu", "delta_mem": "mem", "children_rate": "num_children",
    "io_read_rate": "io_read_bytes", "io_write_rate": "io_write_bytes",
    "io_read_ops_rate": "io_read_count", "io_write_ops_rate": "io_write_count",
    "connections_rate": "num_connections", "threads_rate": "num_threads", "fds_rate": "num_fds",
    "ctx_voluntary_rate": "ctx_switches_voluntary", "ctx_involuntary_rate": "ctx_switches_involuntary"}

F_DELTA = "f_delta as (select *, " + ", ".join(f"{d(c)} as {n}" for n, c in DELTA_SOURCES.items()) + f""",
  row_number() over ({KEY}) as rn from v_proc)"""

F_EMA = """f_ema as (
  select a.seq, sum(b.cpu * pow(9.0 / 11.0, a.rn - b.rn)) / sum(pow(9.0 / 11.0, a.rn - b.rn)) as cpu_ema,
         sum(b.mem * pow(9.0 / 11.0, a.rn - b.rn)) / sum(pow(9.0 / 11.0, a.rn - b.rn)) as mem_ema
  from f_delta a join f_delta b on a.session_id = b.session_id and a.pid = b.pid and b.rn <= a.rn group by a.seq)"""


def q95(column: str, order: str = "partition by session_id, pid order by ts, seq") -> str:
    return f"quantile_cont({column}, 0.95) over ({order} rows between 19 preceding and current row)"


def over(fn: str, n: int, column: str) -> str:
    return f"{fn}({column}) over ({KEY} rows between {n - 1} preceding and current row)"


F_ALL = f"""f_roll as (
  select *, io_read_rate + io_write_rate as io_total_rate, ctx_voluntary_rate + ctx_involuntary_rate as ctx_total_rate,
         {", ".join(f"{over('avg', n, c)} as {c}_mean_{n}, coalesce({over('stddev_samp', n, c)}, 0) as {c}_std_{n}" for n in (5, 10) for c in ("cpu", "mem"))},
         cast(io_write_rate > {q95('io_write_rate')} as int) as io_write_burst,
         cast(delta_cpu > {q95('delta_cpu')} as int) as cpu_burst, cast(delta_mem > {q95('delta_mem')} as int) as mem_burst,
         (epoch_us(ts) - epoch_us(min(ts) over (partition by session_id, pid))) / 1e6 as proc_age
  from f_delta),
f_base as (
  select session_id, pid, avg(cpu) filter (rn <= 5) as cpu_baseline, avg(mem) filter (rn <= 5) as mem_baseline,
         avg(io_total_rate) filter (rn <= 5) as io_baseline, arg_max(cpu, (ts, seq)) as last_cpu, arg_max(mem, (ts, seq)) as last_mem
  from f_roll group by all),
f_all as (
  select f.*, b.cpu_baseline, b.mem_baseline, b.io_baseline, e.cpu_ema, e.mem_ema,
         f.cpu / (e.cpu_ema + 1e-5) as cpu_spike, f.mem / (e.mem_ema + 1e-5) as mem_spike,
         (f.cpu - cpu_mean_5) / (cpu_std_5 + 1e-5) as cpu_rate, (f.mem - mem_mean_5) / (mem_std_5 + 1e-5) as mem_rate,
         cast(num_children > 0 as int) as has_children,
         coalesce((io_total_rate + 1) / nullif(io_read_ops_rate + io_write_ops_rate + 1, 0), 0) as io_bytes_per_op,
         coalesce(ctx_involuntary_rate / nullif(ctx_total_rate + 1, 0), 0) as ctx_involuntary_ratio,
         f.cpu - b.cpu_baseline as cpu_dev_from_baseline, f.mem - b.mem_baseline as mem_dev_from_baseline,
         io_total_rate - b.io_baseline as io_dev_from_baseline,
         (f.cpu - b.cpu_baseline) / (b.cpu_baseline + 1e-5) as cpu_pct_dev_baseline,
         (f.mem - b.mem_baseline) / (b.mem_baseline + 1e-5) as mem_pct_dev_baseline,
         f.cpu / (proc_age + 1) as cpu_per_age, f.mem / (proc_age + 1) as mem_per_age, io_total_rate / (proc_age + 1) as io_per_age,
         coalesce(f.cpu / nullif(q.last_cpu, 0), 0) as cpu_norm_parent, coalesce(f.mem / nullif(q.last_mem, 0), 0) as mem_norm_parent
  from f_roll f join f_base b on f.session_id = b.session_id and f.pid = b.pid join f_ema e on f.seq = e.seq
  left join f_base q on f.session_id = q.session_id and f.ppid = q.pid)"""

LABELED = """v_label as (
  select p.seq, cast(exists (select 1 from periods q where q.session_id = p.session_id
    and p.ts between q.start_ts - interval 2 second and q.end_ts + interval 2 second) as int) as label from v_proc p)"""

# Exact-count split: the lowest md5 draws of each class form the test part.
SPLIT = """v_split as (
  select seq, label, case when rk <= floor(n * 0.25 + 0.5) then 'test' else 'train' end as split from (
    select seq, label, count(*) over (partition by label) as n,
           row_number() over (partition by label order by md5(concat('42:', cast(seq as varchar))), seq) as rk from v_label) t)"""

RULE_SCORE = """case when cpu > 80 then 1.0 else 0.0 end + case when mem > 70 then 1.0 else 0.0 end
  + case when io_write_rate > io_threshold then 1.5 else 0.0 end + case when children_rate > 3 then 2.0 else 0.0 end
  + case when num_connections > 10 then 1.5 else 0.0 end + case when num_threads > 50 then 1.0 else 0.0 end
  + case when num_fds > 100 then 1.5 else 0.0 end + case when cpu_spike > 3 then 2.0 else 0.0 end
  + case when mem_spike > 3 then 1.5 else 0.0 end + case when cpu_burst > 0 then 1.5 else 0.0 end
  + case when mem_burst > 0 then 1.5 else 0.0 end"""

RULED = f"""v_io as (select quantile_cont(io_write_rate, 0.95) as io_threshold from f_all join v_split using (seq) where split = 'train'),
v_ruled as (
  select *, cast(score > 3.0 as int) as pred, least(greatest(score / 16.0, 0.0), 1.0) as probability from (
    select f.*, s.label, s.split, io_threshold, cast({RULE_SCORE} as double) as score
    from f_all f join v_split s using (seq) cross join v_io) t)"""

RANKED = """v_rank as (
  select *, sum(pos) over (partition by model order by score desc) as tp, sum(neg) over (partition by model order by score desc) as fp,
         sum(pos) over (partition by model) as all_pos, sum(neg) over (partition by model) as all_neg
  from (select model, score, count(*) filter (label = 1) as pos, count(*) filter (label <> 1) as neg from {rows} group by model, score) t)"""

CM = """v_cm as (
  select model, count(*) filter (label = 1 and pred = 1) as tp, count(*) filter (label = 0 and pred = 0) as tn,
         count(*) filter (label = 0 and pred = 1) as fp, count(*) filter (label = 1 and pred = 0) as fn from {rows} group by model)"""

AUC = "sum(neg * (tp - pos / 2.0)) / (max(all_pos)::double * max(all_neg))"
AP = "sum(pos * (tp / (tp + fp)::double)) / max(all_pos)"
F1 = "2.0 * tp / (2 * tp + fp + fn)"
MCC = ("(tp::double * tn - fp::double * fn) / "
       "sqrt((tp + fp)::double * (tp + fn)::double * (tn + fp)::double * (tn + fn)::double)")

RESULTS = V_MODELS + ", " + RANKED.format(rows="v_models") + ", " + CM.format(rows="v_models") + f""",
v_results as (
  select model, roc_auc, avg_precision, {F1} as f1, {MCC} as mcc, fp / (fp + tn)::double as fpr, fn / (fn + tp)::double as fnr, tp, tn, fp, fn
  from v_cm join (select model, {AUC} as roc_auc, {AP} as avg_precision from v_rank group by model) a using (model))"""

def _least(n: int, expr: str) -> str:
    return f"case when rn >= {n} then {expr} else 0 end"


_LIVE_DELTA = ", ".join(
    (f"greatest({n}, 0)::double as l_{n}" if n.startswith(("io_", "ctx_")) else f"{n} as l_{n}") for n in DELTA_SOURCES)
_LIVE_ROLL = ", ".join(
    f"{_least(n, over('avg', n, c))} as {c}_mean_{n}, {_least(n, over('stddev_pop', n, c))} as {c}_std_{n}" for n in (5, 10) for c in ("cpu", "mem"))
_HIST = ", ".join(f"list({c}) over ({KEY} rows between 19 preceding and current row) as {h}"
                  for h, c in (("cpu_hist", "cpu"), ("mem_hist", "mem"), ("io_hist", "io_write_bytes")))

LIVE = f"""l_hist as (select *, least(rn, 20) as held, {_HIST}, {_LIVE_DELTA}, {_LIVE_ROLL},
  {_least(5, over('max', 5, 'cpu'))} as cpu_max_10, {_least(5, over('min', 5, 'cpu'))} as cpu_min_10, {_least(5, over('max', 5, 'mem'))} as mem_max_10,
  {_least(5, f"cpu - lag(cpu, 4) over ({KEY})")} as cpu_trend, {_least(5, f"mem - lag(mem, 4) over ({KEY})")} as mem_trend,
  case when rn >= 10 and cpu > {q95('cpu')} then 1 else 0 end as cpu_burst, case when rn >= 10 and mem > {q95('mem')} then 1 else 0 end as mem_burst,
  {q95('io_write_bytes')} as io_q95,
  (epoch_us(ts) - epoch_us(min(ts) over (partition by session_id, pid))) / 1e6 as proc_age from f_delta),
l_base as (select *, {_least(5, "list_avg(cpu_hist[1:5])")} as cpu_baseline, {_least(5, "list_avg(mem_hist[1:5])")} as mem_baseline,
  {_least(5, "list_avg(io_hist[1:5])")} as io_baseline, l_io_read_rate + l_io_write_rate as io_total_rate,
  l_ctx_voluntary_rate + l_ctx_involuntary_rate as ctx_total_rate from l_hist),
v_live as (select *, coalesce(cpu / nullif(cpu_mean_5, 0), 0) as cpu_spike, coalesce(mem / nullif(mem_mean_5, 0), 0) as mem_spike,
  {_least(5, "(cpu - cpu_mean_5) / (cpu_std_5 + 1e-5)")} as cpu_rate, {_least(5, "(mem - mem_mean_5) / (mem_std_5 + 1e-5)")} as mem_rate,
  case when rn >= 10 and l_io_write_rate > io_q95 then 1 else 0 end as io_write_burst,
  {_least(5, "cpu - cpu_baseline")} as cpu_dev_from_baseline, {_least(5, "mem - mem_baseline")} as mem_dev_from_baseline,
  {_least(5, "io_write_bytes - io_baseline")} as io_dev_from_baseline,
  coalesce((cpu - cpu_baseline) / nullif(cpu_baseline, 0), 0) as cpu_pct_dev_baseline, coalesce((mem - mem_baseline) / nullif(mem_baseline, 0), 0) as mem_pct_dev_baseline,
  (io_total_rate + 1) / (l_io_read_ops_rate + l_io_write_ops_rate + 1) as io_bytes_per_op,
  coalesce(l_ctx_involuntary_rate / nullif(ctx_total_rate, 0), 0) as ctx_involuntary_ratio from l_base),
v_alarm as (select *, score / 16.0 as probability from (
  select *, cast({RULE_SCORE} as double) as score from (
    select * replace (l_io_write_rate as io_write_rate, l_children_rate as children_rate), 20000.0 as io_threshold from v_live) x) y),
v_first as (select * from (select *, row_number() over (partition by session_id, pid order by ts, seq) as nth from v_alarm where probability >= 0.4) t where nth = 1)"""

LIVE_CTE = [V_PROC, F_DELTA, LIVE]
FEATURES_CTE = [V_PROC, F_DELTA, F_EMA, F_ALL]
LABEL_CTE = [V_PROC, V_EVLOG, PERIODS, LABELED]
RULE_CTE = [V_PROC, V_EVLOG, PERIODS, LABELED, SPLIT, F_DELTA, F_EMA, F_ALL, RULED]


def sql(body: str, *ctes: str) -> str:
    return ("with " + ",\n".join(ctes) + "\n" if ctes else "") + body
