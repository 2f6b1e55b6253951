"""Per-process time-series features.

Every function takes a ``Series`` and adds columns. All of them share the series' partitioning
and order, so a whole feature set costs one exchange and one sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telltale.functions import scalars as sc
from telltale.operators.blocks import Series, process_series, split_hot
from telltale.session import materialized

# Which counter or gauge each first difference is taken of.
DELTAS = {
    "delta_cpu": "cpu", "delta_mem": "mem", "children_rate": "num_children",
    "io_read_rate": "io_read_bytes", "io_write_rate": "io_write_bytes",
    "io_read_ops_rate": "io_read_count", "io_write_ops_rate": "io_write_count",
    "connections_rate": "num_connections", "threads_rate": "num_threads", "fds_rate": "num_fds",
    "ctx_voluntary_rate": "ctx_switches_voluntary",
    "ctx_involuntary_rate": "ctx_switches_involuntary",
}
BURSTS = {"io_write_burst": "io_write_rate", "cpu_burst": "delta_cpu", "mem_burst": "delta_mem"}
USAGE = ("cpu", "mem")


def rolling_mean(s: Series, sizes=(5, 10), columns=USAGE) -> Series:
    return s.add(**{f"{c}_mean_{n}": F.avg(c).over(s.last(n)) for n in sizes for c in columns})


def rolling_std(s: Series, sizes=(5, 10), columns=USAGE) -> Series:
    """Sample deviation; a single row gives 0."""
    return s.add(**{f"{c}_std_{n}": F.coalesce(F.stddev_samp(c).over(s.last(n)), F.lit(0.0))
                    for n in sizes for c in columns})


def rolling_extrema(s: Series, sizes=(3, 10, 20)) -> Series:
    out = {}
    for n in sizes:
        out[f"cpu_max_{n}"] = F.max("cpu").over(s.last(n))
        out[f"cpu_min_{n}"] = F.min("cpu").over(s.last(n))
        out[f"mem_max_{n}"] = F.max("mem").over(s.last(n))
    return s.add(**out)


def deltas(s: Series, names=tuple(DELTAS)) -> Series:
    return s.add(**{n: F.coalesce(F.col(DELTAS[n]) - F.lag(DELTAS[n]).over(s.w), F.lit(0)).cast("double")
                    for n in names})


def above_rolling_q95(x: Column, w_before) -> Column:
    """Is ``x`` above the interpolated 95th percentile of a frame of up to 20 rows it ends?

    For 2 to 20 values that percentile lies between the two largest, so only a strict maximum
    exceeds it: comparing with the largest earlier value is the same test without any sorting.
    """
    return F.coalesce(x > F.max(x).over(w_before), F.lit(False)).cast("int")


def rolling_burst(s: Series, names=tuple(BURSTS)) -> Series:
    return s.add(**{n: above_rolling_q95(F.col(BURSTS[n]), s.before(19)) for n in names})


def ema_reach(span: int) -> int:
    """Rows after which a weight no longer changes a double, rounded up to a power of 4."""
    rows = 53 * math.log(2) / -math.log(1 - 2 / (span + 1))
    return 4 ** math.ceil(math.log(rows, 4))


def ema(s: Series, span: int = 10, columns=USAGE) -> Series:
    """Bias-adjusted exponential moving average.

    Weighted sums over 4, 16, 64 and 256 rows are built by adding three lagged copies of the
    previous sum, all on the series' own order: no recurrence, no extra sort, no large powers.
    """
    keep, reach = 1 - 2 / (span + 1), ema_reach(span)
    s.add(_n=F.least(s.index, F.lit(reach)), **{f"_e_{c}": F.col(c).cast("double") for c in columns})
    step = 1
    while step < reach:
        s.add(**{f"_e_{c}": sum((F.lit(keep ** (m * step)) * F.coalesce(F.lag(f"_e_{c}", m * step).over(s.w), F.lit(0.0))
                                 for m in (1, 2, 3)), F.col(f"_e_{c}")) for c in columns})
        step *= 4
    norm = F.lit(1 - keep) / (F.lit(1.0) - F.pow(F.lit(keep), F.col("_n")))
    s.add(**{f"{c}_ema": F.col(f"_e_{c}") * norm for c in columns})
    return s.drop("_n", *[f"_e_{c}" for c in columns])


def trend(s: Series, back: int = 5) -> Series:
    return s.add(**{f"{c}_trend": F.coalesce(F.col(c) - F.lag(c, back).over(s.w), F.lit(0.0)) for c in USAGE})


def acceleration(s: Series) -> Series:
    """First difference of ``cpu_trend``."""
    return s.add(cpu_acceleration=F.coalesce(F.col("cpu_trend") - F.lag("cpu_trend").over(s.w), F.lit(0.0)))


def volatility(s: Series) -> Series:
    return s.add(**{f"{c}_volatility": F.coalesce(F.stddev_samp(c).over(s.last(10)), F.lit(0.0)) for c in USAGE})


def process_baseline(s: Series) -> Series:
    """Mean of each process's first five samples."""
    return s.head_mean(5, cpu_baseline=F.col("cpu"), mem_baseline=F.col("mem"),
                       io_baseline=F.col("io_total_rate"))


def baselines(s: Series, n: int = 5) -> DataFrame:
    """One row per process: the same means, from its first rows alone."""
    if s.hot is not None and s.halo < n:  # the index is exact up to the halo length
        raise ValueError(f"the first {n} rows need a halo of {n}")
    first = s.add(_i=s.index).done().where(F.col("_i") <= n)
    return first.groupBy(*s.keys).agg(F.avg("cpu").alias("cpu_baseline"), F.avg("mem").alias("mem_baseline"),
                                      F.avg("io_total_rate").alias("io_baseline"))


def process_age(s: Series) -> Series:
    """Seconds since the process was first seen."""
    s.whole(_first=F.min(F.unix_micros("timestamp")))
    s.add(proc_age=(F.unix_micros("timestamp") - F.col("_first")) / 1e6)
    return s.drop("_first")


def fill_forward_back(s: Series, columns=USAGE) -> Series:
    """Last known value of the process, else its next known one, else 0."""
    s.last_known(**{f"_f_{c}": F.col(c) for c in columns})
    s.next_known(**{f"_b_{c}": F.col(c) for c in columns})
    s.add(**{c: F.coalesce(F.col(f"_f_{c}"), F.col(f"_b_{c}"), F.lit(0.0)) for c in columns})
    return s.drop(*[f"_{side}_{c}" for c in columns for side in "fb"])


def percentile_rank(df: DataFrame, keys=("session_id", "pid"), columns=USAGE) -> DataFrame:
    """Average-tie rank among a process's known values, divided by their number; null where the value is null."""
    keys = list(keys)
    cold, hot = split_hot(df, keys)
    group = Window.partitionBy(*keys)
    for c in columns:
        # equal values are the current row's peers, so ranks and ties share one sort
        by_value = group.orderBy(F.col(c).asc_nulls_last())
        ties = by_value.rangeBetween(Window.currentRow, Window.currentRow)
        rank = F.rank().over(by_value) + (F.count(F.lit(1)).over(ties) - 1) / 2
        cold = cold.withColumn(f"{c}_pct_rank", F.when(F.col(c).isNotNull(), rank / F.count(c).over(group)))
    if hot is None:
        return cold
    for c in columns:  # of large processes, values with their counts are ordered, not rows
        counts = materialized(hot.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count(F.lit(1)).alias("_t")), "value-counts")
        s = Series(counts, keys, (c,)).running(F.sum, _upto=F.col("_t")).whole(_all=F.sum("_t"))
        ranks = s.done().select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(c).alias("_v"),
                                ((F.col("_upto") - (F.col("_t") - 1) / 2) / F.col("_all")).alias(f"{c}_pct_rank"))
        met = F.col(c) == F.col("_v")
        for k in keys:
            met = met & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        hot = hot.join(ranks, met, "left").drop("_v", *[f"_k_{k}" for k in keys])
    return cold.unionByName(hot)


def base_features(s: Series) -> Series:
    """Steps shared by every prepared dataset, in dependency order."""
    deltas(s)
    rolling_mean(s)
    rolling_std(s)
    s.add(io_total_rate=sc.io_total_rate(), ctx_total_rate=sc.ctx_total_rate(), has_children=sc.has_children())
    s.add(io_bytes_per_op=sc.io_bytes_per_op(), ctx_involuntary_ratio=sc.ctx_involuntary_ratio(),
          **{f"{c}_rate": sc.relative_rate(c) for c in USAGE})
    rolling_burst(s)
    process_baseline(s)
    process_age(s)
    s.add(**sc.baseline_deviation(), **sc.usage_per_age())
    ema(s)
    return s.add(**{f"{c}_spike": sc.ema_spike(c) for c in USAGE})


def temporal_features(s: Series) -> Series:
    """Extra window features a training run adds to a prepared dataset."""
    rolling_extrema(s)
    trend(s)
    acceleration(s)
    volatility(s)
    return s.add(**sc.interactions())


def series_for_features(df: DataFrame, keys=("session_id", "pid"), **kw) -> Series:
    return process_series(df, keys, halo=ema_reach(10), **kw)
