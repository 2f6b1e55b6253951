"""Live features as expressions over a row and its history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telltale.functions import scalars as sc
from telltale.operators.features import DELTAS
from telltale.schemas import METRICS

# Counters whose live difference never goes below 0.
CLAMPED = ["io_read_rate", "io_write_rate", "io_read_ops_rate", "io_write_ops_rate",
           "ctx_voluntary_rate", "ctx_involuntary_rate"]
# Features of the training set that live rows never fill.
UNSEEN = ["cpu_norm_parent", "mem_norm_parent", "cpu_max_20", "cpu_acceleration", "cpu_pct_rank", "mem_pct_rank"]
USAGE = ("cpu", "mem")


def _when(held: int, value: Column) -> Column:
    return F.when(F.col("held") >= held, value).otherwise(F.lit(0.0))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def _mean(a: Column, n: int) -> Column:
    return _total(a) / n


def _deviation(a: Column, mean: Column, n: int) -> Column:
    """Population deviation."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)) / n)


def _recent(c: str, n: int) -> Column:
    """The newest ``n`` samples (all of a shorter buffer)."""
    hist = F.col(f"{c}_hist")
    return F.slice(hist, F.greatest(F.size(hist) - (n - 1), F.lit(1)), n)


def live_deltas(df: DataFrame) -> DataFrame:
    out = {}
    for name, source in DELTAS.items():
        change = F.col(source) - F.col(f"prev_{source}")
        out[name] = _when(2, F.greatest(change, F.lit(0.0)) if name in CLAMPED else change)
    df = df.withColumns(out).withColumns({"io_total_rate": sc.io_total_rate(), "ctx_total_rate": sc.ctx_total_rate()})
    return df.withColumn("ctx_involuntary_ratio", F.when(
        F.col("ctx_total_rate") > 0, sc.ratio(F.col("ctx_involuntary_rate"), F.col("ctx_total_rate"))).otherwise(F.lit(0.0)))


def live_rolling(df: DataFrame) -> DataFrame:
    for n in (5, 10):
        df = df.withColumns({f"{c}_mean_{n}": _when(n, _mean(_recent(c, n), n)) for c in USAGE})
        df = df.withColumns({f"{c}_std_{n}": _when(n, _deviation(_recent(c, n), F.col(f"{c}_mean_{n}"), n)) for c in USAGE})
    out = {}
    for c in USAGE:
        mean5 = F.col(f"{c}_mean_5")
        out[f"{c}_rate"] = _when(5, sc.relative_rate(c))
        out[f"{c}_spike"] = F.when(mean5 > 0, sc.ratio(F.col(c), mean5)).otherwise(F.lit(0.0))
        out[f"{c}_roll_std"] = F.col(f"{c}_std_5")
        out[f"{c}_ema"] = F.col(f"{c}_mean_10")
        out[f"{c}_volatility"] = F.col(f"{c}_std_10")
        out[f"{c}_max_10"] = _when(5, F.array_max(_recent(c, 5)))
    out["cpu_min_10"] = _when(5, F.array_min(_recent("cpu", 5)))
    return df.withColumns(out)


def live_trend(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{c}_trend": _when(5, F.col(c) - F.element_at(_recent(c, 5), 1)) for c in USAGE})


def live_baseline(df: DataFrame) -> DataFrame:
    """Mean of the five oldest samples still held; it slides once the buffer is full."""
    sources = {"cpu": "cpu", "mem": "mem", "io": "io_write_bytes"}
    df = df.withColumns({f"{n}_baseline": _when(5, _mean(F.slice(f"{n}_hist", 1, 5), 5)) for n in sources})
    df = df.withColumns({f"{n}_dev_from_baseline": _when(5, F.col(c) - F.col(f"{n}_baseline")) for n, c in sources.items()})
    return df.withColumns({f"{c}_pct_dev_baseline": F.when(
        F.col(f"{c}_baseline") > 0, sc.ratio(F.col(f"{c}_dev_from_baseline"), F.col(f"{c}_baseline"))).otherwise(F.lit(0.0))
        for c in USAGE})


def live_bursts(df: DataFrame) -> DataFrame:
    """Above the 95th percentile of the buffer, from ten samples on.

    For 10 to 20 samples it lies between the two largest, so a sample of the buffer itself exceeds
    it exactly when it is the strict maximum.
    """
    def tops(c):
        hist = F.col(f"{c}_hist")
        return (F.col(c) > F.array_max(F.slice(hist, 1, F.size(hist) - 1)))

    flag = lambda test: F.when(F.col("held") >= 10, test.cast("int")).otherwise(F.lit(0))
    ranked = F.array_sort("io_hist")
    n = F.col("held")
    low, high = F.try_element_at(ranked, n - 1), F.try_element_at(ranked, n)
    limit = low + (high - low) * (F.lit(0.95) * (n - 1) - (n - 2))
    return df.withColumns({"cpu_burst": flag(tops("cpu")), "mem_burst": flag(tops("mem")),
                           "cpu_jump": flag(tops("cpu")), "mem_jump": flag(tops("mem")),
                           "io_write_burst": flag(F.col("io_write_rate") > limit)})


def live_age(df: DataFrame) -> DataFrame:
    """Seconds of event time since the process was first seen."""
    return df.withColumn("proc_age", (F.unix_micros("timestamp") - F.col("first_us")) / 1e6)


def live_row_features(df: DataFrame) -> DataFrame:
    df = df.withColumns({"has_children": sc.has_children(), "io_bytes_per_op": sc.io_bytes_per_op(),
                         **sc.interactions(), **sc.usage_per_age("io_write_rate")})
    return df.withColumns({c: F.lit(0.0) for c in UNSEEN + [m for m in METRICS if m not in df.columns]})


def live_features(history: DataFrame, keep_history: bool = False) -> DataFrame:
    """All live features; works on a stream and on a table alike."""
    df = live_age(live_bursts(live_baseline(live_trend(live_rolling(live_deltas(history))))))
    df = live_row_features(df)
    drop = [c for c in df.columns if c.startswith("prev_") or (c.endswith("_hist") and not keep_history)]
    return sc.clean(df.drop(*drop, "first_us"))
