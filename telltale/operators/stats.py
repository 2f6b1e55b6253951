"""Aggregates per process, per session and per class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telltale.operators.blocks import HALO, Series, process_series
from telltale.operators.quantiles import exact_quantiles

USAGE = ("cpu", "mem")


def _mergeable() -> dict[str, Column]:
    out = {}
    for c in USAGE:
        out |= {f"{c}_mean": F.avg(c), f"{c}_std": F.stddev_samp(c), f"{c}_max": F.max(c), f"{c}_min": F.min(c)}
    return out | {"num_children_mean": F.avg("num_children"), "num_children_max": F.max("num_children"),
                  "proc_age_max": F.max("proc_age"), "observation_count": F.count("timestamp")}


def process_stats(df: DataFrame, keys=("session_id", "pid")) -> DataFrame:
    """Per process: mean, deviation, extremes and median of cpu and mem, children, age, rows."""
    keys = list(keys)
    out = df.groupBy(*keys).agg(*[a.alias(n) for n, a in _mergeable().items()])
    for c in USAGE:
        out = out.join(exact_quantiles(df, keys, c, {f"{c}_median": 0.5}), keys, "left")
    return out


def process_stats_join(df: DataFrame, keys=("session_id", "pid")) -> DataFrame:
    """The same statistics on every row, with each row's distance from its process mean."""
    return add_process_stats(process_series(df, keys)).done()


def add_process_stats(s: Series) -> Series:
    """The same on a series that is laid out already, so its rows are not shuffled again."""
    s.whole(**_mergeable())
    together = Window.partitionBy(*s.part)
    s.cold = s.cold.withColumns({f"{c}_median": F.percentile(c, F.lit(0.5)).over(together) for c in USAGE})
    if s.hot is not None:
        for c in USAGE:
            s.join_hot(exact_quantiles(s.hot.where(~F.col(HALO)), s.keys, c, {f"{c}_median": 0.5}))
    return s.add(**_deviations())


def _deviations() -> dict[str, Column]:
    return {f"{c}_dev_from_avg": F.col(c) - F.col(f"{c}_mean") for c in USAGE}


def deviation_from_avg(df: DataFrame) -> DataFrame:
    return df.withColumns(_deviations())


def session_breakdown(df: DataFrame, session: str = "session_id") -> DataFrame:
    """Rows, anomalies and anomaly rate (4 decimals) per session."""
    return df.groupBy(session).agg(
        F.count("label").alias("total"), F.sum("label").cast("long").alias("anomalies"),
        F.round(F.avg("label"), 4).alias("anomaly_rate"))


def class_distribution(df: DataFrame) -> DataFrame:
    """Count and percentage per label, with the overall anomaly rate."""
    per = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("_all"), F.sum(F.col("n") * F.col("label")).alias("_hit"))
    return (per.join(F.broadcast(total))  # a one-row table
            .select("label", "n", (F.col("n") / F.col("_all") * 100).alias("pct"),
                    (F.col("_hit") / F.col("_all") * 100).alias("anomaly_rate")))


def class_weight(df: DataFrame) -> DataFrame:
    """Negatives over positives, the weight a positive row gets in training."""
    hits = F.sum(F.col("label").cast("long"))
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(hits, F.lit(0)).alias("positives")).select(
        (F.col("n") - F.col("positives")).alias("negatives"), "positives",
        ((F.col("n") - F.col("positives")) / F.greatest(F.col("positives"), F.lit(1))).alias("weight"))
