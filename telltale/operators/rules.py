"""Weighted-rule detector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telltale.functions.scalars import coerce_metrics, finite
from telltale.operators.quantiles import exact_quantiles

# Weight of each rule and the column and limit it tests (strictly above).
# The limit of ``high_io`` is fitted, so it is left open here.
RULES = {
    "high_cpu": (1.0, "cpu", 80.0),
    "high_mem": (1.0, "mem", 70.0),
    "high_io": (1.5, "io_write_rate", None),
    "rapid_spawning": (2.0, "children_rate", 3),
    "high_connections": (1.5, "num_connections", 10),
    "high_threads": (1.0, "num_threads", 50),
    "high_fds": (1.5, "num_fds", 100),
    "cpu_spike": (2.0, "cpu_spike", 3.0),
    "mem_spike": (1.5, "mem_spike", 3.0),
    "cpu_burst": (1.5, "cpu_burst", 0),
    "mem_burst": (1.5, "mem_burst", 0),
}
SCORE_LIMIT = 3.0
IO_QUANTILE = 0.95
REPORTED = list(RULES)[:7]
INPUTS = [column for _, column, _ in RULES.values()]
TOTAL_WEIGHT = sum(weight for weight, _, _ in RULES.values())


def fit_io_threshold(train: DataFrame) -> DataFrame:
    """One row: the 95th percentile of the training rows' write rate."""
    rate = train.select(finite(F.col("io_write_rate").cast("double")).alias("io_write_rate"))
    return exact_quantiles(rate, [], "io_write_rate", {"io_threshold": IO_QUANTILE})


def rule_hits(io_limit: Column) -> dict[str, Column]:
    return {name: F.col(column) > (io_limit if limit is None else F.lit(limit))
            for name, (_, column, limit) in RULES.items()}


def score_expression(io_limit: Column) -> Column:
    hits = rule_hits(io_limit)
    return sum((F.when(hits[n], F.lit(RULES[n][0])).otherwise(F.lit(0.0)) for n in RULES), F.lit(0.0))


def rule_score(df: DataFrame, threshold: DataFrame) -> DataFrame:
    """Add ``score``, ``pred`` (score above 3) and ``probability`` (score over the total weight).

    ``threshold`` is the single row of ``fit_io_threshold``.
    """
    missing = [c for c in INPUTS if c not in df.columns]
    ready = coerce_metrics(df, missing) if missing else df
    joined = ready.join(F.broadcast(threshold.select(F.col("io_threshold").alias("_io"))))  # one row
    return predictions(joined.withColumn("score", score_expression(F.coalesce("_io", F.lit(0.0)))).drop("_io"))


def predictions(df: DataFrame) -> DataFrame:
    share = F.col("score") / TOTAL_WEIGHT
    proba = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    return df.withColumns({"pred": (F.col("score") > SCORE_LIMIT).cast("int"), "probability": proba,
                           "probability_normal": F.lit(1.0) - proba})


def rule_trigger_stats(df: DataFrame, threshold: DataFrame) -> DataFrame:
    """Rows that trip each of the reported rules, with the mean and highest score: one pass."""
    joined = df.join(F.broadcast(threshold.select(F.col("io_threshold").alias("_io"))))  # one row
    hits = rule_hits(F.col("_io"))
    return joined.withColumn("_s", score_expression(F.col("_io"))).agg(
        *[F.count_if(hits[n]).alias(n) for n in REPORTED],
        F.avg("_s").alias("mean_score"), F.max("_s").alias("max_score"))
