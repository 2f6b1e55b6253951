"""Exact interpolated quantiles of groups of any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telltale.operators.blocks import Series, split_hot
from telltale.session import materialized, rows_per_block


def exact_quantiles(df: DataFrame, keys, column: str, quantiles: dict[str, float], limit: int | None = None) -> DataFrame:
    """One row per group with linearly interpolated quantiles of ``column``.

    The builtin ``percentile`` keeps every distinct value of a group in one buffer. Groups above
    the block limit, and only those, are counted per value instead and walked in blocks of values.
    """
    keys = list(keys)
    limit = limit or rows_per_block(df.sparkSession)
    narrow = df.select(*keys, F.col(column).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    group = keys or ["_all"]
    cold, hot = split_hot(narrow if keys else narrow.withColumn("_all", F.lit(0)), group, limit)
    exact = [F.percentile("_x", F.lit(q)).alias(n) for n, q in quantiles.items()]
    if hot is None:
        return narrow.groupBy(*keys).agg(*exact)
    counts = materialized(hot.groupBy(*group, "_x").agg(F.count(F.lit(1)).alias("_c")), "value-counts")
    s = Series(counts, group, ("_x",), limit=limit).running(F.sum, _upto=F.col("_c")).whole(_n=F.sum("_c"))
    aggs = []
    for name, q in quantiles.items():
        spot = F.lit(q) * (F.col("_n") - 1)
        for side, at in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            aggs.append(F.min(F.when(F.col("_upto") > at, F.col("_x"))).alias(f"_{side}_{name}"))
    found = s.done().groupBy(*group).agg(F.max("_n").alias("_n"), *aggs)
    part = lambda q: F.lit(q) * (F.col("_n") - 1) - F.floor(F.lit(q) * (F.col("_n") - 1))
    large = found.select(*keys, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * part(q)).alias(n) for n, q in quantiles.items()])
    return large.unionByName(cold.groupBy(*keys).agg(*exact)) if keys else large


def quantile_value(df: DataFrame, column: str, q: float) -> float | None:
    """A single quantile of the whole table, as a number for a later plan."""
    row = exact_quantiles(df, [], column, {"q": q}).first()
    return None if row is None or row.q is None or math.isnan(row.q) else float(row.q)
