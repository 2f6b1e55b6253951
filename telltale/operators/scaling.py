"""Robust scaling fitted on training rows."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telltale.session import materialized

# Ship the task functions to workers that do not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
BITS = 16  # of a value's 64 that a round looks at


def _ordered(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order (NaN last, -0 as 0)."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _value(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def order_statistics(df: DataFrame, columns: list[str], ranks) -> dict[tuple[str, int], float]:
    """Exact values at 0-based ranks of many columns at once; ``ranks(column, n)`` says which of n values.

    A round is one pass that counts, for all columns together, the values' next 16 bits below the prefixes still
    looked into. Tasks hand on counts only. Values are known once a prefix holds a single one: after
    two rounds for most numbers, four at most, however they are spread.
    """
    frame = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    wanted: list[tuple[int, int, int, int]] = []  # column, prefix, rank below it, rank asked for
    found: dict[tuple[str, int], float] = {}
    for shift in range(64 - BITS, -1, -BITS):
        counts = _counts(frame, len(columns), None if shift == 64 - BITS else {(c, p) for c, p, _, _ in wanted}, shift)
        if shift == 64 - BITS:
            sizes = counts.groupBy("column").agg(F.sum("n").alias("n")).collect()  # one row a column
            wanted = [(x["column"], 0, r, r) for x in sizes for r in ranks(columns[x["column"]], x["n"])]
        if not wanted:
            break
        asked = df.sparkSession.createDataFrame([(c, str(p), r, of) for c, p, r, of in wanted], "_c int, _p string, _r long, _of long")
        before = F.sum("n").over(Window.partitionBy("column", "prefix").orderBy("digits")) - F.col("n")  # 65,536 rows at most
        hits = (counts.withColumn("_before", before)
                .join(F.broadcast(asked), (F.col("column") == F.col("_c")) & (F.col("prefix") == F.col("_p"))  # a few ranks a column
                      & (F.col("_r") >= F.col("_before")) & (F.col("_r") < F.col("_before") + F.col("n"))).collect())
        wanted = []
        for x in hits:
            if x["low"] == x["high"]:
                found[columns[x["column"]], x["_of"]] = _value(int(x["low"]))
            else:
                wanted.append((x["column"], int(x["prefix"]) << BITS | x["digits"], x["_r"] - x["_before"], x["_of"]))
    return found


def _counts(frame: DataFrame, width: int, prefixes: set[tuple[int, int]] | None, shift: int) -> DataFrame:
    """(column, prefix, digits, n, low, high); keys are written with 20 digits, so that their order is that of the numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int, int], list[int]] = {}
        for batch in batches:
            for c in range(width):
                keys = np.sort(_ordered(batch.column(c).drop_null().to_numpy(zero_copy_only=False)))
                for prefix in [0] if prefixes is None else [p for own, p in prefixes if own == c]:
                    if prefixes is not None:
                        low, high = prefix << (shift + BITS), ((prefix + 1) << (shift + BITS)) - 1
                        part = keys[np.searchsorted(keys, np.uint64(low)):np.searchsorted(keys, np.uint64(high), "right")]
                    else:
                        part = keys
                    if not len(part):
                        continue
                    digits = (part >> np.uint64(shift)) & np.uint64((1 << BITS) - 1)
                    edge = np.flatnonzero(np.r_[True, digits[1:] != digits[:-1], True])  # keys are in order, so their digits are
                    first, last = edge[:-1], edge[1:] - 1
                    for d, k, low, high in zip(digits[first].tolist(), np.diff(edge).tolist(), part[first].tolist(), part[last].tolist()):
                        old = seen.get((c, prefix, d))
                        if old is None:
                            seen[c, prefix, d] = [k, low, high]
                        else:
                            old[0] += k
                            if low < old[1]:
                                old[1] = low
                            if high > old[2]:
                                old[2] = high
        yield pa.RecordBatch.from_pydict({
            "column": [c for c, _, _ in seen], "prefix": [str(p) for _, p, _ in seen], "digits": [d for _, _, d in seen],
            "n": [v[0] for v in seen.values()], "low": [f"{v[1]:020d}" for v in seen.values()], "high": [f"{v[2]:020d}" for v in seen.values()]},
            pa.schema([("column", pa.int32()), ("prefix", pa.string()), ("digits", pa.int32()), ("n", pa.int64()), ("low", pa.string()), ("high", pa.string())]))

    return materialized(frame.mapInArrow(count, "column int, prefix string, digits int, n long, low string, high string")
                        .groupBy("column", "prefix", "digits").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")),
                        "value-bits")


def column_quartiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column with values: its interpolated quartiles. Rows are not shuffled, only counts."""
    sizes: dict[str, int] = {}

    def ranks(column: str, n: int) -> set[int]:
        sizes[column] = n
        spots = [q * (n - 1) for q in QUARTILES.values()]
        return {int(s) for s in spots} | {-int(-s // 1) for s in spots}

    values = order_statistics(df, columns, ranks)

    def between(column: str, q: float) -> float:
        spot = q * (sizes[column] - 1)
        low, high = values[column, int(spot)], values[column, -int(-spot // 1)]
        return low if low == high else low + (high - low) * (spot - int(spot))

    rows = [(c, *[between(c, q) for q in QUARTILES.values()]) for c in columns if c in sizes]
    return df.sparkSession.createDataFrame(rows, "feature string, " + ", ".join(f"{q} double" for q in QUARTILES))


def fit_robust_scaler(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Median and interquartile range per column (a range of 0 becomes 1): one row each."""
    rows = column_quartiles(train, columns).collect()  # as many rows as columns
    return {r.feature: (r.q50, (r.q75 - r.q25) or 1.0) for r in rows}


def robust_scale(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in fitted.items()})
