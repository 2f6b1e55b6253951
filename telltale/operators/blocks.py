"""Ordered groups of any size, split into bounded blocks.

A window over ``(session_id, pid)`` puts a whole series into one task. That is fine for ordinary
processes and wrong for one that holds a third of all rows. ``Series`` counts rows per group first and
routes by the result: groups of up to ``rows_per_block`` rows stay in the plain window and are not touched
otherwise; only the rows of larger ones are written, in ranges of equal depth along their order. Each such
block receives copies of the rows just before it (its halo), and running values are carried in from the
blocks before. Results are the same either way.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telltale.session import broadcast_if_small, materialized, rows_per_block

BLOCK, HALO = "_blk", "_halo"


def split_hot(df: DataFrame, keys, limit: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups of up to ``limit`` rows, and those of larger ones (None where there are none).

    One pass over the keys finds the large groups, of which there are at most rows / limit.
    """
    keys = list(keys)
    limit = limit or rows_per_block(df.sparkSession)
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_b_n")).where(F.col("_b_n") > limit).select(*keys)
    if large.limit(1).count() == 0:
        return df, None
    large = broadcast_if_small(materialized(large, "hot-groups"))
    same = [F.col(f"_g.{k}").eqNullSafe(F.col(f"_h.{k}")) for k in keys]
    on = same[0]
    for part in same[1:]:
        on = on & part
    return df.alias("_g").join(large.alias("_h"), on, "left_anti"), df.alias("_g").join(large.alias("_h"), on, "left_semi")


def equal_depth(df: DataFrame, order: list[str], limit: int, name: str = BLOCK) -> DataFrame:
    """The rows, written in ranges of ``order`` of at most ``limit`` rows; ``name`` numbers the ranges in order.

    Range bounds are sampled, so depth follows the rows however their values are spread. Ranges that came out
    too deep are split again on their own, and get a longer number ([3] becomes [3, 0], [3, 1] ...), until
    that helps no more: only rows that agree in the whole order stay together beyond the limit, with their neighbours at most.
    """
    def ranges(rows: DataFrame, n: int) -> DataFrame:
        return rows.repartitionByRange(max(1, math.ceil(2 * n / limit)), *order).withColumn(
            name, F.concat(F.col(name), F.array(F.spark_partition_id())))

    def too_deep(rows: DataFrame) -> DataFrame:
        ends = F.struct(*order)
        return (rows.groupBy(name).agg(F.count(F.lit(1)).alias("_b_n"), F.min(ends).alias("_b_lo"), F.max(ends).alias("_b_hi"))
                .where((F.col("_b_n") > limit) & (F.col("_b_lo") != F.col("_b_hi"))).select(name, "_b_n"))

    df = df.withColumn(name, F.array().cast("array<int>"))
    done, before = [], math.inf
    rows = materialized(ranges(df, df.count()), "ranges")
    while True:
        deep = materialized(too_deep(rows), "deep")
        n = deep.agg(F.sum("_b_n")).first()[0] or 0
        if n == 0 or n > 0.9 * before:
            break
        before, deep = n, broadcast_if_small(deep.select(name))
        done.append(rows.join(deep, name, "left_anti"))
        rows = materialized(ranges(rows.join(deep, name, "left_semi"), n), "ranges")
    for part in done:
        rows = rows.unionByName(part)
    return rows


class Series:
    """Rows grouped by ``keys`` and totally ordered by ``order``; large groups in blocks.

    ``cold`` has the ordinary groups, ``hot`` the rows of large ones with their blocks and halos, or is None.
    Columns are added to both; windows made by the methods below are right for either.
    """

    def __init__(self, df: DataFrame, keys, order, halo: int = 0, limit: int | None = None):
        self.keys, self.order, self.halo = list(keys), list(order), halo
        self.cold, hot = split_hot(df, keys, limit)
        self.hot: DataFrame | None = None
        self.part = self.keys
        if hot is not None:
            self.part = self.keys + [BLOCK]
            blocks = equal_depth(hot, self.keys + [c for c in self.order if c not in self.keys], limit or rows_per_block(df.sparkSession))
            self.hot = self._with_halo(blocks, halo)
            self.cold = self.cold.withColumns({BLOCK: F.array().cast("array<int>"), HALO: F.lit(False)})

    @property
    def df(self) -> DataFrame:
        """All rows, with blocks and halo copies."""
        return self.cold if self.hot is None else self.cold.unionByName(self.hot)

    # -- windows ---------------------------------------------------------------------------
    @property
    def w(self):
        return Window.partitionBy(*self.part).orderBy(*self.order)

    def last(self, n: int):
        """The current row and the ``n - 1`` before it."""
        return self.w.rowsBetween(-(n - 1), 0)

    def before(self, n: int):
        """The ``n`` rows before the current one."""
        return self.w.rowsBetween(-n, -1)

    @property
    def index(self) -> Column:
        """1-based row number, exact up to the halo length and never below it after that."""
        return F.row_number().over(self.w)

    def _each(self, change) -> "Series":
        self.cold = change(self.cold)
        if self.hot is not None:
            self.hot = change(self.hot)
        return self

    def add(self, **columns: Column) -> "Series":
        return self._each(lambda df: df.withColumns(columns))

    def drop(self, *names: str) -> "Series":
        return self._each(lambda df: df.drop(*names))

    # -- values that span the whole group ----------------------------------------------------
    def whole(self, **aggs: Column) -> "Series":
        """Group-wide aggregates on every row."""
        w = Window.partitionBy(*self.part)
        self.cold = self.cold.withColumns({name: agg.over(w) for name, agg in aggs.items()})
        if self.hot is not None:
            self._join_hot(self._real_hot_rows(), aggs)
        return self

    def _real_hot_rows(self) -> DataFrame:
        return self.hot.where(~F.col(HALO))

    def _join_hot(self, rows: DataFrame, aggs: dict[str, Column]) -> None:
        """Join one pre-aggregated row per hot group."""
        table = materialized(rows.groupBy(*self.keys).agg(*[agg.alias(name) for name, agg in aggs.items()]), "whole")
        self.join_hot(table)

    def join_hot(self, table: DataFrame, on: list[str] | None = None) -> None:
        """Add the columns of a table of hot groups (or of their blocks) to the hot rows; null keys meet null keys."""
        on = on or self.keys
        new = [c for c in table.columns if c not in on]
        right = broadcast_if_small(table.select(*[F.col(c).alias(f"_k_{i}") for i, c in enumerate(on)], *new))
        met = F.lit(True)
        for i, c in enumerate(on):
            met = met & F.col(c).eqNullSafe(F.col(f"_k_{i}"))
        self.hot = self.hot.join(right, met, "left").drop(*[f"_k_{i}" for i in range(len(on))])

    def head_mean(self, n: int, **columns: Column) -> "Series":
        """Mean over the first ``n`` rows of the group, on every row."""
        self.add(_i=self.index)
        w = Window.partitionBy(*self.part)
        self.cold = self.cold.withColumns({name: F.avg(F.when(F.col("_i") <= n, c)).over(w) for name, c in columns.items()})
        if self.hot is not None:
            if self.halo < n:
                raise ValueError(f"head_mean over {n} rows needs a halo of {n}")
            # the index is exact up to the halo length
            self._join_hot(self._real_hot_rows().where(F.col("_i") <= n), {name: F.avg(c) for name, c in columns.items()})
        return self.drop("_i")

    def running(self, fn, **values: Column) -> "Series":
        """Running ``fn`` (F.sum, F.max, F.min) from the first row of the group to this one."""
        upto = self.w.rowsBetween(Window.unboundedPreceding, 0)
        self.cold = self.cold.withColumns({name: fn(value).over(upto) for name, value in values.items()})
        if self.hot is None:
            return self
        combine = (lambda a, b: a + b) if fn is F.sum else (F.greatest if fn is F.max else F.least)
        self._carry({f"_c_{n}": fn(v) for n, v in values.items()}, fn, Window.unboundedPreceding, -1)
        self.hot = self.hot.withColumns({f"_i_{n}": fn(F.when(~F.col(HALO), v)).over(upto) for n, v in values.items()})
        for n in values:
            past, inside = F.col(f"_c_{n}"), F.col(f"_i_{n}")
            self.hot = self.hot.withColumn(
                n, F.when(past.isNull(), inside).when(inside.isNull(), past).otherwise(combine(past, inside))
            ).drop(f"_c_{n}", f"_i_{n}")
        return self

    def last_known(self, **values: Column) -> "Series":
        """Latest non-null value at or before each row."""
        return self._nearest(values, F.last, F.max_by, Window.unboundedPreceding, -1,
                             self.w.rowsBetween(Window.unboundedPreceding, 0))

    def next_known(self, **values: Column) -> "Series":
        """Earliest non-null value at or after each row."""
        return self._nearest(values, F.first, F.min_by, 1, Window.unboundedFollowing,
                             self.w.rowsBetween(0, Window.unboundedFollowing))

    def _nearest(self, values, pick, pick_by, start, end, frame) -> "Series":
        self.cold = self.cold.withColumns({n: pick(v, True).over(frame) for n, v in values.items()})
        if self.hot is None:
            return self
        at = F.struct(*self.order)
        self._carry({f"_c_{n}": pick_by(v, F.when(v.isNotNull(), at)) for n, v in values.items()},
                    lambda c: pick(c, True), start, end)
        self.hot = self.hot.withColumns({n: F.coalesce(pick(v, True).over(frame), F.col(f"_c_{n}")) for n, v in values.items()})
        self.hot = self.hot.drop(*[f"_c_{n}" for n in values])
        return self

    def _carry(self, aggs, fn, start, end) -> None:
        """Per block: each block aggregate, combined by ``fn`` over other blocks of its group."""
        w = Window.partitionBy(*self.keys).orderBy(BLOCK).rowsBetween(start, end)
        table = materialized(self._real_hot_rows().groupBy(*self.keys, BLOCK)
                             .agg(*[agg.alias(f"_v{name}") for name, agg in aggs.items()])
                             .select(*self.keys, BLOCK, *[fn(F.col(f"_v{name}")).over(w).alias(name) for name in aggs]), "carried")
        self.join_hot(table, self.keys + [BLOCK])

    # -- block plumbing ----------------------------------------------------------------------
    def _with_halo(self, df: DataFrame, n: int) -> DataFrame:
        if n == 0:
            return df.withColumn(HALO, F.lit(False))
        newest = Window.partitionBy(*self.keys, BLOCK).orderBy(*[F.col(c).desc() for c in self.order])
        tails = materialized(
            df.withColumn("_b_r", F.row_number().over(newest)).where(F.col("_b_r") <= n)
            .withColumn("_b_t", F.row_number().over(Window.partitionBy(*self.keys).orderBy(BLOCK, F.col("_b_r").desc())))
            .drop("_b_r"), "tails")
        first = F.min("_b_t").alias("_b_s")
        wanted = (tails.groupBy(*self.keys, BLOCK).agg(first).where(F.col("_b_s") > 1)
                  .withColumn("_w_t", F.explode(F.sequence(F.greatest(F.col("_b_s") - n, F.lit(1)), F.col("_b_s") - 1)))
                  .select(*[F.col(c).alias(f"_w_{i}") for i, c in enumerate(self.keys)], F.col(BLOCK).alias("_w_b"), "_w_t"))
        met = F.col("_b_t") == F.col("_w_t")
        for i, c in enumerate(self.keys):
            met = met & F.col(c).eqNullSafe(F.col(f"_w_{i}"))
        halo = tails.drop(BLOCK).join(wanted, met).select(*[c for c in df.columns if c != BLOCK], F.col("_w_b").alias(BLOCK))
        return (df.withColumn(HALO, F.lit(False))
                .unionByName(materialized(halo, "halo").withColumn(HALO, F.lit(True))))

    def done(self) -> DataFrame:
        """The rows themselves, without halo copies and block columns."""
        if self.hot is None:
            return self.cold
        return self.cold.drop(BLOCK, HALO).unionByName(self._real_hot_rows().drop(BLOCK, HALO))


def time_rank() -> Column:
    """(timestamp, seq) as one number, so ``max_by`` keeps a flat buffer and hashes instead of sorting."""
    micros = F.unix_micros("timestamp").cast("decimal(17,0)")
    return micros * F.lit(Decimal(10) ** 19).cast("decimal(20,0)") + F.col("seq").cast("decimal(19,0)")


def process_series(df: DataFrame, keys=("session_id", "pid"), halo: int = 0, limit: int | None = None) -> Series:
    """One series per process, in time order, ties broken by ``seq``."""
    return Series(df, keys, ("timestamp", "seq"), halo, limit)
