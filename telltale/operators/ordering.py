"""Total orders and rolling values that cross process boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telltale.operators.blocks import Series
from telltale.session import materialized, rows_per_block


def order_series(df: DataFrame) -> DataFrame:
    """Sorted by process and time, in ranges: a long series spans several of them."""
    order = ["session_id", "pid", "timestamp", "seq"]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def order_combined(df: DataFrame) -> DataFrame:
    """Range-partitioned total order by time."""
    return df.orderBy("timestamp", "seq")


def global_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """0-based position of every row in time order, without one global task."""
    s = Series(df.withColumn("_all", F.lit(0)), ("_all",), ("timestamp", "seq"))
    s.running(F.sum, **{name: F.lit(1)})
    return s.done().withColumn(name, F.col(name) - 1).drop("_all")


def global_jump(s: Series, frame: int = 20) -> DataFrame:
    """``delta_cpu`` / ``delta_mem`` above the 95th percentile of the last 20 rows of the whole
    table sorted by process and time, so the window runs across process boundaries.

    From its 20th row on a process only sees its own rows, and the series' own window has the answer. Earlier rows
    also see the last rows of the processes before them. Each process hands on its last 19 pairs of values as one row; these
    rows, not the table's, are put into one order, in ranges where they are many, and every process gets the 19 pairs before
    its first row. They meet its rows by the series' own keys, so the rows stay where the series has laid them out.
    """
    names, back = {"cpu_jump": "delta_cpu", "mem_jump": "delta_mem"}, frame - 1
    s.add(_i=s.index, **{f"_m_{n}": F.max(d).over(s.before(back)) for n, d in names.items()})
    s.add(_tail=F.lead("_i", back).over(s.w).isNull())
    rows = s.done()
    table = _pairs_before(rows.where("_tail"), s.keys, list(names.values()), back)
    met = _with_table(rows, table, s.keys)
    size, want = F.coalesce(F.size("_p"), F.lit(0)), F.lit(frame) - F.col("_i")
    pairs = F.slice("_p", F.greatest(size - want + 1, F.lit(1)), F.greatest(want, F.lit(0)))
    out = {}
    for n, d in names.items():
        largest = F.greatest(f"_m_{n}", F.array_max(F.transform(pairs, lambda e: e[d])))
        own = F.col(d) > F.col(f"_m_{n}")
        hit = F.when(F.col("_i") >= frame, own).when(size >= want, F.col(d) > largest)
        out[n] = F.coalesce(hit, F.lit(False)).cast("int")
    return met.withColumns(out).drop("_i", "_tail", "_p", *[f"_m_{n}" for n in names])


def _pairs_before(tails: DataFrame, keys: list[str], values: list[str], back: int) -> DataFrame:
    """(_k_0, _k_1, ..., _p): per process the ``back`` values before its first row, oldest first, fewer at the start of the table."""
    # a few per block of the process; rows of one time and seq stay in the series' order
    samples = F.array_sort(F.collect_list(F.struct("timestamp", "seq", "_i", *values)))
    latest = F.slice("_t", F.greatest(F.size("_t") - back + 1, F.lit(1)), back)
    ends = materialized(tails.groupBy(*keys).agg(samples.alias("_t")).withColumn(
        "_t", F.transform(latest, lambda e: F.struct(*[e[v].alias(v) for v in values]))).withColumn("_all", F.lit(0)), "tails")
    # a process before has one row at least, so no more than ``back`` of them are looked at
    order = Series(ends, ("_all",), keys, halo=back, limit=max(back, rows_per_block(ends.sparkSession) // back))
    order.add(_p=F.flatten(F.collect_list("_t").over(order.before(back))))
    last = F.slice("_p", F.greatest(F.size("_p") - back + 1, F.lit(1)), back)
    return order.done().select(*[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)], last.alias("_p"))


def _with_table(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with ``_p`` of their process. Known keys meet by plain equality, which asks for no other layout than the series has;
    rows with a null among their keys meet on their own."""
    known, same, alike = F.lit(True), F.lit(True), F.lit(True)
    for i, k in enumerate(keys):
        known, same = known & F.col(k).isNotNull(), same & (F.col(k) == F.col(f"_k_{i}"))
        alike = alike & F.col(k).eqNullSafe(F.col(f"_k_{i}"))
    spare = [f"_k_{i}" for i in range(len(keys))]
    return (rows.where(known).join(table, same, "left").unionByName(rows.where(~known).join(table, alike, "left"))).drop(*spare)
