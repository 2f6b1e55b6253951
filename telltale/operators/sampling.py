"""Combining, balancing and splitting sessions, reproducibly and without global sorts.

A row's place in a sample is decided by ``md5(seed:id)``: any engine, partitioning or retry gives
the same sample.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telltale.session import broadcast_if_small, materialized, rows_per_block

PREFIX = 4  # hex digits looked at in a round: 65,536 slots per class


def draw(seed: int | str, id_column: str | Column) -> Column:
    c = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.md5(F.concat_ws(":", F.lit(str(seed)), c.cast("string")))


def union_sessions(frames: list[DataFrame]) -> DataFrame:
    """Rows of all sessions, aligned by name; absent columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dedup_sessions(names: DataFrame) -> DataFrame:
    return names.select("session_id").dropDuplicates(["session_id"])


def sample_fraction(df: DataFrame, fraction: float, seed=42, id_column: str = "seq") -> DataFrame:
    """Rows whose draw falls below ``fraction``: a filter, no shuffle."""
    if not 0 < fraction < 1:
        return df
    return df.where(F.substring(draw(seed, id_column), 1, 8) < F.lit(f"{int(fraction * 16 ** 8):08x}"))


def lowest_draws(df: DataFrame, wanted: DataFrame | Callable[[DataFrame], DataFrame], by: str = "label", seed=42,
                 id_column: str = "seq", keep_rest: bool = False) -> DataFrame:
    """Exactly ``wanted.k`` rows per class: those with the lowest draws. ``wanted`` may be made from (class, n).

    Radix selection: a histogram of the draws' first digits tells in which slot of a class its k-th draw lies; only
    that slot is looked into again, by its next digits, until it holds no more rows than a block. Its draws, without the
    rows' other columns, tell the k-th one, and one pass over the rows compares theirs with it. Only rows that share the k-th draw of
    their class, when not all of them are wanted, are ranked. With ``keep_rest``
    every row is kept and ``picked`` tells the two parts apart.
    """
    rows = df.withColumn("_d", draw(seed, id_column))
    cuts = materialized(_cuts(rows, _edge_slots(rows, wanted, by, rows_per_block(df.sparkSession)), by), "cuts")
    torn = F.col("_of") < F.col("_same")
    rows = rows.join(broadcast_if_small(cuts), F.col(by).eqNullSafe(F.col("_by")), "left")
    out = rows.withColumn("picked", F.coalesce(F.col("_d") <= F.col("_cut"), F.lit(False)))
    if cuts.where(torn).limit(1).count():
        ranked = F.coalesce((F.col("_d") == F.col("_cut")) & torn, F.lit(False))
        edge = rows.where(ranked).withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("_d", id_column)))
        out = out.where(~ranked).unionByName(edge.withColumn("picked", F.col("_r") <= F.col("_of")).drop("_r"))
    if not keep_rest:
        return out.where("picked").select(*df.columns)
    return out.select(*df.columns, "picked")


def _cuts(rows: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """(_by, _cut, _same, _of): per class its k-th draw, how many of its rows share it and how many of these are wanted."""
    inside = rows.select(by, "_d").join(broadcast_if_small(edges), F.col(by).eqNullSafe(F.col("_by")) & F.col("_d").startswith(F.col("_slot")))
    draws = inside.groupBy("_by", "_left", "_d").agg(F.count(F.lit(1)).alias("_same"))
    upto = F.sum("_same").over(Window.partitionBy("_by").orderBy("_d"))  # a block at most
    of = F.col("_left") - (F.col("_upto") - F.col("_same"))
    return (draws.withColumn("_upto", upto).where((of > 0) & (of <= F.col("_same")))
            .select("_by", F.col("_d").alias("_cut"), "_same", of.alias("_of")))


def _edge_slots(rows: DataFrame, wanted, by: str, limit: int) -> DataFrame:
    """(_by, _slot, _left): per class the prefix of draws that holds its k-th, and how many rows of it are wanted."""
    def histogram(some: DataFrame, at: int) -> DataFrame:
        return materialized(some.groupBy(F.col(by).alias("_by"), F.substring("_d", at + 1, PREFIX).alias("_digits"))
                            .agg(F.count(F.lit(1)).alias("_n")), "draws")

    def crossed(slots: DataFrame, left: DataFrame) -> DataFrame:
        upto = Window.partitionBy("_by").orderBy("_digits")  # 65,536 slots at most
        place = F.coalesce(F.col("_left"), F.lit(0)) - (F.col("_upto") - F.col("_n"))
        return (slots.withColumn("_upto", F.sum("_n").over(upto)).withColumnRenamed("_by", "_own")
                .join(broadcast_if_small(left), F.col("_own").eqNullSafe(F.col("_by")))
                .where((place > 0) & (place <= F.col("_n")))
                .select("_by", F.concat("_slot", "_digits").alias("_slot"), place.alias("_left"), "_n"))

    slots = histogram(rows, 0)
    if not isinstance(wanted, DataFrame):
        wanted = wanted(slots.groupBy(F.col("_by").alias(by)).agg(F.sum("_n").alias("n")))
    sizes = slots.groupBy(F.col("_by").alias("_own")).agg(F.sum("_n").alias("_all"))
    left = (wanted.select(F.col(by).alias("_by"), F.col("k").cast("long").alias("k"))
            .join(sizes, F.col("_by").eqNullSafe(F.col("_own")))  # no more than there are
            .select("_by", F.lit("").alias("_slot"), F.least("k", "_all").alias("_left")))
    found = materialized(crossed(slots, left), "edges")
    depth, done = PREFIX, []
    while depth < 32 and found.where(F.col("_n") > limit).limit(1).count():
        done.append(found.where(F.col("_n") <= limit))
        deep = found.where(F.col("_n") > limit).drop("_n")
        inside = rows.join(broadcast_if_small(deep), F.col(by).eqNullSafe(F.col("_by")) & F.col("_d").startswith(F.col("_slot")), "left_semi")
        found = materialized(crossed(histogram(inside, depth), deep), "edges")
        depth += PREFIX
    for part in done:
        found = found.unionByName(part)
    return found.drop("_n")


def balance_classes(df: DataFrame, seed=42, id_column: str = "seq", by: str = "label") -> DataFrame:
    """Every class cut to the size of the smallest one."""
    def least(counts: DataFrame) -> DataFrame:
        return counts.select(by).join(F.broadcast(counts.agg(F.min("n").alias("k"))))  # a one-row table
    return lowest_draws(df, least, by, seed, id_column)


def stratified_split(df: DataFrame, held_out: float = 0.25, seed=42, id_column: str = "seq",
                     by: str = "label") -> DataFrame:
    """``split`` = 'test' for an exact share of every class, 'train' for the rest."""
    def share(counts: DataFrame) -> DataFrame:
        return counts.select(by, F.floor(F.col("n") * held_out + 0.5).alias("k"))
    out = lowest_draws(df, share, by, seed, id_column, keep_rest=True)
    return out.select(*df.columns, F.when(F.col("picked"), "test").otherwise("train").alias("split"))


def validation_split(train: DataFrame, held_out: float = 0.2, seed="42v", id_column: str = "seq",
                     by: str = "label") -> DataFrame:
    """A second, independent cut of the training rows: 'validation' or 'train'."""
    out = stratified_split(train.drop("split"), held_out, seed, id_column, by)
    return out.withColumn("split", F.when(F.col("split") == "test", "validation").otherwise("train"))
