"""Process-tree operators: children per snapshot and values relative to the parent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telltale.functions.scalars import finite, ratio
from telltale.operators.blocks import Series, time_rank
from telltale.session import broadcast_if_small


def last_per_process(df: DataFrame, keys=("session_id", "pid")) -> DataFrame:
    """Last known cpu and mem of each process."""
    at = time_rank()
    return df.groupBy(*keys).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"last_{c}") for c in ("cpu", "mem")])


def parent_normalize(df: DataFrame, keys=("session_id", "pid"), as_of: bool = False) -> DataFrame:
    """cpu and mem divided by the parent's; no parent or a zero one gives 0.

    By default the parent's value is its last in the session. ``as_of`` takes the last value the
    parent had at or before the row instead.
    """
    if as_of:
        return _parent_as_of(df, keys)
    scope = [k for k in keys if k != "pid"]
    parents = last_per_process(df, keys).withColumnRenamed("pid", "ppid")
    joined = df.join(broadcast_if_small(parents), scope + ["ppid"], "left")
    return joined.select(*[c for c in df.columns], *[
        finite(ratio(F.col(c), F.col(f"last_{c}"))).alias(f"{c}_norm_parent") for c in ("cpu", "mem")])


def _parent_as_of(df: DataFrame, keys) -> DataFrame:
    scope = [k for k in keys if k != "pid"]
    samples = df.select(*scope, F.col("pid").alias("_owner"), "timestamp", F.lit(0).alias("_side"), "seq",
                        *[F.col(c).alias(f"_p_{c}") for c in ("cpu", "mem")])
    rows = df.where(F.col("ppid").isNotNull()).select(
        *scope, F.col("ppid").alias("_owner"), "timestamp", F.lit(1).alias("_side"), "seq",
        *[F.lit(None).cast("double").alias(f"_p_{c}") for c in ("cpu", "mem")])
    s = Series(samples.unionByName(rows), scope + ["_owner"], ("timestamp", "_side", "seq"))
    s.last_known(**{f"_at_{c}": F.col(f"_p_{c}") for c in ("cpu", "mem")})
    known = s.done().where(F.col("_side") == 1).select(*scope, "seq", "_at_cpu", "_at_mem")
    return df.join(known, scope + ["seq"], "left").select(*df.columns, *[
        finite(ratio(F.col(c), F.col(f"_at_{c}"))).alias(f"{c}_norm_parent") for c in ("cpu", "mem")])


def child_count(snapshot: DataFrame, by=("snap_ts",)) -> DataFrame:
    return (snapshot.where(F.col("ppid").isNotNull()).groupBy(*by, "ppid")
            .agg(F.count(F.lit(1)).alias("num_children")))


def child_exe_entropy(snapshot: DataFrame, by=("snap_ts",)) -> DataFrame:
    """Children and Shannon entropy (bits) of their executables, per parent.

    Counting per executable first keeps the second aggregation small for any parent; the sum
    over p·log2(p) is then ``log2(n) - sum(c·log2(c)) / n``.
    """
    n, c = F.sum("_c"), F.col("_c").cast("double")
    per_exe = (snapshot.where(F.col("ppid").isNotNull())
               .groupBy(*by, "ppid", F.coalesce("exe", F.lit("")).alias("exe")).agg(F.count(F.lit(1)).alias("_c")))
    return per_exe.groupBy(*by, "ppid").agg(
        n.alias("num_children"), F.greatest(F.log2(n) - F.sum(c * F.log2(c)) / n, F.lit(0.0)).alias("child_entropy"))


def child_tree_join(snapshot: DataFrame, by=("snap_ts",)) -> DataFrame:
    """Every process with its number of children and their entropy; none gives 0."""
    children = child_exe_entropy(snapshot, by).withColumnRenamed("ppid", "pid")
    keep = [c for c in snapshot.columns if c not in ("num_children", "child_entropy")]
    return (snapshot.select(*keep).join(children, [*by, "pid"], "left")
            .select(*keep, F.coalesce("num_children", F.lit(0)).alias("num_children"),
                    F.coalesce("child_entropy", F.lit(0.0)).alias("child_entropy")))
