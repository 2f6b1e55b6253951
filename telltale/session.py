"""Session settings shared by batch and streaming jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows one ordered group may hold before it is split into blocks.
ROWS_PER_BLOCK_CONF = "spark.telltale.rowsPerBlock"
ROWS_PER_BLOCK = 2_000_000

# Largest table (in rows) that may be broadcast after its count was checked.
BROADCAST_ROWS_CONF = "spark.telltale.broadcastRows"
BROADCAST_ROWS = 500_000

# Settings for tables of many columns. The machine does not compile methods of over 8000 bytes of code but interprets them, row after
# row; Spark then takes its other, split form. Splits of files are bounded, so what a task of a model fit holds is too.
WIDE_ROWS = {"spark.sql.codegen.hugeMethodLimit": "8000", "spark.sql.files.maxPartitionBytes": "32m"}
# A split of a file is read as whole row groups, by default 128 MB. Tables that models are fitted on have smaller ones.
ROW_GROUP = 16 << 20
SPARK_DEFAULTS = {"65535", "134217728b", "134217728", "128MB", "128m"}

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def create_session(app: str = "telltale", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults every job here assumes (UTC, AQE with skew joins)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER,
        **WIDE_ROWS,
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Pin the session zone of a session we did not build, and set for wide rows what was left at Spark's defaults."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for name, value in WIDE_ROWS.items():
        if spark.conf.get(name) in SPARK_DEFAULTS:
            spark.conf.set(name, value)
    return spark


def rows_per_block(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_PER_BLOCK_CONF, str(ROWS_PER_BLOCK)))


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="telltale-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path no other run uses, below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so later jobs see these very rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def materialized(df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back (columnar, prunable), in row groups of ``row_group`` bytes at most."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write if row_group is None else df.write.option("parquet.block.size", row_group)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def within_broadcast_bound(df: DataFrame, max_rows: int | None = None) -> bool:
    """Count ``df`` (per-partition counts only) to decide whether it may be broadcast."""
    if max_rows is None:
        max_rows = int(df.sparkSession.conf.get(BROADCAST_ROWS_CONF, str(BROADCAST_ROWS)))
    return df.count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Broadcast behind a size check; beyond it, a shuffle join with AQE skew splitting."""
    return F.broadcast(df) if within_broadcast_bound(df, max_rows) else df
