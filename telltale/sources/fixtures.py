"""Process-telemetry views derived from the driver's tables.

``events`` is shaped into a process stream and an event log. The same shapes exist as SQL in
``telltale.oracles`` for checking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telltale.operators.blocks import Series, process_series
from telltale.session import use_utc


def _session_of(ts: str):
    return F.concat(F.lit("s"), F.floor((F.dayofmonth(ts) - 1) / 10).cast("int").cast("string"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("timestamp", F.col("ts").cast("timestamp"))


def process_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process stream: gauges come from ``props``, counters are running sums."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    base = events(spark, sf_dir).select(
        F.col("event_id").alias("seq"), "timestamp", _session_of("ts").alias("session_id"),
        F.col("user_id").alias("pid"),
        F.when(F.col("user_id") != 0, F.floor(F.col("user_id") / 4).cast("long")).alias("ppid"),
        F.col("value").alias("cpu"), k.alias("k"), F.col("event_type").alias("exe"))
    s = process_series(base)
    s.running(F.sum, io_write_bytes=F.round(F.col("cpu") * 100).cast("long"), io_read_bytes=F.col("k") * 10,
              io_write_count=F.lit(1), io_read_count=F.col("k") % 4,
              ctx_switches_voluntary=F.col("k") % 11, ctx_switches_involuntary=F.col("k") % 5)
    return s.done().select(
        "seq", "timestamp", "session_id", "pid", "ppid", "cpu", F.col("k").cast("double").alias("mem"), "exe",
        (F.col("k") % 7).alias("num_children"), (F.col("k") % 15).alias("num_connections"),
        F.col("k").alias("num_threads"), (F.col("k") * 3).alias("num_fds"),
        "io_write_bytes", "io_read_bytes", "io_write_count", "io_read_count",
        "ctx_switches_voluntary", "ctx_switches_involuntary",
        F.when(F.col("k") % 2 == 0, "running").otherwise("sleeping").alias("status"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log with nested starts, orphan ends and unrelated kinds."""
    kind = (F.when(F.col("event_type") == "error", "anomaly_start")
            .when(F.col("event_type") == "signup", "anomaly_end").otherwise("normal_start"))
    return (events(spark, sf_dir)
            .select(F.col("event_id").alias("seq"), "timestamp", _session_of("ts").alias("session_id"),
                    kind.alias("event_type"),
                    F.concat(F.lit("cpu,pid="), F.col("user_id").cast("string"), F.lit(",duration=20")).alias("details")))


def snapshots(proc: DataFrame) -> DataFrame:
    """The latest row of each process per day."""
    newest = F.struct("timestamp", "seq")
    return (proc.groupBy(F.date_trunc("day", "timestamp").alias("snap_ts"), "pid")
            .agg(F.max_by(F.struct("ppid", "exe"), newest).alias("r"))
            .select("snap_ts", "pid", "r.ppid", "r.exe"))


def scored(proc: DataFrame) -> DataFrame:
    """Labels and tied scores for the metrics operators."""
    hit = F.col("exe") == "error"
    score = (F.col("mem") + F.when(hit, 20).otherwise(0)) / 120.0
    return proc.select("seq", hit.cast("int").alias("label"), score.alias("score"),
                       (score >= 0.5).cast("int").alias("pred"))
