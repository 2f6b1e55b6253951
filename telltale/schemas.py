"""Schemas and fixed column lists of the process-telemetry data model."""

from pyspark.sql import types as T

KEYS = ("session_id", "pid")

PROCESS_STREAM = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("pid", T.LongType()),
    T.StructField("ppid", T.LongType()),
    T.StructField("cpu", T.DoubleType()),
    T.StructField("mem", T.DoubleType()),
    T.StructField("exe", T.StringType()),
    T.StructField("num_children", T.LongType()),
    T.StructField("child_entropy", T.DoubleType()),
    T.StructField("io_read_bytes", T.LongType()),
    T.StructField("io_write_bytes", T.LongType()),
    T.StructField("io_read_count", T.LongType()),
    T.StructField("io_write_count", T.LongType()),
    T.StructField("num_connections", T.LongType()),
    T.StructField("num_threads", T.LongType()),
    T.StructField("num_fds", T.LongType()),
    T.StructField("ctx_switches_voluntary", T.LongType()),
    T.StructField("ctx_switches_involuntary", T.LongType()),
    T.StructField("status", T.StringType()),
])

EVENT_LOG = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("details", T.StringType()),
])

# The numeric process metrics, in schema order.
METRICS = [
    "cpu", "mem", "num_children", "child_entropy",
    "io_read_bytes", "io_write_bytes", "io_read_count", "io_write_count",
    "num_connections", "num_threads", "num_fds",
    "ctx_switches_voluntary", "ctx_switches_involuntary",
]

# Columns that never enter a feature vector.
NON_FEATURES = ["timestamp", "session_id", "pid", "ppid", "exe", "label", "session"]

# The 48 engineered columns, in training order.
ENGINEERED = [
    "cpu_mean_5", "cpu_std_5", "mem_mean_5", "mem_std_5",
    "cpu_mean_10", "cpu_std_10", "mem_mean_10", "mem_std_10",
    "cpu_rate", "mem_rate", "cpu_ema", "mem_ema", "cpu_spike", "mem_spike",
    "has_children", "delta_cpu", "delta_mem", "children_rate",
    "io_read_rate", "io_write_rate", "io_total_rate",
    "io_read_ops_rate", "io_write_ops_rate", "io_write_burst", "io_bytes_per_op",
    "connections_rate", "threads_rate", "fds_rate",
    "ctx_voluntary_rate", "ctx_involuntary_rate", "ctx_total_rate", "ctx_involuntary_ratio",
    "cpu_baseline", "mem_baseline", "io_baseline",
    "cpu_dev_from_baseline", "mem_dev_from_baseline", "io_dev_from_baseline",
    "cpu_pct_dev_baseline", "mem_pct_dev_baseline",
    "cpu_burst", "mem_burst", "proc_age", "cpu_per_age", "mem_per_age", "io_per_age",
    "cpu_norm_parent", "mem_norm_parent",
]

# The 62 ordered model features; ``status`` is text and therefore always 0.
MODEL_FEATURES = METRICS + ["status"] + ENGINEERED
