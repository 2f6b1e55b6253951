"""Naming what an alerted process looks like: suspicious metrics and attack types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telltale.functions.scalars import format_metric

# Attack types in winning order with confidence, description, recommendations.
ATTACKS = [
    ("Process Injection / Hollowing", 0.85,
     "Excessive child process creation detected. May indicate process hollowing, DLL injection, or process spawning attacks.",
     ["Inspect child processes with process explorer", "Check for unsigned or suspicious DLLs",
      "Examine process memory for injected code"]),
    ("Cryptocurrency Mining", 0.80,
     "Sustained high CPU usage detected. May indicate cryptocurrency mining malware.",
     ["Check process name against known miners", "Monitor network connections to mining pools",
      "Examine process for packed/obfuscated code"]),
    ("Fork Bomb / DoS", 0.80,
     "Excessive resource creation. May indicate fork bomb or denial-of-service attack.",
     ["Kill process immediately", "Set process/user resource limits", "Check for recursive process spawning"]),
    ("Data Exfiltration", 0.75,
     "High I/O combined with network activity. May indicate data theft or exfiltration.",
     ["Capture network traffic for analysis", "Check destination IPs/domains",
      "Identify files being accessed", "Review process for data staging behavior"]),
    ("Ransomware", 0.70,
     "Rapid file modification activity. May indicate ransomware encryption.",
     ["⚠️ URGENT: Isolate system immediately", "Kill process if confirmed malicious",
      "Check for ransom notes or file extensions", "Restore from backup if encrypted"]),
    ("Network Scanning / C2", 0.70,
     "Excessive network connections. May indicate port scanning or C2 communication.",
     ["Capture connection details (IPs, ports)", "Check against threat intelligence feeds",
      "Monitor for beaconing behavior", "Inspect for tunneling protocols"]),
    ("Memory Scraping", 0.65,
     "Abnormal memory usage. May indicate credential dumping or memory scraping.",
     ["Check for LSASS access attempts", "Review process privileges",
      "Look for memory dump tools (Mimikatz, etc.)"]),
    ("File Descriptor Leak", 0.60,
     "Excessive open file handles. May indicate FD leak or file system attack.",
     ["List open files with lsof", "Check for file system filling", "Monitor for inode exhaustion"]),
    ("Unknown Anomaly", 0.50,
     "Anomalous behavior detected but specific attack type unclear.",
     ["Investigate process manually", "Check process reputation/signature",
      "Review full process behavior timeline"]),
]

TOP_METRICS = 5
MIN_CONTRIBUTION = 0.01
HIGH_VALUE = 10


def top_metrics(features: list[str], importances: dict[str, float] | None = None) -> Column:
    """Array of ``name=0.00`` texts of a row's most suspicious metrics.

    Contribution is importance times ``|v| / (|v| + 1)``: the five largest, when above 0.01, ties
    in feature order. Without importances, every feature beyond ±10.
    """
    if importances is None:
        found = F.array(*[F.when(F.abs(F.col(c)) > HIGH_VALUE, format_metric(c, F.col(c))) for c in features])
        return F.array_compact(found)
    entries = F.array(*[
        F.struct((-(F.lit(float(importances.get(c, 0.0))) * (F.abs(F.col(c)) / (F.abs(F.col(c)) + 1)))).alias("rank"),
                 F.lit(i).alias("at"), F.lit(c).alias("name"), F.col(c).cast("double").alias("value"))
        for i, c in enumerate(features)])
    best = F.slice(F.array_sort(entries), 1, TOP_METRICS)
    kept = F.filter(best, lambda e: -e["rank"] > MIN_CONTRIBUTION)
    return F.transform(kept, lambda e: format_metric(e["name"], e["value"]))


def _mentions(metrics: Column, *words: str) -> Column:
    """Some metric text holds any of the words."""
    return F.exists(metrics, lambda m: F.lower(m).rlike("|".join(words)))


def attack_conditions(metrics: Column) -> dict[str, Column]:
    """Condition of each type but the last, in winning order."""
    busy_cpu = F.exists(metrics, lambda m: F.lower(m).contains("cpu") & F.lower(m).rlike("spike|burst"))
    io = _mentions(metrics, "io")
    tests = [
        _mentions(metrics, "child") & (F.col("num_children") > 5),
        busy_cpu & (F.col("cpu") > 70),
        (F.col("num_threads") > 100) | (F.col("num_children") > 20),
        io & _mentions(metrics, "connection", "network"),
        (F.col("io_write_rate") > 5_000_000) | (io & (F.col("num_fds") > 100)),
        F.col("num_connections") > 10,
        _mentions(metrics, "mem") & (F.col("mem") > 60),
        F.col("num_fds") > 200,
    ]
    return {attack[0]: F.coalesce(t, F.lit(False)) for attack, t in zip(ATTACKS, tests)}


def classify_attack(df: DataFrame, metrics: str = "suspicious_metrics") -> DataFrame:
    """Add ``attack_type``: the most confident matching type, first in order on ties."""
    choice = F.lit(ATTACKS[-1][0])
    for name, test in reversed(attack_conditions(F.col(metrics)).items()):
        choice = F.when(test, F.lit(name)).otherwise(choice)
    return df.withColumn("attack_type", choice)


def matching_attacks(metrics: str = "suspicious_metrics") -> Column:
    """Every matching type of a row, most confident first."""
    found = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in attack_conditions(F.col(metrics)).items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(ATTACKS[-1][0])))


def attack_table(spark: SparkSession) -> DataFrame:
    """One row per type: a literal table, built without Python workers."""
    rows = [F.struct(F.lit(name).alias("attack_type"), F.lit(confidence).alias("confidence"), F.lit(text).alias("description"),
                     F.array(*[F.lit(step) for step in steps]).alias("recommendations"))
            for name, confidence, text, steps in ATTACKS]
    return spark.range(1).select(F.inline(F.array(*rows)))


def attack_lookup(df: DataFrame) -> DataFrame:
    """Join confidence, description and recommendations by ``attack_type``."""
    return df.join(F.broadcast(attack_table(df.sparkSession)), "attack_type", "left")  # nine rows


def _shown(c: str, pattern: str = "0") -> Column:
    return F.call_function("format_number", F.col(c).cast("double"), F.lit(pattern))


def indicators() -> Column:
    """Texts that explain the chosen type from the row's own values."""
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    # Indicator texts per type, in the order of ATTACKS.
    texts = [
        [say("Spawned ", _shown("num_children"), " child processes"), F.lit("Abnormal process tree structure")],
        [say("CPU usage: ", _shown("cpu", "0.0"), "%"), F.lit("Prolonged compute-intensive activity"),
         say("Process age: ", _shown("proc_age"), "s")],
        [say("Thread count: ", _shown("num_threads")), say("Child processes: ", _shown("num_children")),
         F.lit("Rapid resource exhaustion")],
        [say("I/O write rate: ", _shown("io_write_rate"), " bytes/sec"),
         say("Network connections: ", _shown("num_connections")), F.lit("Simultaneous disk and network activity")],
        [say("Extremely high I/O write rate: ", _shown("io_write_rate"), " bytes/sec"),
         say("Open file descriptors: ", _shown("num_fds")), F.lit("Mass file access pattern")],
        [say("Active connections: ", _shown("num_connections")), F.lit("Unusual network behavior")],
        [say("Memory usage: ", _shown("mem", "0.0"), "%"), F.lit("Unusual memory access patterns")],
        [say("Open file descriptors: ", _shown("num_fds")), F.lit("Unclosed file handles")],
        [F.lit("Multiple suspicious metrics triggered")],
    ]
    choice = F.array(*texts[-1])
    for (name, *_), lines in zip(ATTACKS[:-1], texts):
        choice = F.when(F.col("attack_type") == name, F.array(*lines)).otherwise(choice)
    return choice


def explain_alerts(df: DataFrame, features: list[str], importances: dict[str, float] | None = None) -> DataFrame:
    """Suspicious metrics, attack type, indicators and advice for alerted rows."""
    named = classify_attack(df.withColumn("suspicious_metrics", top_metrics(features, importances)))
    return attack_lookup(named.withColumn("indicators", indicators()))
