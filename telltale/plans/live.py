"""Live detection over landed snapshot files, and its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telltale.operators.learning import feature_names, importances
from telltale.session import scratch_path
from telltale.sources.logs import BATCH_BYTES, stream_process_snapshots
from telltale.sources.sinks import load_model
from telltale.streaming.alerts import LiveDetector, alert_rows, first_alerts, model_scorer, threshold_alerts
from telltale.streaming.features import live_features
from telltale.streaming.history import batch_history


def land(df: DataFrame, path: str, files: int = 1) -> None:
    """Add snapshots to a landing folder the way an agent would: new files, older data first.

    Files hold consecutive ranges of time and get times of modification in that order, which is the
    order in which a file stream reads them.
    """
    spark = df.sparkSession
    staging = scratch_path(spark, "staging")
    df.repartitionByRange(files, "timestamp").sortWithinPartitions("timestamp").write.parquet(staging)
    fs = spark._jvm.org.apache.hadoop.fs
    folder, target = fs.Path(staging), fs.Path(path)
    files_ = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files_.mkdirs(target)
    parts = sorted((f.getPath() for f in files_.listStatus(folder) if f.getPath().getName().startswith("part-")),
                   key=lambda p: p.getName())
    newest = max((f.getModificationTime() for f in files_.listStatus(target)), default=0)
    start = max(newest + 1, spark._jvm.System.currentTimeMillis())
    for i, part in enumerate(parts):
        files_.setTimes(part, start + i, -1)
        files_.rename(part, fs.Path(f"{path}/{part.getName()}"))


def replay(spark: SparkSession, stream: DataFrame, slices: list[DataFrame], detector: LiveDetector, files: int = 1,
           batch_bytes: int = BATCH_BYTES) -> LiveDetector:
    """Land slices one after the other and let the detector catch up after each.

    Every run stops and resumes from the checkpoint, so state survives between them.
    """
    landing, checkpoint = scratch_path(spark, "landing"), scratch_path(spark, "stream-checkpoint")
    for part in slices:
        land(part, landing, files)
        source = stream_process_snapshots(spark, landing, "parquet", batch_bytes, stream.schema)
        detector.start(source, checkpoint).awaitTermination()
        detector.start_alerts(spark, checkpoint).awaitTermination()
    return detector


def stored_model_detector(path: str, output: str, **settings) -> LiveDetector:
    """Live detection by a stored model: its probability raises alerts, its features and their importances explain them."""
    model = load_model(path)
    return LiveDetector(model_scorer(model), output, feature_names(model), importances(model), **settings)


def batch_alerts(df: DataFrame, detector: LiveDetector) -> DataFrame:
    """The alerts that a detector without a horizon should have raised, from a table."""
    candidates = threshold_alerts(batch_twin(df, detector.score), detector.threshold)
    return alert_rows(first_alerts(candidates, detector.keys), detector.features, detector.importances)


def batch_twin(df: DataFrame, score) -> DataFrame:
    """What the stream should have produced, from a table."""
    return score(live_features(batch_history(df))).drop("late")


def time_slices(df: DataFrame, n: int) -> list[DataFrame]:
    """``n`` consecutive slices of equal length in time."""
    low, high = df.agg(F.min(F.unix_micros("timestamp")), F.max(F.unix_micros("timestamp"))).first()
    if low is None:
        return [df]
    at = F.least(F.floor((F.unix_micros("timestamp") - F.lit(low)) * F.lit(n) / F.lit(high - low + 1)).cast("int"), F.lit(n - 1))
    return [df.where(at == i) for i in range(n)]
