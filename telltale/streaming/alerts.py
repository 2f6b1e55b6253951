"""Scoring live rows, alerting once per process, and writing alerts."""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from telltale.functions.scalars import confidence_band
from telltale.operators import rules
from telltale.operators.attack import explain_alerts
from telltale.operators.learning import score_rows
from telltale.streaming.features import live_features
from telltale.session import ROCKSDB_PROVIDER
from telltale.sources.logs import BATCH_BYTES
from telltale.streaming.history import HISTORIES, PROCESS, SHARD, live_history, sharded

# Ship the processor itself to workers that do not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

THRESHOLD = 0.7  # fixed value: default alert probability
KEYS = ("session_id", "pid")


def rule_scorer(io_threshold: float) -> Callable[[DataFrame], DataFrame]:
    """Probability from the weighted rules with a threshold fitted before."""
    def score(df: DataFrame) -> DataFrame:
        limit = F.lit(float(io_threshold))
        return rules.predictions(df.withColumn("score", rules.score_expression(limit)))
    return score


def model_scorer(model: PipelineModel) -> Callable[[DataFrame], DataFrame]:
    """Probability of a fitted pipeline, on a stream or a table; features it knows and the rows lack count as 0."""
    def score(df: DataFrame) -> DataFrame:
        return score_rows(df, model, "probability")
    return score


def threshold_alerts(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored.where(F.col("probability") >= threshold)


def first_alerts(candidates: DataFrame, keys=KEYS) -> DataFrame:
    """The earliest candidate of each process (one pre-aggregated row per process)."""
    row = F.struct(*[F.col(c) for c in candidates.columns])
    return candidates.groupBy(*keys).agg(F.min_by(row, F.struct("timestamp", "seq")).alias("_r")).select("_r.*")


class FirstAlert(StatefulProcessor):
    """Hands on the first candidate of a process by time, then none until ``horizon_us`` have passed (never, if None).

    A key stands for many processes, each with its entry in the state.
    """

    def __init__(self, columns: list[str], horizon_us: int | None):
        self.columns, self.horizon_us = columns, horizon_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.alerted = handle.getMapState("alerted_us", "process string", "at long")

    def handleInputRows(self, key, rows, timerValues):
        batch = self._by_time(list(rows) if self.horizon_us is not None else [self._by_time([f]) for f in rows])
        stamps = batch["timestamp"].astype("datetime64[us]").astype("int64").tolist()
        before, changed, chosen = {}, {}, []
        for i, (process, at) in enumerate(zip(batch[PROCESS].tolist(), stamps)):
            if process not in before:
                known = self.alerted.getValue((process,))
                before[process] = None if known is None else known[0]
            last = before[process]
            if last is None or (self.horizon_us is not None and at >= last + self.horizon_us):
                chosen.append(i)
                before[process] = changed[process] = at
        for process, at in changed.items():
            self.alerted.updateValue((process,), (at,))
        if chosen:
            yield batch.loc[chosen, self.columns]

    def _by_time(self, frames: list[pd.DataFrame]) -> pd.DataFrame:
        """Rows in order of time; without a horizon only the first of a process can alert."""
        rows = pd.concat(frames, ignore_index=True).sort_values(["timestamp", "seq"], ignore_index=True)
        return rows if self.horizon_us is not None else rows.drop_duplicates(PROCESS, ignore_index=True)

    def close(self) -> None:
        pass


def alert_once(candidates: DataFrame, keys=KEYS, horizon_seconds: float | None = None) -> DataFrame:
    """Streaming form: one alert per process ever, or one per ``horizon_seconds`` of event time.

    State is one time per process alerted. Within a micro-batch the earliest row alerts.
    """
    candidates.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    horizon = None if horizon_seconds is None else int(horizon_seconds * 1e6)
    return sharded(candidates, keys).groupBy(SHARD).transformWithStateInPandas(
        FirstAlert(candidates.columns, horizon), candidates.schema, "Append", "None")


def alert_rows(alerts: DataFrame, features: list[str], importances: dict[str, float] | None = None) -> DataFrame:
    """Identity, score, suspicious metrics and the likely attack of alerted rows. Features that the rows lack are 0 to a
    model and never suspicious."""
    told = explain_alerts(alerts, [f for f in features if f in alerts.columns], importances)
    return told.select(*KEYS, "ppid", "exe", "seq", "timestamp", F.col("probability").alias("anomaly_score"),
                       confidence_band(F.col("probability")).alias("confidence_band"), "suspicious_metrics",
                       F.struct(F.col("attack_type").alias("type"), "confidence", "description", "indicators",
                                "recommendations").alias("attack"))


def alert_totals(alerts: DataFrame) -> DataFrame:
    """Processes alerted."""
    return alerts.select(*KEYS).distinct().agg(F.count(F.lit(1)).alias("alerted_processes"))


@dataclass
class LiveDetector:
    """Stream of snapshots → live features → scores → alert table.

    Two queries. The first writes each micro-batch's scored rows under its batch number, replacing a
    previous attempt of the same batch, and rows that came too late to a table of their own. The second
    reads the scored table as a stream and keeps in its state which processes have alerted, so no
    alert is read again, lost or repeated.
    """

    score: Callable[[DataFrame], DataFrame]
    output: str
    features: list[str]
    importances: dict[str, float] | None = None
    threshold: float = THRESHOLD
    late_seconds: float = 600
    idle_seconds: float | None = None
    horizon_seconds: float | None = None
    keep_history: bool = False
    state_partitions: int | None = None  # fixed for the life of a checkpoint; default: shuffle partitions
    keys: tuple[str, ...] = field(default=KEYS)

    @property
    def feature_path(self) -> str:
        return f"{self.output}/features"

    @property
    def late_path(self) -> str:
        return f"{self.output}/late"

    @property
    def alert_path(self) -> str:
        return f"{self.output}/alerts"

    def start(self, stream: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """Score what has landed once, or every ``every`` (e.g. '2 seconds')."""
        rows = self.score(live_features(live_history(stream, self.late_seconds, self.idle_seconds), self.keep_history))
        return self._run(rows.writeStream.foreachBatch(self._write), f"{checkpoint}/rows", every)

    def start_alerts(self, spark: SparkSession, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """Turn scored rows into alerts; to be started once the first rows are written."""
        schema = spark.read.parquet(self.feature_path).schema
        scored = spark.readStream.schema(schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(self.feature_path)
        alerts = alert_once(threshold_alerts(scored, self.threshold).drop(*HISTORIES), self.keys, self.horizon_seconds)
        return self._run(alerts.writeStream.foreachBatch(self._sink), f"{checkpoint}/alerts", every)

    def _run(self, writer, checkpoint: str, every: str | None) -> StreamingQuery:
        conf, name = self._session().conf, "spark.sql.shuffle.partitions"
        before = conf.get(name)
        writer = writer.option("checkpointLocation", checkpoint)
        writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
        conf.set(name, str(self.state_partitions or before))
        try:
            return writer.start()  # the query keeps the settings it starts with
        finally:
            conf.set(name, before)

    @staticmethod
    def _session() -> SparkSession:
        return SparkSession.getActiveSession()

    def _write(self, batch: DataFrame, number: int) -> None:
        # every batch leaves a file in both tables, so their schemas can always be read
        batch.persist()
        batch.where(~F.col("late")).drop("late").write.mode("overwrite").parquet(f"{self.feature_path}/batch={number}")
        batch.where(F.col("late")).drop("late").write.mode("overwrite").parquet(f"{self.late_path}/batch={number}")
        batch.unpersist()

    def _sink(self, new: DataFrame, number: int) -> None:
        sink_alerts(new, self, number)

    def feature_table(self, spark) -> DataFrame:
        return spark.read.parquet(self.feature_path)

    def late_table(self, spark) -> DataFrame:
        return spark.read.parquet(self.late_path)

    def alert_table(self, spark) -> DataFrame:
        return spark.read.parquet(self.alert_path)


def sink_alerts(new: DataFrame, detector: LiveDetector, number: int) -> None:
    """Write a batch's alerts under its number; a repeated batch replaces itself."""
    told = alert_rows(new, detector.features, detector.importances)
    told.write.mode("overwrite").parquet(f"{detector.alert_path}/batch={number}")
