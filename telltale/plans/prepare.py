"""From raw snapshots and an event log to a labeled, feature-complete dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telltale.functions.scalars import clean, coerce_metrics
from telltale.operators import sampling
from telltale.operators.features import (base_features, percentile_rank, series_for_features,
                                         temporal_features)
from telltale.operators.labeling import label_windows, pair_periods
from telltale.operators.ordering import global_jump
from telltale.operators.stats import add_process_stats
from telltale.operators.tree import parent_normalize
from telltale.schemas import ENGINEERED, METRICS


def prepare_dataset(stream: DataFrame, events: DataFrame, buffer_seconds: float = 2,
                    keys=("session_id", "pid"), nesting: str = "flat") -> DataFrame:
    """Raw columns, ``label`` and the 48 engineered columns.

    Labels do not depend on features, so they are joined last: size checks then only ever read
    the raw stream.
    """
    periods = pair_periods(events, stream, nesting)
    return label_windows(engineer(stream, keys), periods, buffer_seconds)


def engineer(stream: DataFrame, keys=("session_id", "pid")) -> DataFrame:
    ready = coerce_metrics(stream)
    s = base_features(series_for_features(ready, keys))
    out = parent_normalize(s.done(), keys)
    raw = [c for c in stream.columns if c not in METRICS]
    return clean(out.select(*raw, *METRICS, *ENGINEERED))


def training_features(dataset: DataFrame, keys=("session_id", "pid")) -> DataFrame:
    """The extra temporal and per-process columns a training run adds."""
    s = temporal_features(series_for_features(percentile_rank(dataset, keys), keys))
    before = list(s.cold.columns)
    out = global_jump(add_process_stats(s))  # one layout for both
    names = [c for c in before if c in out.columns]
    names += [c for c in ("cpu_jump", "mem_jump") if c not in names]
    return clean(out.select(*names, *[c for c in out.columns if c not in names]))


def combine_sessions(sessions: DataFrame | list[DataFrame], balance: bool = False, fraction: float | None = None,
                     seed=42, id_column: str = "seq") -> DataFrame:
    """Sessions as one table: optionally balanced and sampled, cleaned, in time order."""
    out = sessions if isinstance(sessions, DataFrame) else sampling.union_sessions(sessions)
    if balance:
        out = sampling.balance_classes(out, seed, id_column)
    if fraction is not None:
        out = sampling.sample_fraction(out, fraction, f"{seed}s", id_column)
    return clean(out).orderBy(F.col("timestamp"))
