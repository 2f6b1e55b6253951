"""Anomaly periods from an event log, and labels from periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telltale.functions.scalars import is_anomaly_event
from telltale.operators.blocks import Series
from telltale.session import materialized

BUCKET_SECONDS = 60


def boundary_events(events: DataFrame) -> DataFrame:
    """Anomaly starts and ends only; 'start' wins when a name holds both words."""
    name = F.lower("event_type")
    kind = F.when(name.contains("start"), "start").when(name.contains("end"), "end")
    return (events.where(is_anomaly_event(F.col("event_type"))).withColumn("kind", kind)
            .where(F.col("kind").isNotNull()).select("session_id", "seq", "timestamp", "kind"))


def _with_previous(kept: DataFrame) -> DataFrame:
    s = Series(kept, ("session_id",), ("seq",), halo=1)
    s.add(**{f"prev_{c}": F.lag(c).over(s.w) for c in ("kind", "timestamp", "seq")})
    return s.done()


def _open_at_end(kept: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("kind", "timestamp", "seq"), "seq").alias("e")
    return (kept.groupBy("session_id").agg(last).where(F.col("e.kind") == "start")
            .select("session_id", F.col("e.timestamp").alias("start_ts"), F.col("e.seq").alias("seq")))


def pair_periods(events: DataFrame, stream: DataFrame, nesting: str = "flat") -> DataFrame:
    """(session_id, start_ts, end_ts) periods, in file order.

    ``flat``: every start runs to the next boundary event of any kind, so nested starts close
    the period before them. ``outer``: a period runs from the first open start to the end that
    closes the last one. A start nothing closes runs to the end of its session's stream.
    """
    kept = boundary_events(events)
    if nesting == "outer":
        kept = _outermost(kept)
    elif nesting != "flat":
        raise ValueError(f"unknown nesting {nesting!r}")
    closed = (_with_previous(kept).where(F.col("prev_kind") == "start")
              .select("session_id", F.col("prev_timestamp").alias("start_ts"), F.col("timestamp").alias("end_ts")))
    stream_end = stream.groupBy("session_id").agg(F.max("timestamp").alias("end_ts"))
    unclosed = _open_at_end(kept).join(stream_end, "session_id").select("session_id", "start_ts", "end_ts")
    return closed.unionByName(unclosed)


def _outermost(kept: DataFrame) -> DataFrame:
    """Keep starts that open from depth 0 and ends that return to it; orphan ends never count."""
    step = F.when(F.col("kind") == "start", 1).otherwise(-1)
    s = Series(kept.withColumn("_d", step), ("session_id",), ("seq",), halo=1)
    s.running(F.sum, _sum=F.col("_d"))
    s.running(F.min, _low=F.least(F.col("_sum"), F.lit(0)))
    s.add(_was=F.coalesce(F.lag("_low").over(s.w), F.lit(0)))
    depth = F.col("_sum") - F.col("_low")
    opens = (F.col("kind") == "start") & (depth == 1)
    closes = (F.col("kind") == "end") & (depth == 0) & (F.col("_low") == F.col("_was"))
    return s.done().where(opens | closes).drop("_d", "_sum", "_low", "_was")


def orphan_events(events: DataFrame) -> DataFrame:
    """Quality report: starts nothing closed, and ends nothing opened."""
    kept = boundary_events(events)
    paired = _with_previous(kept)
    replaced = (paired.where((F.col("kind") == "start") & (F.col("prev_kind") == "start"))
                .select("session_id", F.col("prev_seq").alias("seq"), F.lit("unclosed_start").alias("issue")))
    stray = (paired.where((F.col("kind") == "end") & (F.coalesce("prev_kind", F.lit("end")) == "end"))
             .select("session_id", "seq", F.lit("end_without_start").alias("issue")))
    trailing = _open_at_end(kept).select("session_id", "seq", F.lit("unclosed_start").alias("issue"))
    return replaced.unionByName(stray).unionByName(trailing)


def _buffered(periods: DataFrame, buffer_seconds: float) -> DataFrame:
    edge = int(buffer_seconds * 1_000_000)
    return (periods.where(F.col("start_ts").isNotNull() & F.col("end_ts").isNotNull())
            .withColumn("_lo", F.unix_micros("start_ts") - edge)
            .withColumn("_hi", F.unix_micros("end_ts") + edge).where(F.col("_lo") <= F.col("_hi")))


def _bucket(us: Column, seconds: int) -> Column:
    return F.floor(us / (seconds * 1_000_000)).cast("long")


def _spread(spans: DataFrame, seconds: int) -> DataFrame:
    """One row per time bucket a span touches, so the range test becomes an equi-join."""
    return spans.withColumn("_bucket", F.explode(F.sequence(
        _bucket(F.col("_lo"), seconds), _bucket(F.col("_hi"), seconds))))


def label_windows(stream: DataFrame, periods: DataFrame, buffer_seconds: float = 2,
                  bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """``label`` = 1 inside any buffered period of the row's session (both ends inclusive).

    A range join without size checks: the spans that touch a time bucket become one row, so the join on (session, bucket)
    adds no rows however they overlap, and the exact test is made against the bucket's few spans. That table is
    written once; from the size of its files the planner decides whether it can be broadcast, and beyond that the
    shuffle join splits skewed partitions. The stream is read by the join alone.
    """
    spans = _spread(_buffered(periods, buffer_seconds), bucket_seconds)
    spans = materialized(spans.groupBy("session_id", "_bucket").agg(F.collect_set(F.struct("_lo", "_hi")).alias("_spans")), "spans").alias("p")
    rows = stream.withColumn("_us", F.unix_micros("timestamp")).withColumn("_bucket", _bucket(F.col("_us"), bucket_seconds))
    same = (F.col("s.session_id") == F.col("p.session_id")) & (F.col("s._bucket") == F.col("p._bucket"))
    inside = F.exists("p._spans", lambda x: F.col("s._us").between(x["_lo"], x["_hi"]))
    return rows.alias("s").join(spans, same, "left").select(
        *[F.col(f"s.{c}") for c in stream.columns if c != "label"], F.coalesce(inside, F.lit(False)).cast("int").alias("label"))


def period_summary(stream: DataFrame, periods: DataFrame, buffer_seconds: float = 2,
                   bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Per period: start, end, length and rows inside it (overlapping buffers count twice).

    The periods are written once; the stream is aggregated per session and instant before it meets them.
    """
    periods = materialized(periods, "periods")
    spans = _spread(_buffered(periods, buffer_seconds), bucket_seconds)
    ticks = (stream.groupBy("session_id", F.unix_micros("timestamp").alias("_us")).agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_bucket", _bucket(F.col("_us"), bucket_seconds)))
    inside = (ticks.alias("s").join(
        spans.alias("p"), (F.col("s.session_id") == F.col("p.session_id")) & (F.col("s._bucket") == F.col("p._bucket"))
        & F.col("s._us").between(F.col("p._lo"), F.col("p._hi")))
        .groupBy("p.session_id", "p.start_ts", "p.end_ts").agg(F.sum("_n").alias("rows_labeled")))
    keys = ["session_id", "start_ts", "end_ts"]
    return (periods.join(inside, keys, "left").select(
        *keys, ((F.unix_micros("end_ts") - F.unix_micros("start_ts")) / 1e6).alias("seconds"),
        F.coalesce("rows_labeled", F.lit(0)).alias("rows_labeled")))


def period_totals(stream: DataFrame, periods: DataFrame, buffer_seconds: float = 2) -> DataFrame:
    """Number of periods, rows counted once per period, and rows actually labeled."""
    periods = materialized(periods, "periods")
    per = period_summary(stream, periods, buffer_seconds).agg(
        F.count(F.lit(1)).alias("periods"), F.coalesce(F.sum("rows_labeled"), F.lit(0)).alias("rows_with_overlaps"))
    once = label_windows(stream, periods, buffer_seconds).agg(
        F.coalesce(F.sum("label"), F.lit(0)).alias("rows_labeled"), F.count(F.lit(1)).alias("rows_total"))
    return per.join(F.broadcast(once))  # two one-row tables
