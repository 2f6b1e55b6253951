"""Per-process history of the last samples, as streaming state and as its batch twin.

Both return the input rows with ``held`` (samples in the buffer, this one included), ``first_seen``,
``prev_*`` (the sample before) and ``*_hist`` arrays, oldest first. All live features are then
plain column expressions over these, so stream and batch share them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from telltale.operators.blocks import process_series
from telltale.session import ROCKSDB_PROVIDER

# Ship the processor itself to workers that do not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HELD = 20  # fixed value: samples kept per process
SLICE = 4096  # rows whose histories are handed on at once
DEEP = 65_536  # rows of a key and micro-batch that are put in order at once
HISTORIES = {"cpu_hist": "cpu", "mem_hist": "mem", "io_hist": "io_write_bytes"}
PREVIOUS = ["cpu", "mem", "num_children", "io_read_bytes", "io_write_bytes", "io_read_count", "io_write_count",
            "num_connections", "num_threads", "num_fds", "ctx_switches_voluntary", "ctx_switches_involuntary"]
NUMBER = T.DoubleType()

NOTHING = np.zeros((0, len(HISTORIES)))
KEPT = "first_us long, last_us long, line binary"  # line: the last row's PREVIOUS, then the samples held, as doubles
PROCESS, SHARD = "process_name", "process_shard"  # pandas state functions lose names that begin with a line
SHARDS = 512  # fixed for the life of a checkpoint

PASSED = ["seq", "timestamp", "ppid", "exe", "status", "child_entropy", *PREVIOUS]


def output_schema() -> T.StructType:
    kinds = {"seq": T.LongType(), "timestamp": T.TimestampType(), "ppid": T.LongType(), "exe": T.StringType(), "status": T.StringType()}
    return T.StructType(
        [T.StructField("session_id", T.StringType()), T.StructField("pid", T.LongType())]
        + [T.StructField(c, kinds.get(c, NUMBER)) for c in PASSED]
        + [T.StructField("held", T.IntegerType()), T.StructField("first_us", T.LongType()), T.StructField("late", T.BooleanType())]
        + [T.StructField(f"prev_{c}", NUMBER) for c in PREVIOUS]
        + [T.StructField(h, T.ArrayType(NUMBER)) for h in HISTORIES])


def _micros(rows: pd.DataFrame) -> np.ndarray:
    return rows["timestamp"].astype("datetime64[us]").astype("int64").to_numpy()


def _ordered(frames: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(frames, ignore_index=True).sort_values(["timestamp", "seq"], ignore_index=True)


def _packed(rows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


@dataclass(slots=True)
class Buffer:
    """What is known of a process while a micro-batch is taken: what is kept, and from when on its rows are late."""

    first: int
    newest: int | None
    limit: int
    before: int | None
    prev: np.ndarray | None
    old: np.ndarray

    @classmethod
    def of(cls, kept: tuple | None, at: int, late_us: int) -> Buffer:
        if kept is None:
            return cls(at, None, at - late_us, None, None, NOTHING)
        first, newest, line = kept
        line = np.frombuffer(line)
        prev, old = line[:len(PREVIOUS)], line[len(PREVIOUS):].reshape(-1, len(HISTORIES))
        return cls(first, newest, newest - late_us, newest, prev, old)

    def kept(self) -> tuple[int, int, bytes]:
        return self.first, self.newest, self.prev.tobytes() + self.old.tobytes()


class HistoryProcessor(StatefulProcessor):
    """Keeps one small buffer per process; rows of a micro-batch are taken in time order.

    A row more than ``late_us`` older than the newest one its process has shown is handed on marked
    late, with no history, and leaves the buffer as it is. Up to ``deep`` rows of a key are laid out
    at once. The micro-batch of a hotter one is cut into pieces of time, which wait in state until all
    of its rows have come; then piece follows piece, each with the tail of the one before.
    """

    def __init__(self, late_us: int, idle_seconds: float | None = None, deep: int = DEEP):
        self.late_us = late_us
        self.idle_us = np.inf if idle_seconds is None else idle_seconds * 1e6
        self.deep = deep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buffer = handle.getValueState("buffer", KEPT)
        self.waiting = handle.getMapState("waiting", "piece long, part int", "rows binary")

    def _members(self, rows: pd.DataFrame) -> tuple[np.ndarray, list]:
        """Per row the number of its process, and the processes: here a key is one."""
        return np.zeros(len(rows), np.int64), [None]

    def _identity(self, key, rows: pd.DataFrame) -> tuple:
        return key

    def _known(self, process) -> tuple | None:
        return self.buffer.get() if self.buffer.exists() else None

    def _keep(self, process, kept: tuple) -> None:
        self.buffer.update(kept)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen: dict[object, Buffer] = {}  # of the processes that this micro-batch touches
        for piece in self._in_time_order(rows):
            yield from self._laid_out(key, piece, seen)
        for process, buffer in seen.items():
            self._keep(process, buffer.kept())

    def _laid_out(self, key, rows: pd.DataFrame, seen: dict[object, Buffer]) -> Iterator[pd.DataFrame]:
        """Rows in time order with their histories, of all processes of a piece at once."""
        code, processes = self._members(rows)
        order = np.argsort(code, kind="stable")
        rows, code = rows.iloc[order].reset_index(drop=True), code[order]
        stamps = _micros(rows)
        buffers = []
        for process, at in zip(processes, stamps[np.searchsorted(code, np.arange(len(processes)))].tolist()):
            if process not in seen:
                seen[process] = Buffer.of(self._known(process), at, self.late_us)
            buffers.append(seen[process])
        late = stamps < np.array([b.limit for b in buffers])[code]
        if late.any():
            first = np.array([b.first for b in buffers])[code[late]]
            yield from self._sliced(key, rows[late].reset_index(drop=True), first, np.zeros(len(first), int), None, None, True)
            rows, code, stamps = rows[~late].reset_index(drop=True), code[~late], stamps[~late]
        if not len(rows):
            return
        heads = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        tails = np.r_[heads[1:], len(code)] - 1
        owners = [buffers[c] for c in code[heads]]
        # a silence of idle_us ends a process: what follows starts with an empty buffer
        before = np.r_[stamps[:1], stamps[:-1]]
        before[heads] = [at if b.before is None else b.before for b, at in zip(owners, stamps[heads].tolist())]
        begins = stamps - before > self.idle_us
        starts = begins.copy()
        starts[heads] = True
        runs, run = np.flatnonzero(starts), np.cumsum(starts) - 1
        first, past, prev = stamps[runs], [NOTHING] * len(runs), np.full((len(runs), len(PREVIOUS)), np.nan)
        for at, i, b in zip(heads, run[heads], owners):
            if not begins[at]:
                first[i], past[i] = b.first, b.old
                if b.prev is not None:
                    prev[i] = b.prev
        # each run in a line of its own: the samples held before it, then its rows
        held = np.array([len(o) for o in past])
        place = np.arange(len(rows)) + np.cumsum(held)[run]
        values = rows[PREVIOUS].to_numpy(float)
        line = np.empty((len(rows) + held.sum(), len(HISTORIES)))
        line[place] = values[:, [PREVIOUS.index(c) for c in HISTORIES.values()]]
        older = np.ones(len(line), bool)
        older[place] = False
        line[older] = np.concatenate(past)
        held = np.minimum(held[run] + np.arange(len(rows)) - runs[run] + 1, HELD)
        rows_before = np.vstack([values[:1], values[:-1]])
        rows_before[runs] = prev
        first = first[run]
        yield from self._sliced(key, rows, first, held, rows_before, (line, place), False)
        for b, at in zip(owners, tails):
            b.first, b.before, b.prev = int(first[at]), int(stamps[at]), values[at].copy()
            b.old = line[place[at] + 1 - held[at]:place[at] + 1].copy()
            b.newest = b.before if b.newest is None else max(b.before, b.newest)

    def _sliced(self, key, rows, first, held, before, lines, late) -> Iterator[pd.DataFrame]:
        """Frames of bounded size: histories take far more room than rows."""
        for at in range(0, len(rows), SLICE):
            some = slice(at, at + SLICE)
            part, hists = rows.iloc[some].reset_index(drop=True), [None] * len(HISTORIES)
            if lines is not None:
                line, ends = lines[0], (lines[1][some] + 1).tolist()
                hists = [[c[e - n:e] for e, n in zip(ends, held[some].tolist())] for c in np.ascontiguousarray(line.T)]
            yield self._framed(self._identity(key, part), part, first[some], held[some], None if before is None else before[some], hists, late)

    def _in_time_order(self, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """All rows in order of (timestamp, seq), as one frame or, of a hot key, as pieces."""
        frames, count = [], 0
        for frame in rows:
            frames.append(frame)
            count += len(frame)
            if count > self.deep:
                return self._cut(frames, rows)
        return iter([_ordered(frames)])

    def _cut(self, frames: list[pd.DataFrame], rest: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pieces as long as the time in which half of ``deep`` of the rows at hand fell; deeper ones are cut again."""
        stamps = np.sort(np.concatenate([_micros(f) for f in frames]))
        span = max(int(stamps[-1] - stamps[0]) * (self.deep // 2) // len(stamps), 1)
        places: dict[int, list[tuple[int, int]]] = {}
        for frame in chain(frames, rest):
            self._wait(frame, _micros(frame) // span, places)
        return self._pieces(places, span)

    def _wait(self, frame: pd.DataFrame, piece: np.ndarray, places: dict[int, list[tuple[int, int]]]) -> None:
        for at in np.unique(piece):
            some = frame[piece == at]
            parts = places.setdefault(int(at), [])
            # a part number is never used twice, also when a piece is cut again under the same piece number
            self.parts = getattr(self, "parts", 0) + 1
            parts.append((self.parts, len(some)))
            self.waiting.updateValue((int(at), self.parts), (_packed(some),))

    def _pieces(self, places: dict[int, list[tuple[int, int]]], span: int) -> Iterator[pd.DataFrame]:
        for at in sorted(places):
            frames = self._taken(at, places[at])
            if span > 1 and sum(n for _, n in places[at]) > self.deep:
                finer, inner = max(span // 16, 1), {}
                for frame in frames:
                    self._wait(frame, _micros(frame) // finer, inner)
                yield from self._pieces(inner, finer)
            else:
                yield _ordered(list(frames))

    def _taken(self, at: int, parts: list[tuple[int, int]]) -> Iterator[pd.DataFrame]:
        for part, _ in parts:
            rows = _unpacked(self.waiting.getValue((at, part))[0])
            self.waiting.removeKey((at, part))
            yield rows

    @staticmethod
    def _framed(key, part, first, held, before, hists, late) -> pd.DataFrame:
        out = part[PASSED].copy()
        out.insert(0, "pid", key[1])
        out.insert(0, "session_id", key[0])
        out[[f"prev_{c}" for c in PREVIOUS]] = np.nan if before is None else before
        out["held"], out["first_us"], out["late"] = np.int32(0) + held, first, late
        for name, lists in zip(HISTORIES, hists):
            out[name] = pd.Series([[]] * len(out) if lists is None else lists, index=out.index, dtype=object)
        return out[output_schema().fieldNames()]

    def close(self) -> None:
        pass


class HistoriesProcessor(HistoryProcessor):
    """The same for a key that stands for many processes, each with its entry in the state: what a key costs is paid once
    for all of them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.buffers = handle.getMapState("buffers", "process string", KEPT)

    def _members(self, rows: pd.DataFrame) -> tuple[np.ndarray, list]:
        code, processes = pd.factorize(rows[PROCESS])
        return code, list(processes)

    def _identity(self, key, rows: pd.DataFrame) -> tuple:
        return rows["session_id"].to_numpy(), rows["pid"].to_numpy()

    def _known(self, process) -> tuple | None:
        return self.buffers.getValue((process,))

    def _keep(self, process, kept: tuple) -> None:
        self.buffers.updateValue((process,), kept)


def sharded(df: DataFrame, keys) -> DataFrame:
    """Rows with the name of their process, nulls told from values, and the shard that it belongs to."""
    return df.withColumns({PROCESS: F.to_json(F.struct(*keys)), SHARD: F.pmod(F.xxhash64(*keys), F.lit(SHARDS)).cast("int")})


def _ready(df: DataFrame) -> DataFrame:
    entropy = F.coalesce(F.col("child_entropy").cast("double"), F.lit(0.0)) if "child_entropy" in df.columns else F.lit(0.0)
    return df.select("session_id", "pid", "seq", "timestamp", "ppid", "exe", "status", entropy.alias("child_entropy"),
                     *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in PREVIOUS])


def live_history(stream: DataFrame, late_seconds: float = 600, idle_seconds: float | None = None, deep: int = DEEP) -> DataFrame:
    """The stream with each row's history. No row is dropped: late ones come out with ``late`` set.

    State is one buffer of 20 samples per process seen; processes are dealt over ``SHARDS`` keys, so that many are laid out
    by one call. With ``idle_seconds``, a process that returns
    after a silence of that length (in event time) starts anew, as a reused process id does. A key
    with more than ``deep`` rows in a micro-batch is taken in pieces of time; rows of one microsecond stay together.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    return (sharded(_ready(stream), ("session_id", "pid")).groupBy(SHARD).transformWithStateInPandas(
        HistoriesProcessor(int(late_seconds * 1e6), idle_seconds, deep), output_schema(), "Append", "None"))


def batch_history(df: DataFrame, keys=("session_id", "pid"), limit: int | None = None) -> DataFrame:
    """The same columns for a table, by windows; in a table nothing is late."""
    s = process_series(_ready(df), keys, halo=HELD, limit=limit)
    s.whole(first_us=F.min(F.unix_micros("timestamp")))
    s.add(held=F.least(s.index, F.lit(HELD)), late=F.lit(False), **{f"prev_{c}": F.lag(c).over(s.w) for c in PREVIOUS},
          **{h: F.collect_list(c).over(s.last(HELD)) for h, c in HISTORIES.items()})
    return s.done()
