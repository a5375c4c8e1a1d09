"""Event clusters over live or stored frames: one state machine, run as a batch fold or as a stateful stream.

A trigger opens or extends a cluster of frames around it. A cluster closes when a frame lies beyond its end, or when
it has lasted as long as a chunk may; what it holds of the buffered frames is a chunk. Clusters may overlap, as
a new one reaches back before its trigger.
"""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from watchloom.operators.folds import fold

log = logging.getLogger(__name__)

CHUNK = "stream_id bigint, chunk_index int, start_frame bigint, end_frame bigint, frame_count bigint, last_class int, last_confidence double"


@dataclass(frozen=True)
class ClusterSettings:
    fps: float = 25.0
    seconds: float = 2.0
    stride: int = 4
    conf_delta: float = 0.15
    night: bool = False

    @property
    def frames_per_chunk(self) -> int:
        return max(1, int(round(self.fps * self.seconds)))

    @property
    def half(self) -> int:
        return max(1, self.frames_per_chunk // 2)

    @property
    def capacity(self) -> int:
        return int(self.fps * self.seconds * 2.5) + 100


@dataclass
class Cluster:
    """State of one stream; plain values only, so that it can be stored."""

    last: list | None = None
    quiet: list | None = None
    start: int | None = None
    end: int | None = None
    chunks: int = 0
    frames: list[int] = field(default_factory=list)

    def step(self, s: ClusterSettings, frame: int, class_id: int, confidence: float, motion: bool = False) -> Iterator[tuple]:
        """Takes a frame, yields the chunk that it closes."""
        self.frames.append(frame)
        del self.frames[: -s.capacity]
        if s.night:
            if motion:
                self._extend(s, frame)
        elif frame % s.stride == 0:
            if self._triggers(s, class_id, confidence):
                self._extend(s, frame)
            elif self.start is None:
                self.quiet = [class_id, confidence]
            self.last = [class_id, confidence]
        if self.start is not None and (frame - self.start >= s.frames_per_chunk or frame > self.end):
            yield from self.flush()

    def _triggers(self, s: ClusterSettings, class_id: int, confidence: float) -> bool:
        if self.last is None or class_id != self.last[0]:
            return True
        moved = abs(confidence - self.last[1])
        return max(moved, abs(confidence - self.quiet[1]) if self.quiet else moved) > s.conf_delta

    def _extend(self, s: ClusterSettings, frame: int) -> None:
        a, b = max(0, frame - s.half), frame + s.half
        self.start = a if self.start is None else min(self.start, a)
        self.end = b if self.end is None else max(self.end, b)

    def flush(self, until: int | None = None) -> Iterator[tuple]:
        if self.start is None:
            return
        end = self.end if until is None else until
        n = sum(self.start <= f <= end for f in self.frames)
        if n:
            yield (self.chunks, self.start, end, n, *(self.last or (None, None)))
            self.chunks += 1
        self.start = self.end = None


def _rows(stream, chunks: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(stream, *c) for c in chunks], columns=[c.split()[0] for c in CHUNK.split(", ")])


def event_clusters(frames: DataFrame, s: ClusterSettings) -> DataFrame:
    """Chunks of stored frames (stream_id, frame_index, class_id, confidence[, motion]); the open cluster ends with the stream."""
    columns = ["stream_id", "frame_index", "class_id", "confidence", *(["motion"] if "motion" in frames.columns else [])]

    return fold(frames.select(F.col("stream_id").cast("long").alias("stream_id"), *columns[1:]), "stream_id", ["frame_index"], lambda: _Stored(s), CHUNK)


class _Stored:
    """Feeds the state machine from batches of one stream's frames."""

    def __init__(self, settings: ClusterSettings):
        self.settings, self.cluster, self.stream, self.last = settings, Cluster(), None, None

    def step(self, part: pa.RecordBatch) -> dict | None:
        columns = [part.column(c).to_pylist() for c in ("frame_index", "class_id", "confidence")]
        motion = part.column("motion").to_pylist() if "motion" in part.schema.names else [False] * part.num_rows
        self.stream, self.last, out = part.column("stream_id")[0].as_py(), columns[0][-1], []
        for frame, class_id, confidence, moves in zip(*columns, motion):
            out += self.cluster.step(self.settings, frame, class_id, confidence, moves)
        return self._columns(out)

    def finish(self) -> dict | None:
        return self._columns(list(self.cluster.flush(until=self.last)))

    def _columns(self, chunks: list[tuple]) -> dict | None:
        if not chunks:
            return None
        stream, index, start, end, n, class_id, confidence = zip(*[(self.stream, *c) for c in chunks])
        return {
            "stream_id": pa.array(stream, pa.int64()),
            "chunk_index": pa.array(index, pa.int32()),
            "start_frame": pa.array(start, pa.int64()),
            "end_frame": pa.array(end, pa.int64()),
            "frame_count": pa.array(n, pa.int64()),
            "last_class": pa.array(class_id, pa.int32()),
            "last_confidence": pa.array(confidence, pa.float64()),
        }


class ClusterProcessor(StatefulProcessor):
    """Streaming form. A row whose ``final`` is true ends its stream: the open cluster is flushed up to that frame."""

    def __init__(self, settings: ClusterSettings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("cluster", "value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        c, out = Cluster(**json.loads(held[0])) if held is not None else Cluster(), []
        for pdf in [pd.concat(list(rows)).sort_values("frame_index")]:
            for r in pdf.itertuples():
                out += c.step(self.settings, int(r.frame_index), int(r.class_id), float(r.confidence), bool(getattr(r, "motion", False)))
                if getattr(r, "final", False):
                    out += c.flush(until=int(r.frame_index))
        self.state.update((json.dumps(asdict(c)),))
        yield _rows(key[0], out)

    def close(self) -> None:
        pass


def event_clusters_stream(frames: DataFrame, s: ClusterSettings) -> DataFrame:
    """Chunks of a streaming DataFrame of frames, emitted as they close; needs the RocksDB state store.

    Arrival order is time within a stream: rows of one micro-batch are put in frame order, frames are not awaited.
    """
    return frames.groupBy("stream_id").transformWithStateInPandas(ClusterProcessor(s), outputStructType=CHUNK, outputMode="append", timeMode="none")


ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def tumbling_chunks(frames: DataFrame, seconds: int, late: str = "10 seconds") -> DataFrame:
    """Event-time chunks for streams with timestamps: counts and bounds per window; later rows than the watermark are dropped."""
    w = F.window("ts", f"{seconds} seconds")
    return frames.withWatermark("ts", late).groupBy("stream_id", w).agg(F.count(F.lit(1)).alias("frame_count"), F.min("frame_index").alias("first"), F.max("frame_index").alias("last"))


def kept_alive(start: Callable[[], StreamingQuery], wait: float = 2.0, failures: int | None = None) -> int:
    """Runs a stream until it ends, starting it anew from its checkpoint after each failure; how often it failed.

    With failures given, one more than that many is raised.
    """
    failed = 0
    while True:
        try:
            start().awaitTermination()
            return failed
        except StreamingQueryException:
            failed += 1
            if failures is not None and failed > failures:
                raise
            log.exception("stream failed; starting anew in %s s", wait)
            time.sleep(wait)
