"""The stored-stream pipeline: route by view mode, keep frames, cut chunks, make messages."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.functions import scalars as S
from watchloom.operators import chunks as C
from watchloom.operators import frames as O
from watchloom.plans.settings import RunSettings


@dataclass(frozen=True)
class PipelineResult:
    keep: DataFrame
    dropped: DataFrame
    segments: DataFrame
    summary: DataFrame
    records: DataFrame
    chunks: DataFrame
    messages: DataFrame


#: Frames at a stream's start that never count as motion, and frames under the limits that end it.
WARMUP_FRAMES, CLEAR_FRAMES = 30, 5


def night_keep(frames: DataFrame, pad: int, sensitivity: str, warmup: int = WARMUP_FRAMES, regions: DataFrame | None = None, scale: float = 1.0, size: tuple[int, int] = (1920, 1080)) -> DataFrame:
    """Frames of motion, padded: vote of recent frames, then hysteresis, after the warm-up.

    With regions (of the voted mask) and a ratio column, a frame moves if its ratio and a region reach the sensitivity's limits;
    frames without pixels move if the vote says so.
    """
    p = S.preset(sensitivity)
    a = O.after_warmup(O.lag_difference(frames, "energy", 1), warmup).withColumn("hot", F.col("diff") > p["pixel_threshold"])
    a, over = O.k_of_n(a, "hot", p["temporal_k"], p["temporal_n"]), "confirmed"
    if regions is not None:
        found = O.motion_regions(regions, scale, *size, p["min_region_area"])
        a, over = O.motion_over(a, found, "ratio", p["min_motion_ratio"]), "over"
    a = O.hysteresis(a, over, p["confirm_frames"], CLEAR_FRAMES)
    return O.neighbour_pad(a.where("is_motion").select("stream_id", "frame_index"), O.stream_lengths(frames), pad)


def route(frames: DataFrame, saturation: str, limit: float) -> tuple[DataFrame, DataFrame]:
    """Day and night streams."""
    a = frames.join(O.view_mode(frames, saturation, limit).select("stream_id", "mode"), "stream_id")
    return a.where("mode = 'day'").drop("mode"), a.where("mode = 'night'").drop("mode")


def run(frames: DataFrame, settings: RunSettings, saturation: str | None = None, regions: DataFrame | None = None) -> PipelineResult:
    """All results as lazy DataFrames; streams shuffle on stream_id once per operator that needs their order."""
    s = settings.check()
    day, night = route(frames, saturation, s.night_limit) if saturation else (frames, None)
    spikes = O.suppress_close(O.spikes_raw(day, s.rms_z, s.delta_z), max(1, int(s.fps * 0.5))) if s.audio_spikes else None
    spikes = O.neighbour_pad(spikes, O.stream_lengths(day), s.pad) if spikes is not None else None
    keep = O.keep_frames(day, stride=s.stride, conf_delta=s.conf_delta, pad=s.pad, max_gap=s.max_gap, fps=s.fps, spikes=spikes)
    if night is not None:
        keep = keep.unionByName(night_keep(night, s.pad, s.sensitivity, regions=regions))
    c = C.ChunkSettings(fps=s.fps, source_fps=s.fps, seconds=s.chunk_seconds, site_id=s.site_id, run_id=s.run_id, app_id=s.app_id)
    indexed = C.filtered_index(keep)
    records = C.chunk_frames(C.source_index(indexed, indexed), c)
    chunks = C.chunk_summary(records, c)
    return PipelineResult(keep, O.dropped_frames(frames, keep), O.segments(keep), O.keep_summary(frames, keep), records, chunks, C.chunk_messages(chunks, c))


def timed(phases: dict) -> dict:
    """Runs each phase's action; wall milliseconds by phase, and the slowest one's name."""
    out = {}
    for name, action in phases.items():
        t = time.perf_counter()
        action()
        out[name] = (time.perf_counter() - t) * 1000
    return {"ms": out, "bottleneck": max(out, key=out.get) if out else None}


def soak(action, iterations: int) -> dict:
    """Runs an action again and again; how often, how often it failed, why, and the mean milliseconds of a run."""
    took, failures = [], []
    for i in range(iterations):
        t = time.perf_counter()
        try:
            action()
        except Exception as e:  # a soak goes on after failures and tells them
            failures.append({"iteration": i, "error": f"{type(e).__name__}: {e}"})
        took.append((time.perf_counter() - t) * 1000)
    return {"iterations": iterations, "failures": len(failures), "errors": failures, "mean_ms": sum(took) / len(took) if took else 0.0}
