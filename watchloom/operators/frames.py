"""Operators over ordered frame streams: sampling, triggers, keep sets, spikes and motion.

Frames are rows (stream_id, frame_index, ...). Every operator partitions by stream_id, so streams run in parallel
and a plan of several operators shuffles once. Lag, gap and run rules are window functions; only rules where a
row's outcome hangs on the outcome of the row before it (suppression, background) fold over ordered batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from watchloom.functions import scalars as S
from watchloom.operators.folds import fold


def by() -> WindowSpec:
    """A stream's frames in order."""
    return Window.partitionBy("stream_id").orderBy("frame_index")


def whole() -> WindowSpec:
    return Window.partitionBy("stream_id")


def bind_events(events: DataFrame) -> DataFrame:
    """The events table as frames: a user is a stream, rows in (ts, event_id) order are its frames."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.col("user_id").alias("stream_id"),
        (F.row_number().over(order) - 1).cast("long").alias("frame_index"),
        "ts",
        F.col("value").alias("energy"),
        F.get_json_object("props", "$.k").cast("double").alias("edge"),
        F.col("value").alias("rms"),
        "event_type",
    )


def score_motion(frames: DataFrame) -> DataFrame:
    """Adds class_id, confidence and top_label by the motion-energy rule."""
    a = frames.withColumn("class_id", S.motion_class(F.col("energy"), F.col("edge")))
    return a.withColumn("confidence", S.motion_confidence(F.col("energy"))).withColumn("top_label", S.motion_label(F.col("class_id")))


def sample_stride(frames: DataFrame, stride: int, with_last: bool = True) -> DataFrame:
    """Every stride-th frame, and the last frame of the stream."""
    if not with_last:
        return frames.where(F.col("frame_index") % stride == 0)
    return frames.withColumn("_last", F.max("frame_index").over(whole())).where((F.col("frame_index") % stride == 0) | (F.col("frame_index") == F.col("_last"))).drop("_last")


def prefix_sample(frames: DataFrame, n: int, skip: int = 0) -> DataFrame:
    """The first n frames after skip; live sources skip 5, as their first frames may be broken."""
    return frames.where((F.col("frame_index") >= skip) & (F.col("frame_index") < skip + n)) if skip else frames.where(F.col("frame_index") < n)


def consecutive(predictions: DataFrame) -> DataFrame:
    """Adds the previous prediction's class, confidence and label; the first of a stream has none and goes."""
    a = predictions
    for c in ("class_id", "confidence", "top_label"):
        a = a.withColumn(f"prev_{c}", F.lag(c).over(by()))
    a = a.where("prev_class_id is not null").withColumn("label_changed", F.col("class_id") != F.col("prev_class_id"))
    return a.withColumn("confidence_delta", F.abs(F.col("confidence") - F.col("prev_confidence")))


def action_triggers(predictions: DataFrame, conf_delta: float, fps: float) -> DataFrame:
    """Events where the label changes or the confidence jumps by more than conf_delta."""
    a = consecutive(predictions).where(F.col("label_changed") | (F.col("confidence_delta") > conf_delta))
    return a.select(
        "stream_id",
        "frame_index",
        (F.col("frame_index") / fps).alias("timestamp_sec"),
        F.lit("action_change").alias("event_type"),
        F.greatest("confidence", "confidence_delta").alias("score"),
        S.change_detail(F.col("prev_top_label"), F.col("top_label"), F.col("confidence_delta"), conf_delta, F.col("label_changed")).alias("detail"),
    )


def correlation_timeline(predictions: DataFrame, conf_delta: float, fps: float) -> DataFrame:
    """Per sampled frame how like the one before it is: 1 - |confidence change| within one class, else 0."""
    a = consecutive(predictions)
    score = F.when(F.col("label_changed"), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("confidence_delta"))))
    return a.select(
        "stream_id",
        F.col("frame_index").alias("frame"),
        (F.col("frame_index") / fps).alias("time_sec"),
        score.alias("correlation"),
        (F.col("label_changed") | (F.col("confidence_delta") > conf_delta)).alias("trigger"),
        "label_changed",
        "confidence_delta",
        F.col("prev_top_label").alias("prev_label"),
        F.col("top_label").alias("curr_label"),
        S.change_detail(F.col("prev_top_label"), F.col("top_label"), F.col("confidence_delta"), conf_delta, F.col("label_changed")).alias("detail"),
    )


def stream_lengths(frames: DataFrame) -> DataFrame:
    return frames.groupBy("stream_id").agg(F.count(F.lit(1)).alias("total"))


def neighbour_pad(hits: DataFrame, lengths: DataFrame, pad: int) -> DataFrame:
    """Each hit with pad frames on both sides, within the stream; every frame once."""
    a = hits.join(lengths, "stream_id")
    span = F.sequence(F.greatest(F.lit(0).cast("long"), F.col("frame_index") - pad), F.least(F.col("total") - 1, F.col("frame_index") + pad))
    return a.select("stream_id", F.explode(span).alias("frame_index")).distinct()


def boundary_frames(lengths: DataFrame) -> DataFrame:
    return lengths.select("stream_id", F.explode(F.array(F.lit(0).cast("long"), F.col("total") - 1)).alias("frame_index")).distinct()


def gap_anchors(keep: DataFrame, max_gap: int) -> DataFrame:
    """One frame in the middle of each gap wider than max_gap (a wide gap still gets one)."""
    a = keep.withColumn("_gap", F.lead("frame_index").over(by()) - F.col("frame_index")).where(F.col("_gap") > max_gap)
    return a.select("stream_id", (F.col("frame_index") + F.floor(F.col("_gap") / 2)).cast("long").alias("frame_index"))


def keep_frames(frames: DataFrame, *, stride: int, conf_delta: float, pad: int, max_gap: int, fps: float = 25.0, spikes: DataFrame | None = None) -> DataFrame:
    """(stream_id, frame_index) of the frames worth keeping: ends, padded changes, spikes if given, anchors in wide gaps."""
    lengths = stream_lengths(frames)
    hits = action_triggers(sample_stride(score_motion(frames), stride), conf_delta, fps).select("stream_id", "frame_index")
    keep = neighbour_pad(hits, lengths, pad).union(boundary_frames(lengths))
    if spikes is not None:
        keep = keep.union(spikes.select("stream_id", "frame_index"))
    keep = keep.distinct()
    return keep.union(gap_anchors(keep, max_gap)).distinct()


def dropped_frames(frames: DataFrame, keep: DataFrame) -> DataFrame:
    return frames.select("stream_id", "frame_index").join(keep, ["stream_id", "frame_index"], "left_anti")


def keep_summary(frames: DataFrame, keep: DataFrame) -> DataFrame:
    """Per stream: total, kept, ratio total/kept (0 if nothing is kept)."""
    kept = keep.groupBy("stream_id").agg(F.count(F.lit(1)).alias("kept"))
    a = stream_lengths(frames).join(kept, "stream_id", "left").withColumn("kept", F.coalesce("kept", F.lit(0)).cast("long"))
    return a.withColumn("ratio", F.when(F.col("kept") > 0, F.col("total") / F.col("kept")).otherwise(0.0))


def segments(keep: DataFrame) -> DataFrame:
    """Runs of consecutive kept frames: (stream_id, start, end), ends included."""
    a = keep.withColumn("_run", F.col("frame_index") - F.row_number().over(by()))
    return a.groupBy("stream_id", "_run").agg(F.min("frame_index").alias("start"), F.max("frame_index").alias("end")).drop("_run")


def clip_windows(frames: DataFrame, value: str, length: int) -> DataFrame:
    """Adds clip: the last length values up to the frame, front-padded with the oldest there is."""
    got = F.collect_list(value).over(by().rowsBetween(-(length - 1), 0))
    return frames.withColumn("clip", got).withColumn("clip", F.concat(F.array_repeat(F.get("clip", F.lit(0)), length - F.size("clip")), F.col("clip")))


def clip_motion(frames: DataFrame, value: str, length: int) -> DataFrame:
    """Adds energy: mean absolute difference of neighbours in the clip window."""
    diff = F.abs(F.col(value) - F.coalesce(F.lag(value).over(by()), F.col(value)))
    return frames.withColumn("_d", diff).withColumn("energy", F.sum("_d").over(by().rowsBetween(-(length - 2), 0)) / (length - 1)).drop("_d")


# --- audio -------------------------------------------------------------------------------------------


def rms_buckets(samples: DataFrame, spine: DataFrame, sample_rate: int, fps: float) -> DataFrame:
    """RMS of the samples (stream_id, sample_index, x) under each frame of the spine; 0 past the end of the sound."""
    hop = max(1, int(sample_rate / fps))
    a = samples.groupBy("stream_id", F.floor(F.col("sample_index") / hop).cast("long").alias("frame_index")).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    return spine.select("stream_id", "frame_index").join(a, ["stream_id", "frame_index"], "left").withColumn("rms", F.coalesce("rms", F.lit(0.0)))


def spikes_raw(frames: DataFrame, rms_z: float, delta_z: float) -> DataFrame:
    """Frames that are loud or suddenly change, against the stream's mean and population deviation."""

    def high(c: str, z: float) -> Column:
        sd = F.stddev_pop(c).over(whole())
        return F.when(sd > 1e-9, F.col(c) > F.avg(c).over(whole()) + z * sd).otherwise(False)

    a = frames.withColumn("delta", F.abs(F.col("rms") - F.coalesce(F.lag("rms").over(by()), F.col("rms"))))
    a = a.withColumn("loud", high("rms", rms_z)).withColumn("sudden", high("delta", delta_z))
    return a.where(F.col("loud") | F.col("sudden")).select("stream_id", "frame_index", "loud", "sudden")


def suppress_close(hits: DataFrame, min_gap: int) -> DataFrame:
    """Keeps a hit if it lies at least min_gap frames after the last one kept: an ordered fold over one stream's hits."""

    kind = hits.schema["stream_id"].dataType.simpleString()
    rows = hits.select("stream_id", F.col("frame_index").cast("long").alias("frame_index"))
    return fold(rows, "stream_id", ["frame_index"], lambda: _Apart(min_gap), f"stream_id {kind}, frame_index bigint")


class _Apart:
    def __init__(self, min_gap: int):
        self.min_gap, self.last = min_gap, None

    def step(self, part: pa.RecordBatch) -> dict:
        keep = []
        for f in part.column("frame_index").to_pylist():
            keep.append(self.last is None or f - self.last >= self.min_gap)
            if keep[-1]:
                self.last = f
        mask = pa.array(keep, pa.bool_())
        return {c: part.column(c).filter(mask) for c in ("stream_id", "frame_index")}

    def finish(self) -> None:
        return None


# --- night mode --------------------------------------------------------------------------------------


def view_mode(frames: DataFrame, saturation: str, limit: float) -> DataFrame:
    """day or night per stream by the median saturation; a stream without frames would be day."""
    a = frames.groupBy("stream_id").agg(F.median(saturation).alias("median"))
    return a.withColumn("mode", F.when(F.col("median") < limit, "night").otherwise("day"))


def lag_difference(frames: DataFrame, value: str, k: int) -> DataFrame:
    """Adds diff: |x - x k frames before|; 0 for the first k."""
    return frames.withColumn("diff", F.coalesce(F.abs(F.col(value) - F.lag(value, k).over(by())), F.lit(0.0)))


def k_of_n(frames: DataFrame, hot: str, k: int, n: int) -> DataFrame:
    """Adds votes and confirmed: at least k of the last n frames are hot."""
    votes = F.sum(F.col(hot).cast("int")).over(by().rowsBetween(-(n - 1), 0)).cast("long")
    return frames.withColumn("votes", votes).withColumn("confirmed", F.col("votes") >= k)


def ensemble_vote(frames: DataFrame, columns: list[str]) -> DataFrame:
    """Adds hot: any of the background masks says so."""
    any_of = F.lit(False)
    for c in columns:
        any_of = any_of | F.coalesce(F.col(c), F.lit(False))
    return frames.withColumn("hot", any_of)


def hysteresis(frames: DataFrame, over: str, confirm: int, clear: int) -> DataFrame:
    """Adds is_motion: on after confirm frames in a row over the limit, off after clear frames in a row under it.

    Both switches set a state whatever it was, so the state is the last switch there was: runs and one last() do it.
    """
    a = frames.withColumn("_break", (F.col(over) != F.coalesce(F.lag(over).over(by()), ~F.col(over))).cast("int"))
    a = a.withColumn("_run", F.sum("_break").over(by()))
    a = a.withColumn("_n", F.row_number().over(Window.partitionBy("stream_id", "_run").orderBy("frame_index")))
    switch = F.when(F.col(over) & (F.col("_n") >= confirm), True).when(~F.col(over) & (F.col("_n") >= clear), False)
    a = a.withColumn("_switch", switch).withColumn("is_motion", F.coalesce(F.last("_switch", ignorenulls=True).over(by()), F.lit(False)))
    return a.drop("_break", "_run", "_n", "_switch")


def after_warmup(frames: DataFrame, warmup: int) -> DataFrame:
    return frames.where(F.col("frame_index") >= warmup)


def running_background(frames: DataFrame, value: str, alpha: float) -> DataFrame:
    """(stream_id, frame_index, bg, diff): exponential background, updated before the difference is taken.

    bg = (1 - alpha) * bg + alpha * x folds over the stream's ordered values; the first frame sets it.
    """

    kind = frames.schema["stream_id"].dataType.simpleString()
    rows = frames.select("stream_id", F.col("frame_index").cast("long").alias("frame_index"), F.col(value).cast("double").alias("x"))
    return fold(rows, "stream_id", ["frame_index"], lambda: _Background(alpha), f"stream_id {kind}, frame_index bigint, bg double, diff double")


class _Background:
    def __init__(self, alpha: float):
        self.alpha, self.now = alpha, None

    def step(self, part: pa.RecordBatch) -> dict:
        x = part.column("x").to_numpy(zero_copy_only=False)
        bg = np.empty(len(x))
        for i, v in enumerate(x):
            self.now = v if self.now is None else (1 - self.alpha) * self.now + self.alpha * v
            bg[i] = self.now
        return {"stream_id": part.column("stream_id"), "frame_index": part.column("frame_index"), "bg": pa.array(bg), "diff": pa.array(np.abs(x - bg))}

    def finish(self) -> None:
        return None


def motion_regions(regions: DataFrame, scale: float, width: int, height: int, min_area: float) -> DataFrame:
    """Regions (stream_id, frame_index, region, x, y, w, h, area, m00, m10, m01) found on frames shrunk by scale, in full-frame terms.

    Regions under min_area, as found, are dropped; boxes stay inside the frame; cx, cy come from the moments, or from the box where m00 is 0;
    rank numbers a frame's regions by falling area, ties by region.
    """
    back = 1.0 / scale
    cut = lambda c: F.floor(c).cast("long")
    a = regions.where(F.col("area") >= min_area)
    a = a.withColumn("fx", F.least(cut(F.col("x") * back), F.lit(width - 1))).withColumn("fy", F.least(cut(F.col("y") * back), F.lit(height - 1)))
    a = a.withColumn("fw", F.least(cut(F.col("w") * back), F.lit(width) - F.col("fx"))).withColumn("fh", F.least(cut(F.col("h") * back), F.lit(height) - F.col("fy")))
    centre = lambda m, at, size: F.when(F.col("m00") > 0, cut(F.col(m) / F.col("m00") * back)).otherwise(F.col(at) + cut(F.col(size) / 2))
    a = a.withColumn("cx", centre("m10", "fx", "fw")).withColumn("cy", centre("m01", "fy", "fh")).withColumn("full_area", cut(F.col("area") / (scale * scale)))
    rank = F.row_number().over(Window.partitionBy("stream_id", "frame_index").orderBy(F.col("full_area").desc(), "region")).cast("int")
    return a.select("stream_id", "frame_index", "region", F.col("fx").alias("x"), F.col("fy").alias("y"), F.col("fw").alias("w"), F.col("fh").alias("h"), F.col("full_area").alias("area"), "cx", "cy", rank.alias("rank"))


def motion_over(frames: DataFrame, regions: DataFrame, ratio: str, min_ratio: float) -> DataFrame:
    """Adds regions (how many the frame has) and over: the moving share reaches min_ratio and there is a region."""
    n = regions.groupBy("stream_id", "frame_index").agg(F.count(F.lit(1)).alias("regions"))
    a = frames.join(n, ["stream_id", "frame_index"], "left").withColumn("regions", F.coalesce("regions", F.lit(0).cast("long")))
    return a.withColumn("over", F.coalesce(F.col(ratio) >= min_ratio, F.lit(False)) & (F.col("regions") > 0))


def motion_summary(frames: DataFrame) -> DataFrame:
    """Per stream: frames, motion frames, percentage, mean regions over motion frames."""
    moving = F.count_if("is_motion")
    return frames.groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("frames"),
        moving.alias("motion_frames"),
        (100.0 * moving / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("motion_pct"),
        (F.sum(F.when(F.col("is_motion"), F.col("regions")).otherwise(0)) / F.greatest(moving, F.lit(1))).alias("avg_regions"),
    )


def recent_values(frames: DataFrame, value: str, n: int = 200) -> DataFrame:
    """Adds recent: the last n values, as a sparkline shows them."""
    return frames.withColumn("recent", F.collect_list(value).over(by().rowsBetween(-(n - 1), 0)))


def time_slices(frames: DataFrame, n: int, fps: float) -> DataFrame:
    """Adds segment: n equal time slices of the stream, the last one takes the rest."""
    length = F.floor(F.max("frame_index").over(whole()) / fps / n)
    return frames.withColumn("segment", F.least(F.floor(F.col("frame_index") / fps / F.greatest(length, F.lit(1))), F.lit(n - 1)).cast("int"))


def segment_reindex(segmented: DataFrame) -> DataFrame:
    """Adds local_index within the segment and global_index: local plus the frames of all segments before."""
    local = F.row_number().over(Window.partitionBy("stream_id", "segment").orderBy("frame_index")) - 1
    a = segmented.withColumn("local_index", local.cast("long"))
    totals = a.groupBy("stream_id", "segment").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("stream_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    return a.join(totals.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n"), ["stream_id", "segment"]).withColumn("global_index", F.col("local_index") + F.col("_before")).drop("_before")


def segment_totals(segmented: DataFrame, flag: str) -> DataFrame:
    """Partial totals by segment, then one row per stream; the first segment speaks for the stream where values can't be summed."""
    part = segmented.groupBy("stream_id", "segment").agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("hits"), F.min_by("top_label", "frame_index").alias("label"))
    return part.groupBy("stream_id").agg(F.sum("n").alias("total"), F.sum("hits").alias("hits"), F.min_by("label", "segment").alias("first_label"), F.count(F.lit(1)).alias("segments"))
