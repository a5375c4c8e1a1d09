"""Chunks of kept frames, their frame records, and the message published for each chunk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.functions import scalars as S

BRIEF = ["frame_id", "source_frame_number", "filtered_index", "timestamp_ms"]
RECORD = ["frame_id", "source_frame_number", "filtered_index", "position_in_chunk", "source_time_sec", "timestamp_ms", "chunk_id", "chunk_index"]


@dataclass(frozen=True)
class ChunkSettings:
    """Identity and timing of a run; the flags are the strings that messages carry."""

    fps: float = 25.0
    source_fps: float = 25.0
    seconds: float = 2.0
    base_ms: int = 1_700_000_000_000
    site_id: str = "site"
    run_id: str = "run"
    app_id: int = 0
    assets_base: str = "/assets"
    sp_enabled: str = "true"
    critic_enabled: str = "true"
    sp: str | None = None
    critic: str | None = None
    embed_frames: bool = False

    @property
    def frames_per_chunk(self) -> int:
        return max(1, int(round(self.fps * self.seconds)))


def filtered_index(keep: DataFrame) -> DataFrame:
    """Adds filtered_index: the kept frame's place in its stream."""
    return keep.withColumn("filtered_index", (F.row_number().over(Window.partitionBy("stream_id").orderBy("frame_index")) - 1).cast("long"))


def source_index(filtered: DataFrame, kept: DataFrame | None) -> DataFrame:
    """Adds source_frame_number: looked up among kept (stream_id, filtered_index, frame_index), or else the filtered index itself."""
    if kept is None:
        return filtered.withColumn("source_frame_number", F.col("filtered_index"))
    look = kept.select("stream_id", "filtered_index", F.col("frame_index").alias("_src"))
    return filtered.join(look, ["stream_id", "filtered_index"], "left").withColumn("source_frame_number", F.coalesce("_src", "filtered_index")).drop("_src")


def chunk_frames(indexed: DataFrame, s: ChunkSettings) -> DataFrame:
    """Frame records: each filtered frame's chunk, place, source time and timestamp."""
    n = s.frames_per_chunk
    a = indexed.withColumn("chunk_index", F.floor(F.col("filtered_index") / n).cast("int")).withColumn("position_in_chunk", (F.col("filtered_index") % n).cast("int"))
    a = a.withColumn("chunk_id", S.stable_id(F.lit(s.run_id), F.col("stream_id"), F.col("chunk_index")))
    a = a.withColumn("frame_id", S.stable_id(F.lit(s.run_id), F.col("stream_id"), F.lit("frame"), F.col("filtered_index")))
    seconds = F.col("source_frame_number") / F.lit(float(s.source_fps)) if s.source_fps else F.lit(0.0)
    a = a.withColumn("source_time_sec", F.bround(seconds, 4)).withColumn("timestamp_ms", F.lit(s.base_ms) + F.bround(seconds * 1000).cast("long"))
    return a.select("stream_id", *RECORD)


def chunk_summary(records: DataFrame, s: ChunkSettings, with_frames: bool = False) -> DataFrame:
    """One row per chunk: count, times, first and last frame, and all frame records if asked for."""
    ref = F.struct(*BRIEF)
    aggs = [F.count(F.lit(1)).alias("frame_count"), F.min_by(ref, "position_in_chunk").alias("first_frame"), F.max_by(ref, "position_in_chunk").alias("last_frame")]
    if with_frames:
        aggs.append(F.transform(F.array_sort(F.collect_list(F.struct("position_in_chunk", F.struct(*RECORD).alias("r")))), lambda x: x["r"]).alias("frames"))
    a = records.groupBy("stream_id", "chunk_id", "chunk_index").agg(*aggs)
    start = S.chunk_start_ms(F.lit(s.base_ms), F.col("chunk_index").cast("long"), F.lit(float(s.seconds)))
    a = a.withColumn("start_timestamp", start).withColumn("duration_ms", S.duration_ms(F.col("frame_count"), F.lit(float(s.fps))))
    return a.withColumn("end_timestamp", F.col("start_timestamp") + F.col("duration_ms"))


def _camera(stream: Column) -> Column:
    return F.concat(F.lit("cam-"), stream.cast("string"))


def chunk_messages(chunks: DataFrame, s: ChunkSettings) -> DataFrame:
    """(stream_id, chunk_index, message): the nested event of each chunk; null parts stay out of its JSON."""
    camera = _camera(F.col("stream_id"))
    path = S.asset_path(s.assets_base, F.lit(s.site_id), camera, F.col("chunk_id"))
    sp, critic = F.lower(F.lit(s.sp_enabled)), F.lower(F.lit(s.critic_enabled))
    level = F.struct(S.alert_level(F.lit(s.sp).cast("string"), sp).alias("sp"), S.alert_level(F.lit(s.critic).cast("string"), critic).alias("critic"))
    meta = F.struct(F.lit("mp4").alias("chunk_format"), path.alias("path"), sp.alias("sp_enabled"), critic.alias("critic_enabled"), level.alias("alert_level"))
    frames = [F.col("frames")] if s.embed_frames else [F.col("first_frame"), F.col("last_frame")]
    event = F.struct(
        "chunk_id",
        "chunk_index",
        F.lit(s.run_id).alias("asset_id"),
        F.lit(s.site_id).alias("site_id"),
        camera.alias("camera_id"),
        "start_timestamp",
        "end_timestamp",
        F.lit(float(s.source_fps)).alias("source_fps"),
        F.col("frame_count").cast("int").alias("frame_count"),
        F.regexp_replace(path, r"\.mp4$", "_frames.json").alias("frames_sidecar"),
        *frames,
    )
    message = F.struct(
        S.stable_id(F.lit(s.run_id), F.lit("event"), F.col("chunk_id")).alias("event_id"),
        F.lit(s.app_id).alias("app_id"),
        camera.alias("camera_id"),
        F.lit(s.site_id).alias("site_id"),
        "chunk_id",
        "start_timestamp",
        "end_timestamp",
        meta.alias("metadata"),
        F.lit(s.run_id).alias("asset_id"),
        event.alias("event_metadata"),
    )
    return chunks.select("stream_id", "chunk_index", message.alias("message"))


def message_json(messages: DataFrame) -> DataFrame:
    """(value): the JSON that goes to the sink, without a key."""
    return messages.select(F.to_json("message").alias("value"))


def publish_tally(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if("published").alias("published"), F.count_if(~F.col("published")).alias("failed"))


def frames_in_spans(spans: DataFrame, frames: DataFrame, width: int) -> DataFrame:
    """Spans (stream_id, start, end) with the frames in them; overlapping spans share frames.

    An equi-join on the frame index's bucket of about a span's width, then the exact test: no stream is paired as a whole.
    """
    a = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    b = frames.select("stream_id", "frame_index", F.floor(F.col("frame_index") / width).alias("_b"))
    return a.join(b, ["stream_id", "_b"]).where(F.col("frame_index").between(F.col("start"), F.col("end"))).drop("_b")
