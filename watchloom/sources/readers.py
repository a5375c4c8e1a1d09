"""Where rows come from: stored or live frames, registries, tags, regions of interest, raw files."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LIVE = ("rtsp", "rtsps", "http", "https")
ROI = "imageWidth int, imageHeight int, shapes array<struct<label:string,shape_type:string,points:array<array<double>>>>"
TAGS = ["uuid", "name", "role", "department", "notes"]


def is_live(source: str) -> bool:
    return urlparse(source).scheme.lower() in LIVE


def frames(spark: SparkSession, path: str, schema: StructType | str | None = None, live: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """Frame features from Parquet: a table, or with live a stream that picks up new files and resumes from its checkpoint."""
    if not live:
        return spark.read.parquet(path)
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def kafka_frames(spark: SparkSession, brokers: str, topic: str, schema: str) -> DataFrame:
    """Frames from a Kafka topic's JSON values; needs Spark's Kafka connector."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("v")).select("v.*")


def stream_dimension(frame_rows: DataFrame, fps: float, width: int, height: int) -> DataFrame:
    """(stream_id, fps, width, height, frame_count, duration_sec) of stored frames."""
    a = frame_rows.groupBy("stream_id").agg((F.max("frame_index") + 1).alias("frame_count"))
    return a.select("stream_id", F.lit(fps).alias("fps"), F.lit(width).alias("width"), F.lit(height).alias("height"), "frame_count", (F.col("frame_count") / fps).alias("duration_sec"))


def decoded(files: DataFrame, decode: Callable[[bytes], Iterator[dict]], schema: str) -> DataFrame:
    """Rows that decode makes of each binary file (path, content): frames of a clip, samples of a sound, one image."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows = [{"path": path, **r} for r in decode(bytes(content))]
                if rows:
                    yield pd.DataFrame(rows)

    return files.select("path", "content").mapInPandas(run, f"path string, {schema}")


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def centroid_files(spark: SparkSession, path: str, glob: str = "*.npy") -> DataFrame:
    """(name, embedding) of stored centroids: one array file each, named by the file's stem; matrices give their rows' mean."""

    def one(content: bytes) -> Iterator[dict]:
        import io

        x = np.load(io.BytesIO(content), allow_pickle=False).astype(float)
        yield {"embedding": (x.mean(axis=0) if x.ndim > 1 else x).tolist()}

    rows = decoded(binary_files(spark, path, glob), one, "embedding array<double>")
    return rows.select(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("name"), "embedding")


def wave_mono(content: bytes) -> tuple[np.ndarray, int]:
    """Samples within -1 and 1, channels averaged, and their rate, of a WAVE file of 8 to 32 bits; none where the file can't be read."""
    import io
    import wave

    try:
        with wave.open(io.BytesIO(content)) as w:
            raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    except (wave.Error, EOFError):
        return np.empty(0), 0
    whole = np.frombuffer(raw[: len(raw) // (width * channels) * width * channels], np.uint8).reshape(-1, width)
    if width == 1:
        x = whole[:, 0].astype(float) - 128
    else:
        # the bytes go to the top of 32 bits, so that the sign comes along
        wide = np.zeros((len(whole), 4), np.uint8)
        wide[:, 4 - width :] = whole
        x = wide.view("<i4")[:, 0] / 2.0 ** (32 - 8 * width)
    return (x / 2.0 ** (8 * width - 1)).reshape(-1, channels).mean(axis=1), rate


def pcm_samples(content: bytes) -> Iterator[dict]:
    """Samples of a WAVE file at its own rate."""
    for i, x in enumerate(wave_mono(content)[0]):
        yield {"sample_index": i, "x": float(x)}


def pcm_samples_at(rate: int = 22050) -> Callable[[bytes], Iterator[dict]]:
    """A decoder to samples at the rate, linear between the file's own."""

    def samples(content: bytes) -> Iterator[dict]:
        x, own = wave_mono(content)
        if len(x):
            n = int(len(x) * rate / own)
            for i, v in enumerate(np.interp(np.arange(n) * (own / rate), np.arange(len(x)), x)):
                yield {"sample_index": i, "x": float(v)}

    return samples


def tags_csv(spark: SparkSession, path: str) -> DataFrame:
    """Tag rows (id, name, role, department, notes) from a CSV with a header; columns that are missing or blank are ''."""
    a = spark.read.option("header", True).csv(path)
    have = {c.strip(): c for c in a.columns}
    cols = [F.trim(F.coalesce(F.col(f"`{have[c]}`"), F.lit(""))).alias("id" if c == "uuid" else c) if c in have else F.lit("").alias(c) for c in TAGS]
    return a.select(*cols)


def roi_shapes(spark: SparkSession, path: str) -> DataFrame:
    """Region-of-interest files, one row each: image size and shapes."""
    return spark.read.schema(ROI).option("multiLine", True).json(path)


def scaled_shapes(rois: DataFrame, width: int, height: int) -> DataFrame:
    """Shapes scaled from their image's size to a frame's."""
    fx, fy = F.lit(float(width)) / F.col("imageWidth"), F.lit(float(height)) / F.col("imageHeight")
    shape = lambda s: F.struct(s["shape_type"].alias("shape_type"), F.transform(s["points"], lambda p: F.array(p[0] * fx, p[1] * fy)).alias("points"))
    return rois.select(F.transform("shapes", shape).alias("shapes"))


def registry(spark: SparkSession, path: str, site_id=None, columns: list[str] | None = None) -> DataFrame:
    """A registry snapshot; the site's filter and the columns reach the scan."""
    a = spark.read.parquet(path)
    a = a if site_id is None else a.where(F.col("site_id") == F.lit(site_id))
    return a.select(*columns) if columns else a


def config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def synthetic_clip(spark: SparkSession, n: int = 90, changes: tuple[int, int] = (30, 60)) -> tuple[DataFrame, DataFrame]:
    """A still, then moving, then still stream of n frames, and its change points."""
    moving = F.col("id").between(changes[0], changes[1] - 1)
    f = spark.range(n).select(F.lit(0).cast("long").alias("stream_id"), F.col("id").alias("frame_index"), F.when(moving, 30.0).otherwise(1.0).alias("energy"), F.when(moving, 20.0).otherwise(5.0).alias("edge"))
    labels = spark.createDataFrame([(0, c) for c in changes], "stream_id long, frame_index long")
    return f, labels
