"""Scalar rules of frame scoring, timing and messages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class labels, thresholds and weights of motion scoring.
MOTION_LABELS = ["static_low", "static_high", "motion_low", "motion_high"]
ENERGY_LIMIT, EDGE_LIMIT, ENERGY_SCALE = 8.0, 12.0, 40.0
MODEL_WEIGHT, MOTION_WEIGHT = 0.7, 0.3

# Motion detector settings by sensitivity.
PRESETS = {
    "low": {"pixel_threshold": 35, "min_motion_ratio": 0.008, "min_region_area": 1500, "confirm_frames": 4, "temporal_k": 3, "temporal_n": 5},
    "medium": {"pixel_threshold": 25, "min_motion_ratio": 0.002, "min_region_area": 600, "confirm_frames": 2, "temporal_k": 2, "temporal_n": 4},
    "high": {"pixel_threshold": 15, "min_motion_ratio": 0.0005, "min_region_area": 150, "confirm_frames": 1, "temporal_k": 1, "temporal_n": 3},
}


def preset(name: str | None) -> dict:
    """Settings of a sensitivity; an unknown one counts as medium."""
    return PRESETS.get((name or "").lower(), PRESETS["medium"])


def motion_class(energy: Column, edge: Column) -> Column:
    return (F.when(energy > ENERGY_LIMIT, 2).otherwise(0) + F.when(edge > EDGE_LIMIT, 1).otherwise(0)).cast("int")


def motion_label(class_id: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MOTION_LABELS)), class_id + 1)


def motion_confidence(energy: Column) -> Column:
    return F.least(F.lit(1.0), 0.5 + energy / ENERGY_SCALE)


def ensemble(model_id: Column, model_conf: Column, model_label: Column, motion_id: Column, motion_conf: Column, motion_name: Column) -> Column:
    """struct<class_id, confidence, top_label> of a model's and the motion rule's joint prediction."""
    return F.struct(
        (model_id * len(MOTION_LABELS) + motion_id).cast("int").alias("class_id"),
        (MODEL_WEIGHT * model_conf + MOTION_WEIGHT * motion_conf).alias("confidence"),
        F.concat_ws("|", model_label, motion_name).alias("top_label"),
    )


def round_half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def truncated(x: Column) -> Column:
    return x.cast("bigint")


def frames_per_chunk(fps: Column, seconds: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(fps * seconds)).cast("bigint")


def frame_timestamp_ms(base_ms: Column, frame: Column, fps: Column) -> Column:
    """Epoch milliseconds of a frame: rounded half to even."""
    return base_ms + F.bround(frame / fps * 1000).cast("bigint")


def chunk_start_ms(base_ms: Column, chunk_index: Column, seconds: Column) -> Column:
    return base_ms + chunk_index * truncated(seconds * 1000)


def duration_ms(frames: Column, fps: Column) -> Column:
    return F.bround(frames / fps * 1000).cast("bigint")


def stream_chunk_start_ms(base_ms: Column, start_frame: Column, fps: Column) -> Column:
    """Live chunks truncate where chunks of files round."""
    return base_ms + truncated(start_frame / fps * 1000)


def _halves(x: Column) -> tuple[Column, Column]:
    """x as a sum of two numbers of 26 bits, so that products of such halves are exact."""
    head = x * 134217729.0 - (x * 134217729.0 - x)
    return head, x - head


def _multiply_add(a: Column, b: Column, c: Column) -> Column:
    """a * b + c rounded once: what the product and the sum miss is added last."""
    p, s = a * b, a * b + c
    (a1, a2), (b1, b2) = _halves(a), _halves(b)
    missed = ((a1 * b1 - p) + a1 * b2 + a2 * b1) + a2 * b2
    back = s - p
    out = s + (((p - (s - back)) + (c - back)) + missed)
    return F.when(F.isnan(out), s).otherwise(out)  # beyond what can be halved, and infinite


def quantile_cont(values: Column, q: float) -> Column:
    """The quantile of a few values, an array without nulls, bit by bit as DuckDB's quantile_cont: lo * (1 - d) + hi * d, the sum rounded once."""

    def between(v: Column) -> Column:
        at = (F.size(v) - 1) * F.lit(q)
        lo, hi, d = F.get(v, F.floor(at).cast("int")), F.get(v, F.ceil(at).cast("int")), at - F.floor(at)
        return F.when(d == 0, lo).otherwise(_multiply_add(lo, 1 - d, hi * d))

    return F.element_at(F.transform(F.array(F.array_sort(values)), between), 1)


def noise_threshold(p90: Column) -> Column:
    """1.5 times the noise, at least 10; 25 where no noise was measured."""
    return F.when(p90.isNull(), 25).otherwise(F.greatest(F.lit(10), truncated(p90 * 1.5).cast("int")))


def inference_size(width: Column, height: Column, scale: float, longest: int | None) -> Column:
    """struct<w, h>: scaled, then capped at the longest side; whole numbers, at least 1."""
    w, h = F.greatest(F.floor(width * scale), F.lit(1)), F.greatest(F.floor(height * scale), F.lit(1))
    if longest:
        ratio = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(w, h))
        w, h = F.greatest(F.floor(w * ratio), F.lit(1)), F.greatest(F.floor(h * ratio), F.lit(1))
    return F.struct(w.cast("int").alias("w"), h.cast("int").alias("h"))


def three_digits(x: Column) -> Column:
    """A number from 0 as text with three digits after the point, rounded by its exact binary value, ties to even.

    x * 1000 is split into the nearest double and what that one misses, so a decimal tie that x isn't exactly is none.
    """
    p = x * 1000.0
    head = x * 134217729.0 - (x * 134217729.0 - x)
    missed = (head * 1000.0 - p) + (x - head) * 1000.0
    whole = F.floor(p).cast("long")
    part = p - whole
    up = (part > 0.5) | ((part == 0.5) & ((missed > 0) | ((missed == 0) & (whole % 2 == 1))))
    n = whole + up.cast("int")
    return F.concat(F.floor(n / 1000).cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"))


def change_detail(prev_label: Column, label: Column, delta: Column, conf_delta: float, label_changed: Column) -> Column:
    """Why a frame triggered: the label's change, the confidence's, or both; null if neither."""
    parts = F.concat_ws(
        "; ",
        F.when(label_changed, F.concat(F.lit("label "), prev_label, F.lit("->"), label)),
        F.when(delta > conf_delta, F.concat(F.lit("conf Δ="), three_digits(delta))),
    )
    return F.when(parts != "", parts)


def asset_path(base: str, site: Column, camera: Column, chunk_id: Column, ext: str = "mp4") -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), site, F.lit("/"), camera, F.lit("/"), chunk_id, F.lit("." + ext))


def stable_id(*parts: Column) -> Column:
    """An id from its natural key, so that a rerun gives the same one."""
    return F.md5(F.concat_ws("/", *[p.cast("string") for p in parts]))


def mask_secret(value: Column) -> Column:
    return F.when(F.coalesce(F.length(value), F.lit(0)) == 0, "").when(F.length(value) > 2, F.concat(F.substring(value, 1, 2), F.lit("***"))).otherwise("***")


def provided_or_kept(new: Column, old: Column) -> Column:
    """Null means not provided; an empty string overwrites."""
    return F.coalesce(new, old)


def alert_level(explicit: Column, enabled: Column) -> Column:
    """The explicit value, or else the flag in lower case."""
    return F.coalesce(explicit, F.lower(enabled))


def person_label(name: Column, uuid: Column, score: Column) -> Column:
    known = F.format_string("%s (%d%%)", name, F.bround(score * 100).cast("int"))
    return F.when(F.coalesce(name, F.lit("")) != "", known).otherwise(F.concat(F.lit("Unknown ["), F.substring(uuid, 1, 8), F.lit("]")))


def clock(seconds: Column) -> Column:
    """HH:MM:SS."""
    s = truncated(seconds)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def grid_place(index: Column, columns: int) -> Column:
    return F.struct(F.floor(index / columns).cast("bigint").alias("row"), (index % columns).cast("bigint").alias("col"))
