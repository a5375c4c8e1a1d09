"""Kernels on grey or BGR frames in numpy, and night motion on pixels as an ordered fold.

Pixels ride in Arrow batches: set ``spark.sql.execution.arrow.maxRecordsPerBatch`` so that a batch of frames fits in memory.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.operators.folds import fold

GREY = np.array([0.114, 0.587, 0.299])  # fixed values: weights of blue, green and red


def grey(bgr: np.ndarray) -> np.ndarray:
    return np.rint(bgr @ GREY).astype(np.uint8)


# --- size and blur -----------------------------------------------------------------------------------


def _area(n: int, m: int) -> np.ndarray:
    """How much of each of n cells each of m equal spans covers, in shares of the span."""
    edge = np.arange(m + 1) * (n / m)
    cover = np.minimum(edge[1:, None], np.arange(1, n + 1)) - np.maximum(edge[:-1, None], np.arange(n))
    return np.maximum(cover, 0) * (m / n)


def _linear(n: int, m: int) -> np.ndarray:
    at = np.clip((np.arange(m) + 0.5) * (n / m) - 0.5, 0, n - 1)
    return np.maximum(0, 1 - np.abs(at[:, None] - np.arange(n)))


def resized(image: np.ndarray, width: int, height: int, how: str = "area") -> np.ndarray:
    """The image in another size: means of the areas covered, or linear between pixel centres."""
    weights = _area if how == "area" else _linear
    out = np.tensordot(weights(image.shape[0], height), image.astype(float), (1, 0))
    out = np.moveaxis(np.tensordot(weights(image.shape[1], width), out, (1, 1)), 0, 1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8) if image.dtype == np.uint8 else out


def for_inference(image: np.ndarray, scale: float = 1.0, longest: int | None = None) -> np.ndarray:
    """Scaled, then capped at the longest side, whole numbers of at least 1; as scalars.inference_size."""
    h, w = (max(1, int(v * scale)) for v in image.shape[:2])
    if longest and max(w, h) > longest:
        w, h = (max(1, int(v * longest / max(w, h))) for v in (w, h))
    return image if (h, w) == image.shape[:2] else resized(image, w, h)


def gaussian(image: np.ndarray, size: int) -> np.ndarray:
    """Gaussian blur with an odd window; the deviation follows from its size, borders mirror without repeating the edge."""
    r = size // 2
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(size) - r) ** 2) / (2 * sigma * sigma))
    out = image.astype(float)
    for axis in (0, 1):
        pad = [(r, r) if a == axis else (0, 0) for a in range(out.ndim)]
        out = np.lib.stride_tricks.sliding_window_view(np.pad(out, pad, mode="reflect"), size, axis) @ (k / k.sum())
    return np.rint(out).astype(np.uint8) if image.dtype == np.uint8 else out


def equalised(image: np.ndarray, clip: float, tiles: int) -> np.ndarray:
    """Local histogram equalisation with clipped histograms, linear between the centres of tiles."""
    h, w = image.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    full = np.pad(image, ((0, th * tiles - h), (0, tw * tiles - w)), mode="symmetric")
    cell = full.reshape(tiles, th, tiles, tw).swapaxes(1, 2).reshape(tiles * tiles, -1).astype(int)
    counts = np.zeros((tiles * tiles, 256))
    np.add.at(counts, (np.arange(tiles * tiles)[:, None], cell), 1)
    limit = max(1.0, clip * th * tw / 256)
    over = np.maximum(counts - limit, 0).sum(axis=1, keepdims=True)
    curve = np.cumsum(np.minimum(counts, limit) + over / 256, axis=1) * (255.0 / (th * tw))
    curve = curve.reshape(tiles, tiles, 256)

    def around(n: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(n) + 0.5) / step - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1), at - low

    y0, y1, fy = around(h, th)
    x0, x1, fx = around(w, tw)
    pick = lambda y, x: curve[y[:, None], x[None, :], image]
    top = pick(y0, x0) * (1 - fx) + pick(y0, x1) * fx
    low = pick(y1, x0) * (1 - fx) + pick(y1, x1) * fx
    return np.clip(np.rint(top * (1 - fy[:, None]) + low * fy[:, None]), 0, 255).astype(np.uint8)


# --- masks -------------------------------------------------------------------------------------------


def ellipse(size: int) -> np.ndarray:
    """An elliptic window of odd size, at least 3."""
    r = max(3, size | 1) // 2
    half = np.rint(r * np.sqrt(1 - (np.arange(-r, r + 1) / r) ** 2))
    return np.abs(np.arange(-r, r + 1))[None, :] <= half[:, None]


def dilated(mask: np.ndarray, window: np.ndarray) -> np.ndarray:
    r, out = len(window) // 2, np.zeros_like(mask)
    room = np.pad(mask, r)
    for dy, dx in zip(*np.nonzero(window)):
        out |= room[dy : dy + mask.shape[0], dx : dx + mask.shape[1]]
    return out


def eroded(mask: np.ndarray, window: np.ndarray) -> np.ndarray:
    return ~dilated(~mask, window)


def cleaned(mask: np.ndarray, close: int = 5, open_: int = 3, grow: int = 3) -> np.ndarray:
    """Holes closed, specks opened, what is left grown."""
    a, b = ellipse(close), ellipse(open_)
    mask = eroded(dilated(mask, a), a)
    return dilated(dilated(eroded(mask, b), b), ellipse(grow))


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, past the last, component) of each horizontal run; runs that touch, corners included, share a component."""
    step = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, a = np.nonzero(step == 1)
    b = np.nonzero(step == -1)[1]
    stride = mask.shape[1] + 2
    low = np.searchsorted(y * stride + b, (y - 1) * stride + a, "left")
    high = np.searchsorted(y * stride + a, (y - 1) * stride + b, "right")
    root = list(range(len(y)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, (p, q) in enumerate(zip(low, high)):
        for j in range(p, q):
            one, two = find(i), find(j)
            root[max(one, two)] = min(one, two)
    return y, a, b, np.unique([find(i) for i in range(len(y))], return_inverse=True)[1] if len(y) else np.empty(0, int)


def regions(mask: np.ndarray) -> list[dict]:
    """Connected regions: number, box, area in pixels and raw moments, as frames.motion_regions reads them."""
    y, a, b, of = _runs(mask)
    if not len(y):
        return []
    n = of.max() + 1
    left, right, top, low = np.full(n, mask.shape[1]), np.zeros(n, int), np.full(n, mask.shape[0]), np.zeros(n, int)
    for least, v in ((left, a), (top, y)):
        np.minimum.at(least, of, v)
    for most, v in ((right, b), (low, y + 1)):
        np.maximum.at(most, of, v)
    size = b - a
    area, mx, my = (np.bincount(of, v, n) for v in (size, size * (a + b - 1) / 2, size * y))
    return [
        {"region": i, "x": int(left[i]), "y": int(top[i]), "w": int(right[i] - left[i]), "h": int(low[i] - top[i]), "area": float(area[i]), "m00": float(area[i]), "m10": float(mx[i]), "m01": float(my[i])}
        for i in range(n)
    ]


def edges(image: np.ndarray, low: float, high: float) -> np.ndarray:
    """Edge pixels: ridges of the gradient over low that touch one over high."""
    p = np.pad(image.astype(float), 1, mode="edge")
    down, across = p[2:] - p[:-2], p[:, 2:] - p[:, :-2]
    gy = down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]
    gx = across[:-2] + 2 * across[1:-1] + across[2:]
    size = np.abs(gx) + np.abs(gy)
    turn = np.rint(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4
    room, ridge = np.pad(size, 1), np.zeros(size.shape, bool)
    h, w = size.shape
    for t, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        before = room[1 - dy : 1 - dy + h, 1 - dx : 1 - dx + w]
        after = room[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
        ridge |= (turn == t) & (size > before) & (size >= after)
    weak = ridge & (size > low)
    y, a, b, of = _runs(weak)
    if not len(y):
        return weak
    sums = np.pad(np.cumsum(ridge & (size > high), axis=1), ((0, 0), (1, 0)))
    strong = np.bincount(of, sums[y, b] - sums[y, a]) > 0
    out = np.zeros(size.shape, bool)
    for r, p, q in zip(y[strong[of]], a[strong[of]], b[strong[of]]):
        out[r, p:q] = True
    return out


def sharpness(image: np.ndarray) -> float:
    """Variance of the Laplacian, borders mirrored."""
    p = np.pad(image.astype(float), 1, mode="reflect")
    return float((p[1:-1, :-2] + p[1:-1, 2:] + p[:-2, 1:-1] + p[2:, 1:-1] - 4 * p[1:-1, 1:-1]).var())


# --- backgrounds: each takes the next frame and says which pixels move ------------------------------------


class RunningAverage:
    """Moves if a pixel is off the running average, which takes the frame in first; nothing moves on the first frame."""

    def __init__(self, threshold: float, alpha: float = 0.05):
        self.threshold, self.alpha, self.mean = threshold, alpha, None

    def apply(self, frame: np.ndarray) -> np.ndarray:
        now = frame.astype(np.float32)
        if self.mean is None:
            self.mean = now
            return np.zeros(frame.shape, bool)
        self.mean = self.mean + np.float32(self.alpha) * (now - self.mean)
        return np.abs(now - np.rint(self.mean)) > self.threshold


class LagDifference:
    """Moves if a pixel is off the frame lag frames before; nothing moves until there is one."""

    def __init__(self, threshold: float, lag: int = 3):
        self.threshold, self.seen = threshold, deque(maxlen=lag + 1)

    def apply(self, frame: np.ndarray) -> np.ndarray:
        self.seen.append(frame.astype(np.int16))
        if len(self.seen) < self.seen.maxlen:
            return np.zeros(frame.shape, bool)
        return np.abs(self.seen[-1] - self.seen[0]) > self.threshold


class Mixture:
    """A mixture of Gaussians for each pixel that gains and loses components (Zivkovic 2004).

    A pixel moves if it is more than sqrt(var_threshold) deviations off all components that make up the background's share.
    """

    SHARE, CLOSE, DECAY = 0.9, 9.0, 0.05
    FIRST, LEAST, MOST = 15.0, 4.0, 75.0

    def __init__(self, history: int = 200, var_threshold: float = 60.0, components: int = 5):
        self.history, self.far, self.k, self.n = history, var_threshold, components, 0
        self.weight = self.mean = self.var = None

    def apply(self, frame: np.ndarray) -> np.ndarray:
        x = frame.astype(float)
        if self.weight is None:
            self.weight, self.mean, self.var = (np.zeros((self.k, *x.shape)) for _ in range(3))
        self.n += 1
        rate = 1.0 / min(2 * self.n, self.history)
        off = x - self.mean
        used = self.weight > 0
        before = np.cumsum(self.weight, axis=0) - self.weight
        moving = ~(used & (before < self.SHARE) & (off * off < self.far * self.var)).any(axis=0)
        near = used & (off * off < self.CLOSE * self.var)
        own = near & (np.cumsum(near, axis=0) == 1)
        weight = np.where(used, np.maximum(self.weight + rate * (own - self.weight) - rate * self.DECAY, 0), 0)
        pull = np.where(own, rate / np.maximum(weight, rate), 0.0)
        self.mean = self.mean + pull * off
        self.var = np.where(own, np.clip(self.var + pull * (off * off - self.var), self.LEAST, self.MOST), self.var)
        fresh = ~near.any(axis=0)
        last = np.zeros_like(own)
        np.put_along_axis(last, weight.argmin(axis=0)[None], True, axis=0)
        last &= fresh
        weight = np.where(last, np.where(weight.sum(axis=0) > 0, rate, 1.0), weight)
        self.mean, self.var = np.where(last, x, self.mean), np.where(last, self.FIRST, self.var)
        weight /= weight.sum(axis=0)
        order = np.argsort(-weight, axis=0, kind="stable")
        self.weight, self.mean, self.var = (np.take_along_axis(v, order, axis=0) for v in (weight, self.mean, self.var))
        return moving


# --- night motion on pixels ----------------------------------------------------------------------------


@dataclass(frozen=True)
class NightSettings:
    """How night frames are prepared and which backgrounds vote."""

    scale: float = 0.5
    blur: int = 11
    clip: float = 2.5
    tiles: int = 8
    pixel_threshold: int = 25
    temporal_k: int = 2
    temporal_n: int = 4
    methods: tuple[str, ...] = ("running_avg", "mog2", "frame_diff")

    def backgrounds(self) -> list:
        make = {"running_avg": lambda: RunningAverage(self.pixel_threshold), "mog2": Mixture, "frame_diff": lambda: LagDifference(self.pixel_threshold)}
        return [make[m]() for m in self.methods]


def prepared(frame: np.ndarray, s: NightSettings) -> np.ndarray:
    """Grey, shrunk, blurred, equalised."""
    g = grey(frame) if frame.ndim == 3 else frame
    if s.scale != 1.0:
        g = resized(g, max(1, int(g.shape[1] * s.scale)), max(1, int(g.shape[0] * s.scale)))
    return equalised(gaussian(g, s.blur | 1), s.clip, s.tiles)


REGION = "struct<region:int,x:int,y:int,w:int,h:int,area:double,m00:double,m10:double,m01:double>"
_REGION = pa.list_(pa.struct([(k, pa.int32()) for k in ("region", "x", "y", "w", "h")] + [(k, pa.float64()) for k in ("area", "m00", "m10", "m01")]))


class _Night:
    """State of one stream: its backgrounds and the last masks."""

    def __init__(self, shape: tuple[int, int, int], s: NightSettings, roi: np.ndarray | None):
        self.shape, self.s, self.roi = shape, s, roi
        self.backgrounds, self.masks = s.backgrounds(), deque(maxlen=s.temporal_n)

    def step(self, part: pa.RecordBatch) -> dict:
        ratios, found = [], []
        for pixels in part.column("pixels"):
            g = prepared(np.frombuffer(pixels.as_buffer(), np.uint8).reshape(self.shape), self.s)
            self.masks.append(np.logical_or.reduce([b.apply(g) for b in self.backgrounds]))
            mask = cleaned(np.sum(self.masks, axis=0) >= self.s.temporal_k)
            if self.roi is not None:
                mask &= resized(self.roi.astype(float), mask.shape[1], mask.shape[0]) >= 0.5
            ratios.append(float(mask.mean()))
            found.append(regions(mask))
        return {"stream_id": part.column("stream_id"), "frame_index": part.column("frame_index"), "ratio": pa.array(ratios, pa.float64()), "regions": pa.array(found, _REGION)}

    def finish(self) -> None:
        return None


def night_motion(images: DataFrame, height: int, width: int, settings: NightSettings | None = None, roi: np.ndarray | None = None) -> DataFrame:
    """(stream_id, frame_index, ratio, regions) of raw BGR frames in a binary column ``pixels``.

    Any background's mask, then a vote over recent frames, then cleaning; ratio is the mask's share, regions its parts on the shrunk
    frame. A task holds a batch of frames and one stream's backgrounds. Frames without pixels are left out.
    """
    s = settings or NightSettings()
    kind = images.schema["stream_id"].dataType.simpleString()
    rows = images.where("pixels is not null").select("stream_id", F.col("frame_index").cast("long").alias("frame_index"), "pixels")
    return fold(rows, "stream_id", ["frame_index"], lambda: _Night((height, width, 3), s, roi), f"stream_id {kind}, frame_index bigint, ratio double, regions array<{REGION}>")


def region_rows(motion: DataFrame) -> DataFrame:
    """Regions of night_motion as rows, as frames.motion_regions reads them."""
    return motion.select("stream_id", "frame_index", F.explode("regions").alias("_r")).select("stream_id", "frame_index", "_r.*")


class _Motion:
    """The last frame of one stream, in grey."""

    def __init__(self, shape: tuple[int, int, int]):
        self.shape, self.last = shape, None

    def step(self, part: pa.RecordBatch) -> dict:
        energy, edge = [], []
        for pixels in part.column("pixels"):
            g = grey(np.frombuffer(pixels.as_buffer(), np.uint8).reshape(self.shape))
            energy.append(0.0 if self.last is None else float(np.abs(g.astype(float) - self.last).mean()))
            edge.append(float(255 * edges(g, 50, 150).mean()))
            self.last = g
        return {"stream_id": part.column("stream_id"), "frame_index": part.column("frame_index"), "energy": pa.array(energy, pa.float64()), "edge": pa.array(edge, pa.float64())}

    def finish(self) -> None:
        return None


def motion_features(images: DataFrame, height: int, width: int) -> DataFrame:
    """(stream_id, frame_index, energy, edge) of raw BGR frames, as frames.score_motion reads them: change from the frame before, and edges."""
    kind = images.schema["stream_id"].dataType.simpleString()
    rows = images.where("pixels is not null").select("stream_id", F.col("frame_index").cast("long").alias("frame_index"), "pixels")
    return fold(rows, "stream_id", ["frame_index"], lambda: _Motion((height, width, 3)), f"stream_id {kind}, frame_index bigint, energy double, edge double")
