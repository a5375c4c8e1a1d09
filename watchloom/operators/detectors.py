"""Detectors, alignment and embedding of faces as plug-ins: what surrounds a network, in numpy; the network is a callable.

A network takes the prepared image as (1, 3, side, side) floats and returns its output arrays; ``onnx`` makes one of a file.
Detectors return a Detections; ``detect`` and ``embed`` run them over images, made once per Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.operators import pixels as X
from watchloom.operators import tracking as T

# Where eyes, nose and mouth corners lie on an aligned face, its side, and the levels of the face network.
LANDMARKS = np.array([[38.2946, 51.6963], [73.5318, 51.5014], [56.0252, 71.7366], [41.5493, 92.3655], [70.7299, 92.2041]])
FACE_SIDE = 112
STRIDES, ANCHORS, SIDE = (8, 16, 32), 2, 640

Network = Callable[[np.ndarray], list[np.ndarray]]


def onnx(path: str) -> Network:
    import onnxruntime

    session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
    return lambda x: session.run(None, {session.get_inputs()[0].name: x})


@dataclass
class Detections:
    boxes: np.ndarray  # (n, 4): x1, y1, x2, y2 in the image's pixels
    scores: np.ndarray  # (n,)
    points: np.ndarray  # (n, 5, 2); no points: (n, 0, 2)

    def take(self, which: np.ndarray | list) -> Detections:
        return Detections(self.boxes[which], self.scores[which], self.points[which])


@dataclass
class View:
    """How an image was put on a square canvas, and the way back."""

    canvas: np.ndarray
    scale: np.ndarray  # canvas pixels an image pixel, across and down
    shift: np.ndarray

    def back(self, xy: np.ndarray) -> np.ndarray:
        return (xy - self.shift) / self.scale


def letterboxed(image: np.ndarray, side: int, fill: int = 0, centre: bool = False) -> View:
    """Scaled so that the longer side fits, in the corner or the middle."""
    scale = side / max(image.shape[:2])
    h, w = (max(1, int(v * scale)) for v in image.shape[:2])
    left, top = ((side - w) // 2, (side - h) // 2) if centre else (0, 0)
    canvas = np.full((side, side, 3), fill, np.uint8)
    canvas[top : top + h, left : left + w] = X.resized(image, w, h, "linear")
    return View(canvas, np.array([scale, scale]), np.array([left, top]))


def stretched(image: np.ndarray, side: int) -> View:
    return View(X.resized(image, side, side, "linear"), np.array([side / image.shape[1], side / image.shape[0]]), np.zeros(2))


def planes(image: np.ndarray, rgb: bool, minus: float, over: float) -> np.ndarray:
    """The network's input: channels first, scaled."""
    a = image[:, :, ::-1] if rgb else image
    return ((a.astype(np.float32) - minus) / over).transpose(2, 0, 1)[None]


def suppressed(found: Detections, limit: float, by: str = "score") -> Detections:
    """Boxes by falling score or area that overlap no kept one by more than limit."""
    b = found.boxes
    rank = found.scores if by == "score" else (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
    return found.take(np.array(T.suppressed(b, rank, limit), dtype=int))


class AnchorFaces:
    """Faces by distances from a grid of anchors on three levels: outputs are scores, box distances and landmark offsets of each level.

    offset: where in its cell an anchor lies. strict: a score equal to the threshold doesn't count. limit: suppression by area, or none.
    """

    def __init__(self, network: Network, *, offset: float = 0.5, strict: bool = False, stretch: bool = False, limit: float | None = 0.4, side: int = SIDE):
        self.network, self.offset, self.strict, self.stretch, self.limit, self.side = network, offset, strict, stretch, limit, side

    def __call__(self, image: np.ndarray, threshold: float = 0.5) -> Detections:
        view = stretched(image, self.side) if self.stretch else letterboxed(image, self.side)
        out = self.network(planes(view.canvas, True, 127.5, 128.0) if self.stretch else planes(view.canvas, False, 0.0, 255.0))
        levels = len(STRIDES)
        parts = [self._level(stride, *(np.asarray(out[i + levels * j]) for j in range(3)), threshold) for i, stride in enumerate(STRIDES)]
        scores, near, far, points = (np.concatenate(p) for p in zip(*parts))
        found = Detections(np.concatenate([view.back(near), view.back(far)], axis=1), scores, view.back(points))
        return found if self.limit is None else suppressed(found, self.limit, "area")

    def _level(self, stride: int, scores: np.ndarray, boxes: np.ndarray, points: np.ndarray, threshold: float) -> tuple:
        scores = scores.reshape(-1)
        hit = np.flatnonzero(scores > threshold if self.strict else scores >= threshold)
        row, column = np.divmod(hit // ANCHORS, self.side // stride)
        anchor = (np.stack([column, row], axis=1) + self.offset) * stride
        reach = boxes.reshape(-1, 4)[hit].astype(float) * stride
        return scores[hit], anchor - reach[:, :2], anchor + reach[:, 2:], anchor[:, None, :] + points.reshape(-1, 5, 2)[hit].astype(float) * stride


class ListedFaces:
    """Faces that the network lists: rows of x, y, width, height, five points and a score on a centred canvas."""

    def __init__(self, network: Callable[[np.ndarray], np.ndarray | None], side: int = SIDE):
        self.network, self.side = network, side

    def __call__(self, image: np.ndarray, threshold: float = 0.5) -> Detections:
        view = letterboxed(image, self.side, centre=True)
        rows = self.network(view.canvas)
        rows = np.empty((0, 15)) if rows is None else np.asarray(rows, float).reshape(-1, 15)
        rows = rows[rows[:, 14] >= threshold]
        boxes = np.concatenate([view.back(rows[:, :2]), view.back(rows[:, :2] + rows[:, 2:4])], axis=1)
        return Detections(boxes, rows[:, 14], view.back(rows[:, 4:14].reshape(-1, 5, 2)))


class Persons:
    """Persons from one output of (centre, size, class scores) by place; boxes stay inside the image."""

    def __init__(self, network: Network, limit: float = 0.45, side: int = SIDE):
        self.network, self.limit, self.side = network, limit, side

    def __call__(self, image: np.ndarray, threshold: float = 0.4) -> Detections:
        view = letterboxed(image, self.side, fill=114, centre=True)
        out = np.asarray(self.network(planes(view.canvas, True, 0.0, 255.0))[0], float)
        out = out.reshape(out.shape[-2:])
        out = out[:, out[4] >= threshold]
        middle, half = out[:2].T, out[2:4].T / 2
        top = np.array(image.shape[1::-1])
        boxes = np.concatenate([np.clip(view.back(middle - half), 0, top), np.clip(view.back(middle + half), 0, top)], axis=1)
        return suppressed(Detections(boxes, out[4], np.empty((len(boxes), 0, 2))), self.limit)


def detector(config: dict) -> Callable[[], Callable]:
    """A maker of the configured detector: ``detector_type`` (scrfd, scrfd_stretched or persons) and ``detector_model``, a file."""
    kinds = {
        "scrfd": AnchorFaces,
        "scrfd_stretched": lambda net: AnchorFaces(net, offset=0.0, strict=True, stretch=True, limit=None),
        "persons": Persons,
    }
    kind = str(config.get("detector_type", "scrfd")).lower()
    if kind not in kinds:
        raise ValueError(f"detector_type: {kind}")
    return lambda: kinds[kind](onnx(config["detector_model"]))


def detect(images: DataFrame, make: Callable[[], Callable], height: int, width: int, threshold: float) -> DataFrame:
    """(stream_id, frame_index, det, x1, y1, x2, y2, score, points) of raw BGR frames in ``pixels``; frames without pixels give none."""
    kind = images.schema["stream_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = make()
        for pdf in batches:
            for stream, frame, raw in zip(pdf["stream_id"], pdf["frame_index"], pdf["pixels"]):
                d = find(np.frombuffer(raw, np.uint8).reshape(height, width, 3), threshold)
                if len(d.boxes):
                    sides = {c: d.boxes[:, i].astype(float) for i, c in enumerate(("x1", "y1", "x2", "y2"))}
                    yield pd.DataFrame({"stream_id": stream, "frame_index": frame, "det": range(len(d.boxes)), **sides, "score": d.scores.astype(float), "points": d.points.reshape(len(d.boxes), -1).astype(float).tolist()})

    rows = images.where("pixels is not null").select("stream_id", F.col("frame_index").cast("long").alias("frame_index"), "pixels")
    return rows.mapInPandas(run, f"stream_id {kind}, frame_index bigint, det bigint, x1 double, y1 double, x2 double, y2 double, score double, points array<double>")


# --- faces -----------------------------------------------------------------------------------------------


def similarity(points: np.ndarray, target: np.ndarray) -> tuple[complex, complex]:
    """(a, b) such that a z + b takes points to target with least squares, as complex numbers: a turns and scales, b shifts."""
    z, w = (np.asarray(p, float) @ np.array([1, 1j]) for p in (points, target))
    dz, dw = z - z.mean(), w - w.mean()
    spread = float((np.abs(dz) ** 2).sum())
    a = complex((dz.conj() * dw).sum() / spread) if spread > 1e-12 else 1 + 0j
    return a, complex(w.mean() - a * z.mean())


def aligned(image: np.ndarray, points: np.ndarray, side: int = FACE_SIDE) -> np.ndarray:
    """The face turned, scaled and cut so that its landmarks come to lie where all faces have them; black beyond the image."""
    a, b = similarity(points, LANDMARKS * (side / FACE_SIDE))
    if a == 0:
        return np.zeros((side, side, 3), np.uint8)
    place = (np.arange(side)[None, :] + 1j * np.arange(side)[:, None] - b) / a
    x, y = place.real, place.imag
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    out = np.zeros((side, side, 3))
    for dx, dy in ((0, 0), (1, 0), (0, 1), (1, 1)):
        cx, cy = x0 + dx, y0 + dy
        inside = (cx >= 0) & (cx < image.shape[1]) & (cy >= 0) & (cy < image.shape[0])
        weight = (1 - np.abs(x - cx)) * (1 - np.abs(y - cy)) * inside
        out += weight[..., None] * image[np.clip(cy, 0, image.shape[0] - 1), np.clip(cx, 0, image.shape[1] - 1)]
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def without_background(face: np.ndarray) -> np.ndarray:
    """The face within a soft ellipse of 0.47 of its sides; grey outside."""
    h, w = face.shape[:2]
    y, x = np.mgrid[:h, :w]
    inside = ((x - w // 2) / max(1, int(w * 0.47))) ** 2 + ((y - h // 2) / max(1, int(h * 0.47))) ** 2 <= 1
    soft = X.gaussian(inside.astype(float), 15)[..., None]
    return np.clip(face * soft + 127.5 * (1 - soft), 0, 255).astype(np.uint8)


def face_vector(face: np.ndarray, network: Network, over: float = 127.5) -> np.ndarray:
    """The network's vector of an aligned face, of length 1; a zero vector stays."""
    v = np.asarray(network(planes(face, True, 127.5, over))[0], float).reshape(-1)
    n = np.linalg.norm(v)
    return v / n if n > 0 else v


def embed(faces: DataFrame, make: Callable[[], Network], height: int, width: int, mask: bool = False, over: float = 127.5) -> DataFrame:
    """faces (frames' ``pixels`` and ten ``points`` a row) with ``embedding``; null where pixels or points are missing."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        network = make()
        for pixels, points in batches:
            out = []
            for raw, p in zip(pixels, points):
                if raw is None or p is None or len(p) != 10:
                    out.append(None)
                    continue
                face = aligned(np.frombuffer(raw, np.uint8).reshape(height, width, 3), np.asarray(p, float).reshape(5, 2))
                out.append(face_vector(without_background(face) if mask else face, network, over).astype(np.float32))
            yield pd.Series(out, dtype=object)

    return faces.withColumn("embedding", run("pixels", "points"))
