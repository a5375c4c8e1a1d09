"""Model plug-ins: anything that turns clips of frame features into predictions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.functions import scalars as S

PREDICTION = "struct<class_id:int,confidence:double,top_label:string,logits:array<float>>"


class Backend:
    """Predicts batches of clips; made once per Python worker, when the first batch comes."""

    name = "backend"

    def predict(self, clips: list[np.ndarray]) -> list[tuple[int, float, str, list[float] | None]]:
        raise NotImplementedError


class MotionEnergy(Backend):
    """The motion rule on clips of scalar frames: mean absolute difference of neighbours, mean value as edge density."""

    name = "motion"

    def predict(self, clips):
        out = []
        for c in clips:
            c = np.asarray(c, dtype=float)
            energy = float(np.abs(np.diff(c)).mean()) if len(c) > 1 else 0.0
            k = 2 * (energy > S.ENERGY_LIMIT) + int(c.mean() > S.EDGE_LIMIT)
            conf = min(1.0, 0.5 + energy / S.ENERGY_SCALE)
            out.append((int(k), conf, S.MOTION_LABELS[k], [1.0 if i == k else 0.0 for i in range(4)]))
        return out


class OnnxBackend(Backend):
    """A classifier in ONNX: one input of clips, one output of logits."""

    name = "onnx"

    def __init__(self, path: str, labels: list[str]):
        import onnxruntime

        self.session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        self.labels = labels

    def predict(self, clips):
        x = np.stack([np.asarray(c, dtype=np.float32) for c in clips])
        logits = self.session.run(None, {self.session.get_inputs()[0].name: x})[0]
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        return [(int(i), float(p[n, i]), self.labels[i], [float(v) for v in logits[n]]) for n, i in enumerate(p.argmax(axis=1))]


def backend(name: str, **options) -> Callable[[], Backend]:
    """A maker of the named backend; whatever can't be made becomes the motion rule."""

    def make() -> Backend:
        try:
            return OnnxBackend(**options) if name == "onnx" else MotionEnergy()
        except Exception:  # noqa: BLE001  any failure of a model falls back
            return MotionEnergy()

    return make


def predict_clips(frames: DataFrame, make: Callable[[], Backend], clip: str = "clip", batch: int = 8) -> DataFrame:
    """Adds prediction for each row's clip, in batches; sample before this: Catalyst moves no filter below it."""

    @F.pandas_udf(PREDICTION)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()
        for clips in batches:
            rows = []
            for i in range(0, len(clips), batch):
                rows += model.predict(clips.iloc[i : i + batch].tolist())
            yield pd.DataFrame(rows, columns=["class_id", "confidence", "top_label", "logits"])

    return frames.withColumn("prediction", run(F.col(clip)))


def ensemble_predictions(frames: DataFrame, model: Column, motion: Column) -> DataFrame:
    return frames.withColumn("prediction", S.ensemble(model["class_id"], model["confidence"], model["top_label"], motion["class_id"], motion["confidence"], motion["top_label"]))


def frame_features(images: DataFrame, height: int, width: int) -> DataFrame:
    """(stream_id, frame_index, saturation, luma, blur) of raw BGR frames in a binary column ``pixels``."""

    @F.pandas_udf("struct<saturation:double,luma:double,blur:double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pixels in batches:
            rows = []
            for p in pixels:
                x = np.frombuffer(p, dtype=np.uint8).reshape(height, width, 3).astype(float)
                top, low = x.max(axis=2), x.min(axis=2)
                sat = np.where(top > 0, (top - low) / np.maximum(top, 1) * 255, 0)
                grey = x @ np.array([0.114, 0.587, 0.299])
                lap = grey[1:-1, :-2] + grey[1:-1, 2:] + grey[:-2, 1:-1] + grey[2:, 1:-1] - 4 * grey[1:-1, 1:-1]
                rows.append((float(sat.mean()), float(grey.mean()), float(lap.var()) if lap.size else 0.0))
            yield pd.DataFrame(rows, columns=["saturation", "luma", "blur"])

    return images.select("stream_id", "frame_index", run(F.col("pixels")).alias("_f")).select("stream_id", "frame_index", "_f.*")
