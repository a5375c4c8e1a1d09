"""Pixel kernels, detectors and faces against plain loops and planted answers; night motion end to end."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchloom.operators import detectors as D
from watchloom.operators import frames as O
from watchloom.operators import pixels as X
from watchloom.plans import file_pipeline
from watchloom.sources import readers, sinks
from watchloom.streaming import clusters as K

RNG = np.random.default_rng(3)


def test_size_and_blur():
    a = RNG.integers(0, 256, (8, 12), dtype=np.uint8)
    assert np.array_equal(X.resized(a, 6, 4), np.rint(a.reshape(4, 2, 6, 2).mean(axis=(1, 3))).astype(np.uint8))
    assert np.array_equal(X.resized(a, 12, 8, "linear"), a) and X.resized(a, 5, 3).shape == (3, 5)
    assert abs(X.resized(a.astype(float), 5, 3).mean() - a.mean()) < 1e-9
    assert X.for_inference(a, 0.5, 4).shape == (2, 4) and X.for_inference(a) is a
    flat = np.full((9, 9), 77, np.uint8)
    assert np.array_equal(X.gaussian(flat, 5), flat)
    spot = np.zeros((11, 11))
    spot[5, 5] = 1
    got = X.gaussian(spot, 5)
    assert abs(got.sum() - 1) < 1e-9 and np.allclose(got, got.T) and got.argmax() == 60


def test_equalised_stretches_low_contrast():
    ramp = np.tile(np.linspace(100, 130, 64).astype(np.uint8), (64, 1))
    out = X.equalised(ramp, 40.0, 1)
    assert out.min() < 20 and out.max() == 255 and (np.diff(out[0].astype(int)) >= 0).all()
    assert X.equalised(RNG.integers(0, 256, (30, 50), dtype=np.uint8), 2.5, 8).shape == (30, 50)


def _flood(mask):
    left, out = {tuple(p) for p in np.argwhere(mask)}, []
    while left:
        todo = [left.pop()]
        one = set(todo)
        while todo:
            y, x = todo.pop()
            for n in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if n in left:
                    left.remove(n)
                    one.add(n)
                    todo.append(n)
        ys, xs = zip(*one)
        out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, float(len(one)), float(sum(xs)), float(sum(ys))))
    return sorted(out)


@pytest.mark.parametrize("share", [0.0, 0.2, 0.45, 0.8, 1.0])
def test_regions_equal_flood_fill(share):
    for _ in range(5):
        mask = RNG.random((23, 31)) < share
        got = X.regions(mask)
        assert sorted((r["x"], r["y"], r["w"], r["h"], r["area"], r["m10"], r["m01"]) for r in got) == _flood(mask)


def test_morphology():
    assert X.ellipse(3).tolist() == [[False, True, False], [True, True, True], [False, True, False]]
    mask, w = RNG.random((15, 17)) < 0.5, X.ellipse(5)
    near = [(i - 2, j - 2) for i, j in zip(*np.nonzero(w))]
    at = lambda y, x, beyond: mask[y, x] if 0 <= y < 15 and 0 <= x < 17 else beyond
    grown = [[any(at(y - i, x - j, False) for i, j in near) for x in range(17)] for y in range(15)]
    shrunk = [[all(at(y - i, x - j, True) for i, j in near) for x in range(17)] for y in range(15)]
    assert X.dilated(mask, w).tolist() == grown and X.eroded(mask, w).tolist() == shrunk
    speck = np.zeros((20, 20), bool)
    speck[3, 3] = True
    speck[8:16, 8:16] = True
    speck[11, 11] = False
    found = X.regions(X.cleaned(speck))
    assert len(found) == 1 and found[0]["area"] >= 60


def test_edges_and_sharpness():
    step = np.zeros((20, 20), np.uint8)
    step[:, 10:] = 200
    e = X.edges(step, 50, 150)
    assert e.any(axis=1).all() and e.sum(axis=1).max() == 1 and not X.edges(np.full((9, 9), 50, np.uint8), 50, 150).any()
    faint = np.zeros((20, 20), np.uint8)
    faint[:, 10:] = 20
    assert X.edges(faint, 50, 150).sum() == 0 < X.edges(faint, 50, 70).sum()
    assert X.sharpness(step) > X.sharpness(X.gaussian(step, 5)) > 0


@pytest.mark.parametrize("make", [lambda: X.RunningAverage(25), X.Mixture, lambda: X.LagDifference(25)])
def test_backgrounds_see_what_comes_in(make):
    b = make()
    for _ in range(40):
        still = b.apply(np.clip(RNG.normal(90, 1, (12, 12)), 0, 255).astype(np.uint8))
    assert not still.any()
    now = np.full((12, 12), 90, np.uint8)
    now[4:8, 4:8] = 220
    moving = b.apply(now)
    assert moving[4:8, 4:8].all() and moving.sum() == 16


def _night_clip(n=60):
    frames = []
    for i in range(n):
        f = np.full((96, 128, 3), 60, np.uint8)
        if i >= 40:
            f[30:62, 10 + (i - 40) * 3 : 42 + (i - 40) * 3] = 230
        frames.append(f.tobytes())
    return frames


def test_night_motion_feeds_the_night_plan(spark):
    clip = _night_clip()
    rows = [(s, i, bytearray(p)) for s in (0, 1) for i, p in enumerate(clip) if s or i < 40] + [(1, 60, None)]
    images = spark.createDataFrame(rows, "stream_id long, frame_index long, pixels binary")
    motion = X.night_motion(images, 96, 128).cache()
    assert motion.count() == 100
    per = {(r["stream_id"], r["frame_index"]): r for r in motion.collect()}
    assert all(per[s, i]["ratio"] == 0 and not per[s, i]["regions"] for s in (0, 1) for i in range(40))
    seen = per[1, 45]
    assert seen["ratio"] > 0.05 and seen["regions"]
    box = O.motion_regions(X.region_rows(motion.where("stream_id = 1 and frame_index = 45")), 0.5, 128, 96, 50).where("rank = 1").first()
    assert abs(box["cx"] - 38) < 16 and abs(box["cy"] - 46) < 10
    frames = motion.select("stream_id", "frame_index", "ratio", F.lit(0.0).alias("energy"))
    keep = file_pipeline.night_keep(frames, 2, "high", regions=X.region_rows(motion), scale=0.5, size=(128, 96))
    got = {tuple(r) for r in keep.select("stream_id", "frame_index").collect()}
    assert got and all(s == 1 and i >= 37 for s, i in got) and {(1, 45), (1, 50)} <= got


def test_motion_features(spark):
    clip = _night_clip()[38:44]
    images = spark.createDataFrame([(7, i, bytearray(p)) for i, p in enumerate(clip)], "stream_id long, frame_index long, pixels binary")
    got = O.score_motion(X.motion_features(images, 96, 128)).orderBy("frame_index").collect()
    grey = [np.frombuffer(p, np.uint8).reshape(96, 128, 3)[:, :, 0].astype(float) for p in clip]
    assert np.allclose([r["energy"] for r in got], [0] + [np.abs(a - b).mean() for a, b in zip(grey, grey[1:])])
    assert got[0]["edge"] == 0 < got[3]["edge"] and [r["top_label"] for r in got][:3] == ["static_low", "static_low", "motion_low"]


def _levels(side, hits):
    """Network outputs with the hits (level, place, score, reach, points)."""
    out = [np.zeros(((side // s) ** 2 * D.ANCHORS, w), np.float32) for w in (1, 4, 10) for s in D.STRIDES]
    for level, place, score, reach, points in hits:
        out[level][place], out[level + 3][place], out[level + 6][place] = score, reach, points
    return out


def test_anchor_faces():
    side = 64
    place = (2 * (side // 8) + 3) * 2 + 1  # row 2, column 3, second anchor
    hits = [(0, place, 0.9, [1, 1, 2, 2], range(10)), (0, place - 1, 0.8, [1, 1, 2, 1.9], [0] * 10), (2, 0, 0.5, [0, 0, 0.5, 0.5], [0] * 10)]
    inputs = []
    net = lambda x: inputs.append(x) or _levels(side, hits)
    image = RNG.integers(0, 256, (64, 128, 3), dtype=np.uint8)
    got = D.AnchorFaces(net, side=side)(image)
    assert inputs[0].shape == (1, 3, 64, 64) and inputs[0][0, :, 32:].max() == 0 and inputs[0].max() <= 1
    # scale 0.5: anchor (3.5, 2.5) * 8 reaches 8 back and 16 on
    assert got.boxes.tolist() == [[40.0, 24.0, 88.0, 72.0], [32.0, 32.0, 64.0, 64.0]] and np.allclose(got.scores, [0.9, 0.5])
    assert got.points[0].tolist() == [[(28 + 16 * i) * 2, (20 + 16 * i + 8) * 2] for i in range(5)]
    other = D.AnchorFaces(net, offset=0.0, strict=True, stretch=True, limit=None, side=side)(image)
    assert other.boxes.tolist()[-1] == [32.0, 8.0, 80.0, 32.0] and len(other.boxes) == 2 and inputs[1].min() >= -1
    assert len(D.AnchorFaces(lambda x: _levels(side, []), side=side)(image).boxes) == 0


def test_persons_and_listed_faces():
    out = np.zeros((1, 84, 5))
    out[0, :5, 0] = [32, 32, 16, 8, 0.9]
    out[0, :5, 1] = [33, 32, 16, 8, 0.6]
    out[0, :5, 2] = [2, 17, 30, 4, 0.7]
    out[0, 6, 3] = 0.99  # another class
    got = D.Persons(lambda x: [out], side=64)(np.zeros((64, 128, 3), np.uint8))
    assert got.boxes.tolist() == [[48.0, 24.0, 80.0, 40.0], [0.0, 0.0, 34.0, 6.0]]
    row = [10, 20, 4, 6, *range(10), 0.8]
    faces = D.ListedFaces(lambda c: np.array([row, row[:-1] + [0.3]]), side=64)(np.zeros((64, 128, 3), np.uint8))
    assert faces.boxes.tolist() == [[20.0, 8.0, 28.0, 20.0]] and faces.points[0, 0].tolist() == [0.0, -30.0]
    assert len(D.ListedFaces(lambda c: None)(np.zeros((8, 8, 3), np.uint8)).boxes) == 0
    with pytest.raises(ValueError):
        D.detector({"detector_type": "x"})


def test_aligned_faces_lie_alike():
    face = X.gaussian(RNG.integers(0, 256, (112, 112, 3), dtype=np.uint8).astype(float), 15)
    face = np.clip((face - face.mean()) * 4 + 127, 0, 255).astype(np.uint8)
    assert np.array_equal(D.aligned(face, D.LANDMARKS), face)
    turned = np.ascontiguousarray(np.rot90(face))  # (x, y) goes to (y, 111 - x)
    points = np.stack([D.LANDMARKS[:, 1], 111 - D.LANDMARKS[:, 0]], axis=1)
    assert np.abs(D.aligned(turned, points).astype(int) - face).max() <= 1
    big = X.resized(face, 224, 224, "linear")
    assert np.abs(D.aligned(big, D.LANDMARKS * 2 + 0.5).astype(int) - face).mean() < 4
    assert D.aligned(face, np.zeros((5, 2))).shape == (112, 112, 3)
    cut = D.without_background(face)
    assert (cut[0, 0] == 127).all() and np.array_equal(cut[56, 56], face[56, 56])


def test_detect_and_embed_run_over_frames(spark):
    image = np.full((32, 32, 3), 9, np.uint8)
    images = spark.createDataFrame([(1, 0, bytearray(image.tobytes())), (1, 1, None)], "stream_id long, frame_index long, pixels binary")
    hits = [(0, 0, 0.9, [0, 0, 1, 1], D.LANDMARKS.ravel().tolist())]
    found = D.detect(images, lambda: D.AnchorFaces(lambda x: _levels(32, hits), side=32), 32, 32, 0.5)
    one = found.collect()
    assert len(one) == 1 and (one[0]["x1"], one[0]["y2"], len(one[0]["points"])) == (4.0, 12.0, 10)
    faces = images.join(found.select("stream_id", "frame_index", "points"), ["stream_id", "frame_index"], "left")
    got = {r["frame_index"]: r["embedding"] for r in D.embed(faces, lambda: lambda x: [np.array([[3.0, 4.0]])], 32, 32, mask=True).collect()}
    assert np.allclose(got[0], [0.6, 0.8]) and got[1] is None


def _wave(width, channels, rate, values):
    import io
    import wave

    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as w:
        w.setparams((channels, width, rate, 0, "NONE", ""))
        w.writeframes(b"".join((v + 128 if width == 1 else v).to_bytes(width, "little", signed=width > 1) for v in values))
    return buffer.getvalue()


def test_sounds_of_any_width_and_rate():
    for width in (1, 2, 3, 4):
        top = 2 ** (8 * width - 1)
        got = [r["x"] for r in readers.pcm_samples(_wave(width, 2, 100, [top // 2, 0, -top, -top]))]
        assert got == [0.25, -1.0]
    up = [r["x"] for r in readers.pcm_samples_at(200)(_wave(2, 1, 100, [0, 16384, 0]))]
    assert up == [0.0, 0.25, 0.5, 0.25, 0.0, 0.0]
    assert list(readers.pcm_samples(b"no sound")) == [] == list(readers.pcm_samples_at()(b""))


def test_copies_skips_and_restarts(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(b"x" * 1000)
    (tmp_path / "b.mp4").write_bytes(b"old")
    assert sinks.copy_clip(spark, f"{tmp_path}/a.mp4", f"{tmp_path}/b.mp4") and (tmp_path / "b.mp4").read_bytes() == b"x" * 1000
    assert not (tmp_path / "b.mp4.part").exists() and not sinks.copy_clip(spark, f"{tmp_path}/none", f"{tmp_path}/c")
    f = spark.range(20).select(F.col("id").alias("frame_index"))
    assert [r[0] for r in O.prefix_sample(f, 3, skip=5).collect()] == [5, 6, 7]

    from pyspark.errors import StreamingQueryException

    class Query:
        left = 2

        def awaitTermination(self):
            if Query.left:
                Query.left -= 1
                raise StreamingQueryException("gone")

    assert K.kept_alive(Query, wait=0) == 2
    Query.left = 3
    with pytest.raises(StreamingQueryException):
        K.kept_alive(Query, wait=0, failures=1)
