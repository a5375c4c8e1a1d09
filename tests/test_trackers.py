"""Trackers, agglomeration and folds against plain versions that go frame by frame and pair by pair."""

import random

import numpy as np
from pyspark.sql import functions as F

from watchloom.operators import frames as O
from watchloom.operators import registry as R
from watchloom.operators import tracking as T
from watchloom.plans import file_pipeline
from watchloom.sources import readers


def _iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0, w) * max(0, h)
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)


def _plain(kind, frames, least, max_age):
    """[(frame, det, track)] of one stream; frames: {index: [(det, box, name)]}."""
    tracks, out, fresh = [], [], 0
    for f in range(min(frames), max(frames) + 1):
        seen = frames.get(f, [])
        found = {}
        if kind == "greedy":
            for t in tracks:
                t["age"] += 1
            for k, (_, box, _) in enumerate(seen):
                best = [(_iou(box, t["box"]), -n) for n, t in enumerate(tracks) if n not in found.values()]
                v, n = max(best, default=(0, 0))
                if v > 0 and v >= least:
                    found[k] = -n
        else:
            pairs = sorted(((-_iou(t["box"], s[1]), n, k) for n, t in enumerate(tracks) for k, s in enumerate(seen)))
            for v, n, k in pairs:
                if -v >= least and k not in found and n not in found.values():
                    found[k] = n
            for n, t in enumerate(tracks):
                t["age"] += n not in found.values()
        for k, n in found.items():
            tracks[n] |= {"box": seen[k][1], "age": 0}
            out.append((f, seen[k][0], tracks[n]["id"]))
        if kind == "global":
            tracks = [t for t in tracks if t["age"] <= max_age]
        for k, (det, box, _) in enumerate(seen):
            if k not in found:
                tracks.append({"id": fresh, "box": box, "age": 0})
                out.append((f, det, fresh))
                fresh += 1
        tracks = [t for t in tracks if t["age"] <= max_age]
    return sorted(out)


def test_trackers_equal_plain_versions_over_gaps(spark):
    rnd = random.Random(4)
    rows, streams = [], {}
    for s in range(3):
        f, n, frames = 0, 0, {}
        for _ in range(80):
            f += rnd.choice([1, 1, 1, 2, 4, 9])
            frames[f] = []
            for _ in range(rnd.randrange(1, 5)):
                x, y = rnd.randrange(60), rnd.randrange(40)
                frames[f].append((n, (x, y, x + 25, y + 30), f"n{n % 3}"))
                n += 1
        streams[s] = frames
        rows += [(s, f, d, *map(float, b), name, name, 0.5) for f, seen in frames.items() for d, b, name in seen]
    rnd.shuffle(rows)
    det = spark.createDataFrame(rows, "stream_id long, frame_index long, det long, x1 double, y1 double, x2 double, y2 double, uuid string, name string, score double")
    for kind, make, least, age in (("greedy", T.GreedyIoU, 0.3, 4), ("global", T.GlobalIoU, 0.25, 3)):
        got = T.track(det.repartition(5), lambda make=make, least=least, age=age: make(least, age)).collect()
        for s, frames in streams.items():
            assert sorted((r["frame_index"], r["det"], r["track_id"]) for r in got if r["stream_id"] == s) == _plain(kind, frames, least, age)


def test_skipped_frames_age_tracks_as_empty_ones_do():
    rnd = random.Random(9)
    for make in (lambda: T.GreedyIoU(0.3, 5), lambda: T.GlobalIoU(0.3, 5), lambda: T.AppearanceTracker(0.3, 0.7, 3, 12)):
        a, b = make(), make()
        for _ in range(150):
            gap = rnd.choice([0, 0, 1, 3, 7])
            seen = [{"box": (x, 0, x + 10, 10), "uuid": "u", "name": "n", "score": 0.1, "hist": [rnd.random() for _ in range(4)]} for x in rnd.sample(range(60), 3)]
            for _ in range(gap):
                a.update([])
            b.skip(gap)
            assert [t for t, _ in a.update(seen)] == [t for t, _ in b.update(seen)]


def test_agglomeration_equals_a_full_search():
    rng = np.random.default_rng(3)
    for n, t in ((2, 0.1), (30, 0.2), (60, 0.0), (25, -2.0)):
        c = rng.normal(size=(n, 5)) + 0.4
        c /= np.linalg.norm(c, axis=1, keepdims=True)
        sizes = rng.integers(1, 6, n)
        members = [[int(sum(sizes[:i]) + k) for k in range(sizes[i])] for i in range(n)]
        groups = {i: (list(members[i]), c[i].copy()) for i in range(n)}
        while len(groups) > 1:
            v, i, j = max((float(groups[i][1] @ groups[j][1]), -i, -j) for i in groups for j in groups if i < j)
            if v < t:
                break
            (mi, ci), (mj, cj) = groups[-i], groups.pop(-j)
            m = ci * len(mi) + cj * len(mj)
            groups[-i] = (mi + mj, m / np.linalg.norm(m))
        got = R.agglomerate(members, c, t)
        assert sorted(map(sorted, got)) == sorted(sorted(m) for m, _ in groups.values())


def test_folds_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(s, f, float((f * 7 + s) % 13)) for s in range(4) for f in range(50)]
        d = spark.createDataFrame(rows, "stream_id long, frame_index long, e double").repartition(3)
        got = {(r["stream_id"], r["frame_index"]): r["bg"] for r in O.running_background(d, "e", 0.25).collect()}
        for s in range(4):
            bg = None
            for f in range(50):
                x = float((f * 7 + s) % 13)
                bg = x if bg is None else 0.75 * bg + 0.25 * x
                assert abs(got[s, f] - bg) < 1e-9
        assert sorted(r["frame_index"] for r in O.suppress_close(d.where("stream_id = 1"), 6).collect()) == list(range(0, 50, 6))
        b = d.select("stream_id", (F.col("frame_index") / 5).cast("long").alias("frame_index"), F.col("frame_index").alias("det"), F.col("e").alias("x1"), F.lit(0.0).alias("y1"), (F.col("e") + 10).alias("x2"), F.lit(9.0).alias("y2"), (F.col("e") / 20).alias("score"))
        small = {(r["stream_id"], r["det"]) for r in T.non_max_suppression(b, 0.3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert small == {(r["stream_id"], r["det"]) for r in T.non_max_suppression(b, 0.3).collect()}


def test_night_plan_uses_ratio_regions_and_warmup(spark):
    f = spark.createDataFrame([(0, i, 100.0 * (i % 2), 0.5 if i < 60 else 0.0001) for i in range(90)], "stream_id long, frame_index long, energy double, ratio double")
    region = lambda frames, area: spark.createDataFrame([(0, i, 1, 5, 5, 40, 40, float(area), 0.0, 0.0, 0.0) for i in frames], "stream_id long, frame_index long, region long, x long, y long, w long, h long, area double, m00 double, m10 double, m01 double")
    frames = lambda d: sorted(r["frame_index"] for r in d.collect())
    assert frames(file_pipeline.night_keep(f, 0, "medium"))[0] >= 30
    moving = frames(file_pipeline.night_keep(f, 0, "medium", regions=region(range(40, 90), 900)))
    assert moving[0] == 41 and moving[-1] == 63  # two frames confirm, five clear; from 60 on the ratio is too small
    assert frames(file_pipeline.night_keep(f, 0, "medium", regions=region(range(90), 500))) == []


def test_centroid_files_warm_names_and_soak(spark, tmp_path):
    np.save(tmp_path / "Ann.npy", np.array([1.0, 0.0]))
    np.save(tmp_path / "Bob.npy", np.array([[0.0, 1.0], [0.0, 3.0]]))
    got = {r["name"]: r["embedding"] for r in readers.centroid_files(spark, str(tmp_path)).collect()}
    assert got == {"Ann": [1.0, 0.0], "Bob": [0.0, 2.0]}
    tracks = spark.createDataFrame([(0, 5, 1), (0, 6, 2), (0, 7, 3), (1, 9, 4)], "stream_id long, track_id long, frame_index long")
    stored = spark.createDataFrame([(0, 6, "Zoe")], "stream_id long, track_id long, name string")
    names = {(r["stream_id"], r["track_id"]): r["name"] for r in T.track_names(tracks, ["A", "B"], stored).collect()}
    assert names == {(0, 5): "B", (0, 6): "Zoe", (0, 7): "Person_7", (1, 9): "A"}
    calls = iter([1, 0, 2])
    told = file_pipeline.soak(lambda: 1 / next(calls), 3)
    assert (told["iterations"], told["failures"], told["errors"][0]["iteration"]) == (3, 1, 1) and told["mean_ms"] >= 0
    sizes = R.cluster_sizes(spark.createDataFrame([(0, i, 0 if i < 2 else 2) for i in range(5)], "site_id long, id long, cluster long")).collect()
    assert [(r["cluster"], r["size"]) for r in sizes] == [(2, 3), (0, 2)]


def test_approximate_neighbours_find_most_of_the_exact_ones(spark):
    from watchloom import catalogue

    d = "/root/testdata/sf0.01"
    rows = catalogue.site_rows(spark, d)
    near = R.nearest(rows.where("id % 10 = 0").withColumn("site_id", F.lit(0)), rows.withColumn("site_id", F.lit(0)), k=1000, threshold=0.35, exclude_self=True)
    exact = {(r["query_id"], r["id"]) for r in near.collect()}  # cosine 0.35: distance 1.14 of unit vectors
    got = {(r["query_id"], r["id"]) for r in catalogue.nn_approximate(spark, d).collect()}
    assert len(exact) > 10 and len(exact & got) >= 0.9 * len(exact)
