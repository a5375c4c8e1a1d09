"""Ordered rules against plain Python; gates on the synthetic clip; stream equals batch; sinks, sources and settings."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchloom import catalogue
from watchloom.functions import geometry as G
from watchloom.functions import scalars as S
from watchloom.functions import vectors as V
from watchloom.operators import chunks as C
from watchloom.operators import frames as O
from watchloom.operators import metrics as M
from watchloom.operators import models as P
from watchloom.operators import registry as R
from watchloom.operators import tracking as T
from watchloom.plans import file_pipeline
from watchloom.plans.settings import RunSettings, broker, brokers, cli_bool, config_bool
from watchloom.sources import readers, sinks
from watchloom.streaming import clusters as K

SF = "/root/testdata/sf0.001"


def flags(spark, values):
    return spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "stream_id long, frame_index long, over boolean")


def test_hysteresis_is_the_state_machine(spark):
    rnd = random.Random(1)
    values = [rnd.random() < (0.8 if i // 20 % 2 else 0.2) for i in range(400)]
    on, want, up, down = False, [], 0, 0
    for v in values:
        up, down = (up + 1, 0) if v else (0, down + 1)
        if not on and up >= 3:
            on = True
        elif on and down >= 4:
            on = False
        want.append(on)
    got = O.hysteresis(flags(spark, values), "over", 3, 4).orderBy("frame_index").collect()
    assert [r["is_motion"] for r in got] == want


def test_suppression_and_background(spark):
    hits = [0, 3, 5, 6, 11, 12, 18]
    got = O.suppress_close(spark.createDataFrame([(0, h) for h in hits], "stream_id long, frame_index long"), 6)
    assert sorted(r["frame_index"] for r in got.collect()) == [0, 6, 12, 18]
    x = [10.0, 20.0, 0.0, 5.0]
    rows = O.running_background(spark.createDataFrame([(0, i, v) for i, v in enumerate(x)], "stream_id long, frame_index long, e double"), "e", 0.5).orderBy("frame_index").collect()
    assert [r["bg"] for r in rows] == [10.0, 15.0, 7.5, 6.25] and rows[0]["diff"] == 0.0


def test_gaps_and_edges(spark):
    keep = spark.createDataFrame([(0, f) for f in (0, 5, 11, 30)], "stream_id long, frame_index long")
    assert sorted(r["frame_index"] for r in O.gap_anchors(keep, 5).collect()) == [8, 20]
    one = spark.createDataFrame([(0, 0, 9.0, 20.0)], "stream_id long, frame_index long, energy double, edge double")
    assert [tuple(r) for r in O.keep_frames(one, stride=4, conf_delta=0.1, pad=2, max_gap=5).collect()] == [(0, 0)]
    still = spark.createDataFrame([(0, i, 1.0) for i in range(9)], "stream_id long, frame_index long, rms double")
    assert O.spikes_raw(still, 1.0, 1.0).count() == 0


def test_leader_clusters_and_agglomeration():
    rng = np.random.default_rng(0)
    base = np.eye(6)[:3]
    v = np.vstack([b + rng.normal(0, 0.05, 6) for b in base for _ in range(4)])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    members, centres = R.lead_clusters(v, 0.8)
    assert [len(m) for m in members] == [4, 4, 4]
    assert len(R.agglomerate(members, centres, -0.5)) == 1 and len(R.agglomerate(members, centres, 0.8)) == 3


def test_dedup_gates(spark):
    row = lambda i, *v: (i, 0, list(v))
    d = "id long, site_id int, embedding array<double>"
    got = R.dedup_online(spark.createDataFrame([row(1, 1.0, 0.0), row(2, 0.99, 0.1), row(3, 0.0, 1.0)], d), spark.createDataFrame([row(9, 0.0, 1.0)], d), 0.9)
    assert {r["id"]: r["gate"] for r in got.collect()} == {1: "accepted", 2: "cache", 3: "stored"}


def test_suppression_orders_and_trackers():
    b = np.array([[0, 0, 10, 10], [1, 1, 11, 11], [0, 0, 30, 30], [50, 50, 60, 60]], dtype=float)
    assert T.suppressed(b, np.array([0.9, 0.8, 0.1, 0.5]), 0.4) == [0, 3, 2]
    det = lambda x, name="a", score=0.5: {"box": (x, 0, x + 10, 10), "uuid": name, "name": name, "score": score, "hist": [x, 1, 2]}
    g = T.GreedyIoU(0.4, max_age=1)
    assert [t for t, _ in g.update([det(0), det(40)])] == [0, 1]
    assert sorted(t for t, _ in g.update([det(41), det(1), det(90)])) == [0, 1, 2]
    g.update([])
    g.update([])
    assert [t for t, _ in g.update([det(0)])] == [3]
    assert T.majority([("a", "x", 0.2), ("b", "y", 0.9), ("a", "z", 0.4), ("b", "w", 0.3)])[0] == "b"
    a = T.AppearanceTracker(0.3, 0.9, max_age=0, lost_age=9)
    a.update([{"box": (0, 0, 10, 10), "hist": [1, 5, 2]}])
    a.update([])
    assert [t for t, _ in a.update([{"box": (50, 0, 60, 10), "hist": [1, 5, 2]}])] == [0]
    assert [t for t, _ in a.update([{"box": (50, 0, 60, 10), "hist": [1, 5, 2]}, {"box": (90, 0, 99, 10), "hist": [5, 1, 2]}])] == [0, 1]


def test_synthetic_clip_passes_the_gates(spark):
    clip, labels = readers.synthetic_clip(spark)
    keep = O.keep_frames(clip, stride=2, conf_delta=0.08, pad=2, max_gap=25)
    hits = O.action_triggers(O.sample_stride(O.score_motion(clip), 2), 0.08, 25.0).select("stream_id", "frame_index")
    assert M.event_retention(labels, keep, 5).first()["retention"] >= 0.95
    assert M.change_point_scores(labels, hits, 4).first()["recall"] >= 0.5
    assert keep.count() < 90
    stable = M.label_stability(labels, O.consecutive(O.sample_stride(O.score_motion(clip), 2)), 6).first()
    assert stable["stability"] == 1.0


def _scored(spark):
    return O.score_motion(catalogue.frames(spark, SF)).select("stream_id", "frame_index", "class_id", "confidence")


def test_stream_equals_batch(spark, tmp_path):
    s = K.ClusterSettings(fps=5.0, seconds=2.0, stride=2)
    f = _scored(spark).withColumn("final", F.col("frame_index") == F.max("frame_index").over(O.whole()))
    want = sorted(map(tuple, K.event_clusters(f, s).collect()))
    for k in range(3):  # arrival in three files, in frame order
        part = f.where(f"frame_index >= {k * 20}" + (f" and frame_index < {k * 20 + 20}" if k < 2 else ""))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for k, v in K.ROCKSDB.items():
        spark.conf.set(k, v)
    live = K.event_clusters_stream(readers.frames(spark, str(tmp_path / "in"), live=True, files_per_trigger=1), s)
    fail = lambda values: (_ for _ in ()).throw(OSError("no broker"))
    q = sinks.start_chunk_sink(live, str(tmp_path / "out"), str(tmp_path / "ck"), lambda c: c.select(F.to_json(F.struct("*")).alias("value")), fail)
    q.awaitTermination(100)
    got = spark.read.schema(K.CHUNK).json(str(tmp_path / "out/chunks")).drop("batch")
    assert sorted(map(tuple, got.collect())) == want
    assert spark.read.text(str(tmp_path / "out/spool")).count() == len(want)
    assert sinks.stream_summary(spark, str(tmp_path / "out")).agg(F.sum("chunks")).first()[0] == len(want)


def test_night_clusters_and_overlap():
    c, s, out = K.Cluster(), K.ClusterSettings(fps=10.0, seconds=1.0, night=True), []
    for f in range(60):
        out += c.step(s, f, 0, 0.5, motion=20 <= f < 40)
    out += c.flush(until=59)
    assert [x[1:3] for x in out][0] == (15, 30) and out[1][1] <= out[0][2] and all(x[3] > 0 for x in out)


def test_pipeline_and_sinks(spark, tmp_path):
    f = catalogue.frames(spark, SF)
    s = RunSettings(publish=True, site_id="s", camera_id="c", max_gap=5, fps=5.0, audio_spikes=True, night_limit=48.0)
    r = file_pipeline.run(f, s, saturation="edge")
    assert r.keep.count() + r.dropped.count() == f.count() and r.segments.count() > 0
    sinks.write_chunks(r.records, str(tmp_path / "chunks"))
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == r.keep.count()
    values = C.message_json(r.messages)
    assert sinks.publish(values, sinks.json_writer(str(tmp_path / "topic")), str(tmp_path / "spool"))
    m = json.loads(spark.read.text(str(tmp_path / "topic")).first()[0])
    assert m["asset_id"] == "run" and m["metadata"]["sp_enabled"] == "true" and "frames" not in m["event_metadata"]
    bad = lambda v: (_ for _ in ()).throw(OSError("down"))
    assert not sinks.publish(values, bad, str(tmp_path / "spool")) and spark.read.text(str(tmp_path / "spool")).count() == values.count()
    with pytest.raises(OSError):
        sinks.publish(values, bad, str(tmp_path / "spool"), required=True)
    full = C.chunk_summary(r.records, C.ChunkSettings(), with_frames=True)
    sinks.write_sidecars(full, str(tmp_path / "side"))
    assert spark.read.json(str(tmp_path / "side")).count() == full.count()
    sinks.filter_metadata(r.keep, r.dropped, O.correlation_timeline(O.sample_stride(O.score_motion(f), 4), 0.1, 5.0), str(tmp_path / "meta"))
    sinks.write_kept(r.keep, str(tmp_path / "kept"))
    rows = catalogue.site_rows(spark, SF)
    sinks.replace_registry(rows, str(tmp_path / "reg"))
    sinks.append_registry(rows.limit(3), str(tmp_path / "reg"))
    assert readers.registry(spark, str(tmp_path / "reg"), columns=["id", "name"]).count() == rows.count() + 3
    report = file_pipeline.timed({"keep": r.keep.count, "none": lambda: None})
    sinks.write_report(report, str(tmp_path / "r.json"))
    assert json.load(open(tmp_path / "r.json"))["bottleneck"] == "keep"
    assert sinks.chunk_folder(None, "", "/a") == "/a"
    tally = C.publish_tally(spark.createDataFrame([(True,), (False,), (True,)], "published boolean")).first()
    assert tuple(tally) == (3, 2, 1)


def test_sources(spark, tmp_path):
    import io
    import wave

    assert readers.is_live("RTSP://x") and not readers.is_live("/a/b.mp4")
    (tmp_path / "tags.csv").write_text("uuid,name,role\n1,Ann,guard\n ,x,\n2,,\n")
    tags = readers.tags_csv(spark, str(tmp_path / "tags.csv"))
    assert tags.columns == ["id", "name", "role", "department", "notes"] and R.valid_tags(tags).count() == 1
    (tmp_path / "roi.json").write_text(json.dumps({"imageWidth": 100, "imageHeight": 50, "shapes": [{"shape_type": "rectangle", "points": [[10, 10], [20, 20]]}]}))
    shapes = readers.scaled_shapes(readers.roi_shapes(spark, str(tmp_path / "roi.json")), 200, 100)
    got = shapes.select(G.in_any_shape(F.lit(30.0), F.lit(30.0), F.col("shapes")).alias("a"), G.in_any_shape(F.lit(50.0), F.lit(30.0), F.col("shapes")).alias("b")).first()
    assert tuple(got) == (True, False)
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as w:
        w.setparams((1, 2, 100, 0, "NONE", ""))
        w.writeframes(np.array([0, 16384, -16384, 0], dtype="<i2").tobytes())
    (tmp_path / "a.wav").write_bytes(buffer.getvalue())
    samples = readers.decoded(readers.binary_files(spark, str(tmp_path), "*.wav"), readers.pcm_samples, "sample_index bigint, x double")
    assert [r["x"] for r in samples.orderBy("sample_index").collect()] == [0.0, 0.5, -0.5, 0.0]
    (tmp_path / "c.json").write_text('{"stride": 8, "other": 1}')
    s = RunSettings.of(readers.config(str(tmp_path / "c.json")), conf_delta=0.2, pad=None)
    assert (s.stride, s.conf_delta, s.pad, s.extra) == (8, 0.2, 2, {"other": 1})
    dim = readers.stream_dimension(catalogue.frames(spark, SF), 25.0, 640, 360).first()
    assert dim["duration_sec"] == dim["frame_count"] / 25.0


def test_settings():
    assert cli_bool(" YES ") and not cli_bool("off") and config_bool("off") and not config_bool(" no ") and config_bool(3, False) is False
    with pytest.raises(ValueError):
        cli_bool("maybe")
    assert broker("https://h/") == "h:9092" and brokers({"brokers": "a:1, b,"}) == "a:1,b:9092"
    for bad in (RunSettings(filter=False, chunk=False), RunSettings(chunk=False, publish=True), RunSettings(publish=True), RunSettings(stride=0)):
        with pytest.raises(ValueError):
            bad.check()
    o = sinks.kafka_options({"brokers": "h", "topic": "t", "sasl_username": "u", "sasl_password": "p", "linger_ms": 5})
    assert o["kafka.bootstrap.servers"] == "h:9092" and o["kafka.linger.ms"] == "5" and 'username="u"' in o["kafka.sasl.jaas.config"]


def test_scalars_and_vectors(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    assert value(S.frames_per_chunk(F.lit(5.0), F.lit(0.5))) == 2 and value(S.duration_ms(F.lit(1), F.lit(16.0))) == 62
    assert value(S.frame_timestamp_ms(F.lit(5), F.lit(1), F.lit(16.0))) == 67 and value(S.stream_chunk_start_ms(F.lit(0), F.lit(1), F.lit(16.0))) == 62
    assert [value(S.three_digits(F.lit(x))) for x in (0.1805, 0.1735, 0.0625, 1.9996)] == [f"{x:.3f}" for x in (0.1805, 0.1735, 0.0625, 1.9996)]
    assert value(S.mask_secret(F.lit("secret"))) == "se***" and value(S.mask_secret(F.lit("ab"))) == "***" and value(S.mask_secret(F.lit(None).cast("string"))) == ""
    assert value(S.person_label(F.lit("Ann"), F.lit("u"), F.lit(0.84))) == "Ann (84%)" and value(S.person_label(F.lit(""), F.lit("123456789"), F.lit(0.1))) == "Unknown [12345678]"
    assert S.preset("none") == S.PRESETS["medium"] and value(S.noise_threshold(F.lit(None).cast("double"))) == 25
    assert value(S.alert_level(F.lit(None).cast("string"), F.lit("TRUE"))) == "true" and value(S.provided_or_kept(F.lit(""), F.lit("x"))) == ""
    a = lambda *v: F.array(*map(F.lit, v))
    assert value(V.cosine(a(0.0, 0.0), a(1.0, 0.0))) == 1.0 and value(V.cosine(a(1.0, 0.0), a(-1.0, 0.0))) == 0.0
    assert value(V.unit(a(3.0, 4.0))) == [0.6, 0.8] and value(V.argmax(a(1.0, 3.0, 3.0))) == 1
    assert abs(sum(value(V.softmax(a(1.0, 2.0, 900.0)))) - 1) < 1e-12 and abs(value(V.correlation(a(1.0, 2.0, 3.0), a(2.0, 4.0, 6.0))) - 1) < 1e-9
    box = lambda *v: tuple(map(F.lit, v))
    assert value(G.iou(box(0.0, 0.0, 1.0, 1.0), box(0.0, 0.0, 0.0, 0.0))) == 0.0 and value(F.array(*G.padded(box(0.0, 0.0, 10.0, 10.0), 0.1, F.lit(10.5), F.lit(20.0)))) == [0.0, 0.0, 10.5, 11.0]
    assert value(F.array(*G.centre_to_corners(*box(5.0, 5.0, 4.0, 2.0)))) == [3.0, 4.0, 7.0, 6.0] and value(F.array(*G.unletterbox(box(2.0, 2.0, 4.0, 4.0), F.lit(2.0), F.lit(0.0), F.lit(2.0)))) == [1.0, 0.0, 2.0, 1.0]


def test_models(spark):
    f = O.clip_windows(catalogue.frames(spark, SF).limit(50), "energy", 4)
    assert {r["n"] for r in f.select(F.size("clip").alias("n")).collect()} == {4}
    got = P.predict_clips(f, P.backend("onnx", path="/none", labels=[])).select("prediction.*").collect()
    assert len(got) == 50 and all(r["top_label"] in S.MOTION_LABELS for r in got)
    pixels = bytes(np.full((4, 4, 3), [0, 0, 255], dtype=np.uint8))
    r = P.frame_features(spark.createDataFrame([(0, 0, bytearray(pixels))], "stream_id long, frame_index long, pixels binary"), 4, 4).first()
    assert r["saturation"] == 255.0 and r["blur"] < 1e-9
