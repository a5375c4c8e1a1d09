"""Language ID, quality scores and the source mix recomputed in plain Python through the registered queries."""

import heapq
import math
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.test_operators import SF, WORD, _water
from watchloom.llm import queries as Q
from watchloom.llm.centroid_langid import fit_centroids
from watchloom.llm.quality_llr import exact_quantile, fit_llr, trusted_rows


def _hash(*values):
    """Spark's xxhash64 of strings, longs and (as (value, 4)) ints; None changes nothing."""
    h = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
            h = xxhash.xxh64_intdigest(data, seed=h)
    return h - (1 << 64) if h >> 63 else h


def _docs(spark):
    return [r.asDict() for r in spark.read.parquet(SF + "/documents.parquet").collect()]


def test_quality_scores_threshold_and_verdicts(spark):
    docs = _docs(spark)
    n = Q.QUALITY_FIT["n_buckets"]
    grams = {}
    for r in docs:
        h = [_hash(w) for w in WORD.findall(r["text"] or "")]
        p = [_hash(x, h[i + 1] if i + 1 < len(h) else None) for i, x in enumerate(h)]
        grams[r["doc_id"]] = [x & (n - 1) for x in h + p]
    good = {r["doc_id"] for r in spark.read.parquet(SF + "/labels.parquet").where("quality = 1").collect()}
    assert 0 < len(good) <= Q.QUALITY_FIT["sample_rows"]  # so the whole trusted set is the sample
    raw, target = Counter(x for g in grams.values() for x in g), Counter(x for i in good if i in grams for x in grams[i])
    t, r = sum(target.values()), sum(raw.values())
    weight = [math.log((target[b] + 1) / (t + n)) - math.log((raw[b] + 1) / (r + n)) for b in range(n)]
    score = {i: sum(weight[b] for b in g) / len(g) if g else 0.0 for i, g in grams.items()}
    trusted = sorted(score[i] for i in good if i in grams)
    threshold = float(np.quantile(trusted, 0.005)) - 0.01
    got = Q.op7_quality_rules(spark, SF).collect()
    assert len(got) == len(docs)
    for row in got:
        assert abs(row["llr_score"] - score[row["doc_id"]]) < 1e-5
        if abs(score[row["doc_id"]] - threshold) > 1e-5:
            assert row["kept"] == (not row["base_failed"] and score[row["doc_id"]] > threshold)


def _many_trusted(spark):
    """5500 documents, labels that trust 5000 of them, and the weights and threshold that all of these give."""
    n, texts = Q.QUALITY_FIT["n_buckets"], [(i, f"word{i % 7} of{i % 11} text{i % 5003} {'good' * (i % 5000 == 1)}") for i in range(5500)]
    docs = spark.createDataFrame([(*r, None, None, None) for r in texts], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i < 5000)) for i in range(6000)] + [(3, 1)], "doc_id long, quality int")
    grams = []
    for _, text in texts:
        h = [_hash(w) for w in WORD.findall(text)]
        grams.append([x & (n - 1) for x in h + [_hash(x, h[i + 1] if i + 1 < len(h) else None) for i, x in enumerate(h)]])
    raw, target = Counter(x for g in grams for x in g), Counter(x for g in grams[:5000] for x in g)
    t, r = sum(target.values()), sum(raw.values())
    weight = [math.log((target[b] + 1) / (t + n)) - math.log((raw[b] + 1) / (r + n)) for b in range(n)]
    return docs, labels, weight, np.quantile([sum(weight[b] for b in g) / len(g) for g in grams[:5000]], 0.005) - 0.01


def test_quality_model_counts_every_trusted_row(spark):
    docs, labels, weight, threshold = _many_trusted(spark)
    model = fit_llr(docs, labels, **Q.QUALITY_FIT)
    assert np.allclose(model.weights, weight, atol=1e-12) and abs(model.threshold - threshold) < 1e-5


def test_trusted_rows_are_those_of_the_labels_and_their_plan_is_short(spark):
    key = {"long": lambda i: i, "string": lambda i: f"d{i}"}
    for kind, k in key.items():
        rows = [(k(i) if i % 9 else None, f"text {i}") for i in range(-3000, 3000)] + [(k(5), "again")]
        labels = [(k(i), int(i % 3 == 0)) for i in range(-4000, 2000)] + [(None, 1), (k(4), 1), (k(4), 0), (k(6), None)]
        docs, table = spark.createDataFrame(rows, f"doc_id {kind}, text string"), spark.createDataFrame(labels, f"doc_id {kind}, quality int")
        good = {i for i, q in labels if q and i is not None}
        for t in (table, table.where("false")):
            got = trusted_rows(docs, t, "doc_id", "doc_id", F.expr("quality = 1"), "text")
            assert sorted(r["text"] for r in got.collect()) == sorted(text for i, text in rows if i in good and t is table)
        assert len(got._jdf.queryExecution().toString()) < 50_000  # the driver keeps the plans of all runs


def test_quantile_narrows_to_the_exact_one(spark):
    values = [1.5] * 300 + [float(np.nextafter(1.5, 2))] * 40 + [i * 0.37 - 90 for i in range(500)] + [1e9, -1e12]
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    for q in (0.0, 0.005, 0.25, 0.5, 0.77, 1.0):
        assert exact_quantile(rows, "v", q, few=20, bins=8) == pytest.approx(np.quantile(values, q), rel=1e-12)
    assert exact_quantile(rows.where("v is null"), "v", 0.5) is None


def test_language_is_the_nearest_centroids(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    model = fit_centroids(docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2).select("doc_id", "text", "lang"))
    dims, mask = len(model.idf), 0xFFFFFFFF
    got = {r["doc_id"]: r for r in Q.op5_language_id(spark, SF).collect()}
    df, n_texts = np.zeros(dims), 0
    rows = _docs(spark)
    for r in rows:
        text = (r["text"] or "").lower()
        chars = re.sub(r"(?s)\x00+", "\x00", "".join(c if c.isalpha() else "\x00" for c in text)).replace("\x00", " ").lstrip(" ")
        counts = np.zeros(dims)
        for k in (1, 2, 3):
            for i in range(len(chars) - k + 1):
                gram = 0
                for j, c in enumerate(chars[i : i + k]):
                    gram = (gram * 0x01000193 + ord(c) + j + 1) & mask
                counts[((gram * 0x9E3779B1) & mask) >> (32 - (dims - 1).bit_length())] += 1
        known = any(c.isalpha() for c in text)
        if known and r["lang"] is not None and not got[r["doc_id"]]["held_out"]:
            df, n_texts = df + (counts > 0), n_texts + 1
        v = np.log1p(counts) * model.idf
        cos = model.centroids @ (v / np.linalg.norm(v)) if known else None
        g = got[r["doc_id"]]
        if known:
            assert abs(g["score"] - cos.max()) < 1e-4 and (g["lang_pred"] == model.langs[int(cos.argmax())] or np.sort(cos)[-1] - np.sort(cos)[-2] < 1e-4)
        else:
            assert (g["lang_pred"], g["score"]) == ("und", 0.0)
    assert np.allclose(model.idf, np.log((1 + n_texts) / (1 + df)) + 1, atol=1e-4)


def test_mix_takes_these_words_of_each_row(spark):
    docs = _docs(spark)
    got = {r["doc_id"]: r for r in Q.op9_source_mix(spark, SF).collect()}
    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in docs}
    order = sorted({r["source"] for r in docs}, key=lambda s: (s is None, s or ""))
    held = {s: [r["doc_id"] for r in docs if r["source"] == s] for s in order}
    target = dict(zip(order, _water([sum(size[i] for i in held[s]) for s in order], [[5, 2, 1][k % 3] for k in range(len(order))], 3)))
    seats, block = defaultdict(int), 16
    quotients = [(-target[s], k, s) for k, s in enumerate(order)]
    heapq.heapify(quotients)
    for _ in range(round(sum(target.values()) / block)):
        _, k, s = heapq.heappop(quotients)
        seats[s] += 1
        heapq.heappush(quotients, (-target[s] / (2 * seats[s] + 1), k, s))
    for s in order:
        whole = sum(size[i] for i in held[s])
        wanted = min(seats[s] * block, 3 * whole)
        again, at = wanted % whole if whole else 0, 0
        for i in sorted(held[s], key=lambda i: (_hash((17, 4), i), i)):
            more = max(0, min(again, at + size[i]) - at)
            assert (got[i]["size"], got[i]["taken"]) == (size[i], (wanted // whole if whole else 0) * size[i] + more)
            at += size[i]


def test_pipeline_quality_stage_fits_on_every_trusted_row(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    docs, labels, weight, threshold = _many_trusted(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    fitted = []
    monkeypatch.setattr(corpus_pipeline, "quality_verdicts", lambda d, model, **how: fitted.append(model) or d.withColumn("kept", F.lit(True)))
    assert corpus_pipeline.quality(spark, docs, str(tmp_path)).columns == corpus_pipeline.COLUMNS
    assert np.allclose(fitted[0].weights, weight, atol=1e-12) and abs(fitted[0].threshold - threshold) < 1e-5
