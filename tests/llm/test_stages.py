"""Stages of the corpus pipeline on small made-up rows."""

import random

import corpus_pipeline
from tests.llm.test_operators import _brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", None if t is None else len(t)) for i, t in rows], SCHEMA)


def test_dedup_links_from_80_percent(spark):
    rnd = random.Random(8)
    texts = {}
    for g in range(40):  # one to three of 100 words changed: similarity 0.90, 0.81, 0.73
        base = [f"g{g}w{rnd.randrange(10**6)}" for _ in range(100)]
        for k in range(4):
            copy = list(base)
            for j in range(k):
                copy[20 + 25 * j] = f"x{k}"
            texts[10 * g + k] = " ".join(copy)
    want = {c for _, c in _brute_components(texts, 80).values()}
    assert want < {c for _, c in _brute_components(texts, 85).values()}
    got = [r["doc_id"] for r in corpus_pipeline.dedup(spark, _docs(spark, texts.items()), "").collect()]
    assert sorted(got) == sorted(want)
