"""Each stage of the corpus pipeline on nulls, empty and long texts, ties, repeated rows and ids, extra columns and empty tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

rnd = random.Random(11)
PROSE = [" ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rnd.randrange(90)) for _ in range(120)) for _ in range(4)]
LONG = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(60_000))
ROWS = [
    (1, PROSE[0], "en", "s"),
    (1, PROSE[0], "en", "s"),
    (2, PROSE[0], None, None),
    (3, PROSE[1], "en", "s"),
    (3, PROSE[2] + " card 4111 1111 1111 1111", "en", "t"),
    (None, PROSE[3], "en", "t"),
    (None, PROSE[3], "en", "t"),
    (4, None, "en", "s"),
    (5, "", "en", None),
    (6, LONG, "en", "s"),
    (7, LONG + " end", "en", "s"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, 1, 0), (3, 1, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def _docs(spark, rows=ROWS):
    d = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x", 1, "y") for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long, id string, n int, component string")
    return d


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_tables_and_extra_columns(spark, folder, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, _docs(spark), folder)
    assert name == "packing" or out.columns == corpus_pipeline.COLUMNS
    assert out.count() > 0 and stage(spark, _docs(spark).limit(0), folder).count() == 0
    assert stage(spark, _docs(spark).where("text is null"), folder).count() == {"quality": 0, "near_duplicates": 1, "pii": 1, "mix": 0, "packing": 1}[name]


def test_quality_drops_texts_without_words_and_judges_repeats_alike(spark, folder):
    kept = Counter(r["doc_id"] for r in corpus_pipeline.quality(spark, _docs(spark), folder).collect())
    assert 4 not in kept and 5 not in kept and kept[1] in (0, 2) and kept[None] in (0, 2)


def test_one_row_stays_of_copies_and_shared_ids(spark, folder):
    out = corpus_pipeline.dedup(spark, _docs(spark), folder).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out) == [(False, 1), (False, 3), (False, 4), (False, 5), (False, 6), (True, 0)]
    assert {r["doc_id"]: r["text"] for r in out}[3] == min(PROSE[1], ROWS[4][1])


def test_pseudonyms_and_lengths(spark, folder):
    out = corpus_pipeline.pii(spark, _docs(spark), folder).collect()
    assert len(out) == len(ROWS) and not any("4111 1111" in (r["text"] or "") for r in out)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out)


def test_mix_takes_rows_whole_and_at_most_three_times(spark, folder):
    out = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.mix(spark, _docs(spark), folder).collect())
    have = Counter((i, t) for i, t, _, _ in ROWS)
    assert set(out) <= set(have) and all(n <= 3 * have[k] for k, n in out.items()) and not any(t in (None, "") for _, t in out)


def test_packing_holds_every_row(spark, folder):
    got = corpus_pipeline.pack(spark, _docs(spark), folder)
    ends = got.where(F.col("start") + F.col("length") == F.col("doc_tokens")).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in ends} == Counter(i for i, *_ in ROWS)
