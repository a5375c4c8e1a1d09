"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing extra columns."""

import random

import pytest
from pyspark.sql import functions as F

from watchloom.llm import queries as Q
from watchloom.llm.apportion import mix_sources
from watchloom.llm.centroid_langid import fit_centroids, identify
from watchloom.llm.chat_trees import best_paths, threads
from watchloom.llm.feistel_pii import pseudonymise_documents
from watchloom.llm.license_rules import scan_licenses
from watchloom.llm.minhash_join import near_duplicates
from watchloom.llm.nra_topk import exact_topk, quantised
from watchloom.llm.quality_llr import fit_llr, quality_verdicts
from watchloom.llm.url_equivalence import judge_urls
from watchloom.llm.vector_packing import pack_documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, token long, a int, b int, size string, target string, component string, _w int, kept boolean, class string, sig int, score string"
rnd = random.Random(3)
LONG = " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rnd.randrange(500)) for _ in range(40_000))
TEXTS = [None, "", "  \n\t ", "one", "Ein kurzer Satz mit acht Wörtern für uns.", LONG, LONG, LONG + " end", "<|endoftext|> x", "</s>[INST] a@b.co 10.0.0.1", "MIT License", "😀 é ñ"]


def docs(spark, texts=TEXTS):
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "s", "t"][i % 3], None, "x", 1, 1, 1, "x", "x", "x", 1, True, "x", 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[3:6], SCHEMA)


def ways():
    import public_tokenizers as P

    def lang(spark, d):
        return identify(d, fit_centroids(d), keep=["doc_id"])

    def quality(spark, d):
        return quality_verdicts(d, fit_llr(d, spark.createDataFrame([(4, 1), (None, 1)], "doc_id long, quality int")))

    return {
        "pii": (lambda s, d: pseudonymise_documents(d, b"k"), 1),
        "license": (lambda s, d: scan_licenses(d), 1),
        "lang": (lang, 1),
        "near": (lambda s, d: near_duplicates(d), 1),
        "quality": (quality, 1),
        "pack": (lambda s, d: pack_documents(d, ranks_path=P.path("byte_bpe_50k.tiktoken"), pattern=P.PATTERN), 0),
        "mix": (lambda s, d: mix_sources(d), 1),
        "chat": (lambda s, d: best_paths(threads(d.withColumn("turn", F.lit(0)).withColumn("role", F.col("lang")), conv_col="source"), score_col=None), 0),
    }


@pytest.mark.parametrize("name", list(ways()))
def test_odd_rows_and_empty_tables(spark, name):
    run, rowwise = ways()[name]
    d = docs(spark)
    got = run(spark, d).collect()
    assert got if not rowwise else len(got) == d.count()
    assert run(spark, d.limit(0)).collect() == []
    assert run(spark, d.where("text is null")).count() == (1 if rowwise or name != "x" else 0)


def test_near_duplicates_of_odd_rows(spark):
    got = {r["doc_id"]: r for r in near_duplicates(docs(spark)).collect()}
    assert got[0]["n_shingles"] == got[1]["n_shingles"] == got[2]["n_shingles"] == 0
    assert got[3]["n_shingles"] == 1 and got[6]["component_id"] == got[7]["component_id"] == 5
    assert [got[i]["component_id"] for i in (0, 1, 2, 3, 4)] == [0, 1, 2, 3, 4]


def test_urls_and_vectors(spark):
    p = spark.createDataFrame([(1, None, None, "x"), (2, "no scheme", "", "y"), (3, "http://A.NET", "x", "z"), (4, "http://b.org?q=/x", None, "z")], "page_id long, url string, html string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(p, Q.URL_RULES).collect()}
    assert got == {1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.net", "", None, "allow"), 4: ("b.org", "", None, "allow")}
    assert judge_urls(p.limit(0), Q.URL_RULES).collect() == []
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, None]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0]), (5, [1.0, 0.0]), (6, []), (7, [-1.0, -1.0])], "vec_id long, embedding array<float>")
    v = v.select("vec_id", quantised(F.col("embedding")).alias("vector"))
    got = [tuple(r) for r in exact_topk(v, v.where("vec_id % 50 = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 4, 65536), (0, 2, 5, 65536), (0, 3, 6, 0), (0, 4, 7, -65536)]
    assert exact_topk(v.limit(0), v.limit(0)).collect() == []
