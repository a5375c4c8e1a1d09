"""Queries opN_* over the whole tables, with production parameters."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.llm.apportion import mix_sources
from watchloom.llm.centroid_langid import fit_centroids, identify
from watchloom.llm.chat_trees import best_paths, masked_text, parsed, threads
from watchloom.llm.feistel_pii import pseudonymise_documents
from watchloom.llm.license_rules import scan_licenses
from watchloom.llm.minhash_join import near_duplicates
from watchloom.llm.nra_topk import exact_topk, quantised
from watchloom.llm.quality_llr import fit_llr, quality_verdicts
from watchloom.llm.url_equivalence import Rule, judge_urls
from watchloom.llm.vector_packing import pack_documents

#: A deployment sets its own key; this one only makes the registered queries repeatable.
PSEUDONYM_KEY = b"watchloom example key"
URL_RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]
NEAR_DUPLICATES = {"width": 5, "percent": 85, "coordinates": 64, "matches": 40}
#: The pipeline's stage links from similarity 0.80 on. Such a pair agrees in fewer than 36 of 64 coordinates with a probability of 4e-6 (binomial).
STAGE_NEAR_DUPLICATES = NEAR_DUPLICATES | {"percent": 80, "matches": 36}
QUALITY_FIT = {"trusted": "quality = 1", "n_buckets": 8192, "sample_rows": math.inf}
MIX = {"weights": [5.0, 2.0, 1.0], "max_repeats": 3, "budget_ratio": 1.0}
#: A document's first line is its prompt and bears no loss.
PACKING = {"capacity": 1024, "max_segments": 8, "max_loss": 1016, "prompt_lines": 1, "end_id": 0}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    return out.withColumn("n_replaced", F.size("pii_spans").cast("long"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[F.concat_ws(",", c).alias(c) for c in ("licenses", "sentence_ids", "leftover")])


def op3_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = best_paths(threads(rows), score_col=None, loss_role="assistant")
    turns = F.transform(parsed(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = masked_text(F.col("formatted"), F.col("loss_spans"))
    return done.select(
        F.col("tree_id").alias("conv_id"),
        F.size(parsed(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", turns), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", held_out)
    model = fit_centroids(docs.where(~F.col("held_out")).select("doc_id", "text", "lang"))
    return identify(docs, model, keep=["doc_id", "held_out"], reject=False)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), **NEAR_DUPLICATES)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_verdicts(docs, fit_llr(docs, _table(spark, sf_dir, "labels"), **QUALITY_FIT))


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers as vocabularies

    pieces = pack_documents(docs, ranks_path=vocabularies.path("byte_bpe_50k.tiktoken"), pattern=vocabularies.PATTERN, **PACKING)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"), keep=["source"], **MIX).withColumn("source", F.col("kept.source")).drop("kept")


def op10_nra_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("vector"))
    return exact_topk(rows, rows.where("vec_id % 50 = 0"), k=5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_pii_pseudonyms,
        op2_license_scan,
        op3_chat_trees,
        op4_url_filter,
        op5_language_id,
        op6_near_duplicates,
        op7_quality_rules,
        op8_packing,
        op9_source_mix,
        op10_nra_topk,
    ]
    return {f.__name__: f for f in found}


