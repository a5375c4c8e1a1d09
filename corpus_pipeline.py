"""Corpus pipeline: quality rules, near-duplicates, pseudonyms, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.llm import queries as Q
from watchloom.llm.apportion import mix_sources
from watchloom.llm.feistel_pii import pseudonymise_documents
from watchloom.llm.minhash_join import near_duplicates
from watchloom.llm.quality_llr import fit_llr, quality_verdicts
from watchloom.llm.storage import cut, free

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that the quality rules reject; the trusted labels are those of the table beside documents.

    Null and empty texts fail the rule for fewer than ten words and go. Repeated rows are judged alike; a score that ties with the
    threshold stays. An empty table gives an empty table, and columns beyond those of documents are left out.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_llr(docs, labels, **Q.QUALITY_FIT)
    return quality_verdicts(docs, model, keep=COLUMNS).where("kept").select(*COLUMNS)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near copies, of similarity 0.80 or more: that with the smallest doc_id.

    Of rows that share that doc_id one stays, the least by text and then by the other columns. Rows without doc_id are compared as
    exact copies of each other only: one of each text stays. Null and empty texts are copies of nothing and stay, one for each
    doc_id. An empty table gives an empty table, and columns beyond those of documents are left out.
    """
    docs = docs.select(*COLUMNS)
    least = F.min(F.struct(F.col("text"), *[c for c in COLUMNS if c != "text"])).alias("r")
    columns = [F.col(f"r.{c}") for c in COLUMNS]
    kept = cut(near_duplicates(docs, **Q.STAGE_NEAR_DUPLICATES).where("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")))
    out = docs.join(kept.where("n = 1"), "doc_id", "left_semi").select(*COLUMNS)
    if not kept.where("n > 1").isEmpty():
        out = out.union(docs.join(kept.where("n > 1"), "doc_id", "left_semi").groupBy("doc_id").agg(least).select(*columns))
    return out.union(docs.where("doc_id is null").groupBy("text").agg(least).select(*columns))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms of the same format, and n_chars by the new text's length.

    Row by row: null texts stay null with a null n_chars, empty ones empty, and repeated rows stay alike. An empty table gives an
    empty table, and columns beyond those of documents are left out.
    """
    out = pseudonymise_documents(docs.select(*COLUMNS), Q.PSEUDONYM_KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole rows by their sources' quotas; a row that the mix takes twice is there twice.

    A null source is a source of its own, last in order. Null and empty texts have no words and are not taken. Repeated rows
    are rows of their own. An empty table gives an empty table, and columns beyond those of documents are left out.
    """
    taken = mix_sources(docs, keep=COLUMNS, whole_rows=True, **Q.MIX)
    return taken.where("copies > 0").select(F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_n"), "kept").select(*[f"kept.{c}" for c in COLUMNS])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens in sequences; null and empty texts are their end id, repeated rows are packed each, an empty table gives none."""
    return Q.packed(docs)


STAGES = [("quality", quality), ("near_duplicates", dedup), ("pii", pii), ("mix", mix), ("packing", pack)]

#: Signatures, keyed hashes and token ids can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again; a stage's files go once the next one's are written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        if before is not None:
            free(before, shuffles=True)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
