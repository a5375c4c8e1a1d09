"""Language identification by nearest centroid.

A text is its vector of hashed character 1- to 3-grams, weighted by TF-IDF and scaled to length 1. Each language
has several centroids, found by spherical k-means over a bounded sample of labelled texts; a text
gets the language of the centroid with the largest cosine, unless that is below the centroid's reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchloom.llm.storage import cut

UNKNOWN = "und"
_CHUNK = 1 << 19


@dataclass(frozen=True)
class CentroidModel:
    """centroids: unit rows. langs: language of each row. reach: least cosine that each row accepts. idf: per hashed gram."""

    centroids: np.ndarray
    langs: list[str]
    reach: np.ndarray
    idf: np.ndarray


def gram_counts(texts: list[str | None], dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each run of texts of bounded size: counts of hashed grams, one row per text; and which texts hold a letter.

    Letters are lower-cased, every run of other characters after a letter is one space.
    """
    bits = np.uint32(32 - int(dims - 1).bit_length())

    def one(run: list[str]) -> tuple[np.ndarray, np.ndarray]:
        n = len(run)
        flat = np.frombuffer("\0".join(run).lower().encode("utf-32-le", "surrogatepass"), dtype="<u4") if run else np.empty(0, "<u4")
        # lower() keeps \0; text borders are where it stands
        doc = np.cumsum(flat == 0)
        letter = _letters(flat)
        has = np.bincount(doc[letter], minlength=n)[:n] > 0 if len(flat) else np.zeros(n, bool)
        keep = letter.copy()
        keep[1:] |= letter[:-1] & (doc[1:] == doc[:-1])  # the first of other characters after a letter of the same text
        c, doc = np.where(letter, flat, 32)[keep].astype(np.uint32), doc[keep]
        out = np.zeros(n * dims, dtype=np.float32)
        gram = np.zeros(len(c), dtype=np.uint32)
        for k in range(3):
            if len(c) <= k:
                break
            gram = gram[: len(c) - k] * np.uint32(0x01000193) + c[k:] + np.uint32(k + 1)
            same = doc[: len(c) - k] == doc[k:]
            at = (gram * np.uint32(0x9E3779B1)) >> bits
            out += np.bincount(doc[: len(c) - k][same] * dims + at[same], minlength=n * dims).astype(np.float32)
        return out.reshape(n, dims), has

    held, size = [], 0
    for t in texts:
        t = (t or "").replace("\0", " ")
        if held and (size + len(t) > _CHUNK or len(held) >= 128):
            yield one(held)
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield one(held)


_LETTER = np.zeros(0x110000, dtype=bool)


def _letters(points: np.ndarray) -> np.ndarray:
    if not _LETTER.any():
        _LETTER[:] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER[points]


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(counts) * idf)


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centroid is the mean, each further one the row farthest from those there are."""
    c = _unit(x.mean(axis=0, keepdims=True))
    while len(c) < min(k, len(x)):
        far = (x @ c.T).max(axis=1)
        if far.min() > 0.999999:
            break
        c = np.vstack([c, x[int(far.argmin())]])
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = _unit(np.vstack([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))]))
    return c


def _idf(texts: DataFrame, dims: int) -> np.ndarray:
    """log((1 + n) / (1 + df)) + 1 for each gram, over all texts with a letter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(dims + 1, dtype=np.int64)  # the last one counts texts
        for b in batches:
            for counts, has in gram_counts(b.column(0).to_pylist(), dims):
                df[:dims] += (counts[has] > 0).sum(axis=0)
                df[dims] += has.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1)), pa.array(df)], names=["gram", "df"])

    got = texts.mapInArrow(count, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(dims + 1, dtype=np.int64)
    df[got["gram"].to_numpy()] = got["df"].to_numpy()
    return (np.log((1 + df[dims]) / (1 + df[:dims])) + 1).astype(np.float32)


def fit_centroids(
    labelled: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_lang: int = 400,
    max_rows: int = 8000,
    dims: int = 4096,
    clusters: int = 4,
    reject_share: float = 0.001,
    seed: int = 5,
) -> CentroidModel:
    """Learns from at most per_lang rows of each language and max_rows in all, those of the least seeded hash of their ids.

    IDF is that of all rows with a language and a letter, counted in each task and summed: dims numbers a task. A centroid accepts cosines down to the reject_share quantile of its own members'. Rows without
    a language, or without a letter, teach nothing; without any row left the model knows no language. Rows of equal hash go by id;
    rows that repeat a chosen id all teach; texts are read whole.
    """
    order = F.xxhash64(F.col(id_col), F.lit(seed))
    rows = labelled.where(F.col(lang_col).isNotNull()).select(order.alias("o"), F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    # the least hashes of each task's rows first, so no language meets in one task as a whole
    w = Window.partitionBy("lang", F.pmod("o", F.lit(64))).orderBy("o", "id")
    rows = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_lang)
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("o", "id"))).where(F.col("r") <= per_lang)
    chosen = cut(rows.orderBy("r", "lang", "o").limit(max_rows).select(F.col("id").alias("_chosen")).distinct())
    sample = labelled.where(F.col(lang_col).isNotNull()).join(F.broadcast(chosen), F.col(id_col) == F.col("_chosen"), "left_semi").select(F.col(lang_col), F.col(text_col), F.col(id_col).cast("string"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for counts, has in gram_counts(b.column(1).to_pylist(), dims):
                n = len(counts)
                small = [np.minimum(r, 65535).astype("<u2").tobytes() for r in counts]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), pa.array(small, pa.binary()), pa.array(has), b.column(2).slice(at, n)], names=["lang", "v", "has", "id"])
                at += n

    got = sample.mapInArrow(vectors, "lang string, v binary, has boolean, id string").where("has").orderBy("lang", "id").toArrow()
    lang = np.array(got["lang"].to_pylist(), dtype=object)
    counts = np.frombuffer(b"".join(got["v"].to_pylist()), dtype="<u2").reshape(-1, dims)
    idf = _idf(labelled.where(F.col(lang_col).isNotNull()).select(text_col), dims)
    centroids, langs, reach = [np.zeros((0, dims), np.float32)], [], []
    for name in sorted(set(lang)):
        x = _weighted(counts[lang == name].astype(np.float32), idf)
        c = _kmeans(x, clusters, seed).astype(np.float32)
        own = x @ c.T
        centroids.append(c)
        langs += [name] * len(c)
        reach += [float(np.quantile(own[own.argmax(axis=1) == i, i], reject_share)) if (own.argmax(axis=1) == i).any() else 1.0 for i in range(len(c))]
    return CentroidModel(np.vstack(centroids), langs, np.array(reach), idf)


def identify(docs: DataFrame, model: CentroidModel, *, text_col: str = "text", keep: list[str] = ("doc_id",), reject: bool = True) -> DataFrame:
    """The columns in keep, then lang_pred, score (cosine, 0 to 1), rejected.

    Null texts and texts without a letter are und with score 0, and so is everything under a model without languages. With reject,
    texts farther from their nearest centroid than it reaches are und too; without, they keep its language and only rejected
    says so. Equal cosines go to the first language by name. Row by row, whole texts, no shuffle.
    """
    dims = len(model.idf)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            langs, scores, rejected = [], [], []
            for counts, has in gram_counts(b.column(b.num_columns - 1).to_pylist(), dims):
                cos = np.clip(_weighted(counts, m.idf) @ m.centroids.T, 0, 1) if m.langs else np.zeros((len(counts), 1))
                best = cos.argmax(axis=1)
                for i, j in enumerate(best):
                    known = bool(has[i]) and bool(m.langs)
                    out = known and cos[i, j] < m.reach[j]
                    langs.append(m.langs[j] if known and not (out and reject) else UNKNOWN)
                    scores.append(float(cos[i, j]) if known else 0.0)
                    rejected.append(bool(out))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*b.schema.names[:-1], "lang_pred", "score", "rejected"])

    return kept.mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")
