"""Quality rules by hashed n-gram log-likelihood ratio (DataFrame functions only).

Every row gets counts about its words and lines, and a score: the mean over its hashed 1- and 2-grams of
log p(bucket | trusted target) - log p(bucket | raw corpus). The raw multinomial is counted over all rows, the target
multinomial over all rows labelled as trusted. A row is kept if its score reaches a fixed threshold, which the
scores of all trusted rows set: nothing is drawn.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.llm.storage import cut, free
from watchloom.llm.words import words

SYMBOLS = "#*$%&|<>"
BITMAP = 1 << 23  # bits, by hash, that tell which rows may be trusted


@dataclass(frozen=True)
class LlrModel:
    """weights: one log ratio per bucket. threshold: least score kept."""

    weights: list[float]
    threshold: float


def _hashed(text: Column, body) -> Column:
    """body(h, p) with h the hashes of the text's words and p those of each word with its next one (the last one alone)."""
    return _let(F.transform(words(text), lambda x: F.xxhash64(x)), lambda h: _let(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1))), lambda p: body(h, p)))


def _counts(docs: DataFrame, text_col: str, n_buckets: int) -> DataFrame:
    """(bucket, n) over all 1- and 2-grams of all rows: exploded and summed in place, so each task sends a row per bucket at most."""
    grams = _hashed(F.col(text_col), lambda h, p: F.concat(h, p))
    return docs.select(F.explode(grams).alias("g")).groupBy(F.col("g").bitwiseAND(n_buckets - 1).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def trusted_rows(docs: DataFrame, labels: DataFrame, id_col: str, label_id: str, trusted: Column, text_col: str, limit: float = math.inf) -> DataFrame:
    """The texts of all rows with a trusted label; a finite limit takes no more ids than that, by the least seeded hash.

    A bitmap of the ids' hashes, of a fixed size, leaves out most other rows before texts are shuffled to meet the ids. It is broadcast as
    rows of 64 bits: as a literal it would be a few MB in each text of the plan, of which the driver keeps many.
    """
    ids = labels.where(trusted).select(F.col(label_id).alias("_trusted")).where("_trusted is not null").distinct()
    if limit < math.inf:
        ids = ids.orderBy(F.xxhash64("_trusted", F.lit(7)), "_trusted").limit(int(limit))
    ids = cut(ids.select(F.col("_trusted").cast(docs.schema[id_col].dataType)))
    place = lambda c: F.shiftright(F.xxhash64(c).bitwiseAND(BITMAP - 1), 6)
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(c).bitwiseAND(63).cast("int"))
    bitmap = ids.groupBy(place("_trusted").alias("_place")).agg(F.bit_or(bit("_trusted")).alias("_bits"))
    may = docs.select(id_col, text_col).join(F.broadcast(bitmap), (place(id_col) == F.col("_place")) & (bit(id_col).bitwiseAND(F.col("_bits")) != 0), "left_semi")
    return may.join(ids.hint("merge"), F.col(id_col) == F.col("_trusted"), "left_semi").select(text_col)


def exact_quantile(rows: DataFrame, col: str, q: float, few: int = 20_000, bins: int = 4096) -> float | None:
    """The quantile of finite numbers, between neighbours by their distance; None without any.

    Counts in bins narrow the range until few rows, or ties only, are left in it, so that neither a task nor the driver holds the column.
    """
    x = F.col(col)
    whole, least, most = rows.agg(F.count(x), F.min(x), F.max(x)).first()
    if not whole:
        return None

    def ranked(rank: int) -> float:
        n, lo, hi = whole, least, most
        while True:
            here, step = rows.where((x >= lo) & (x <= hi)), (hi - lo) / bins
            if n <= few or lo + step == lo or hi - step == hi:
                bin_ = x
            else:
                bin_ = F.least(F.floor((x - lo) / step), F.lit(bins - 1))
            for _, n, lo, hi in sorted(tuple(r) for r in here.groupBy(bin_.alias("b")).agg(F.count(x), F.min(x), F.max(x)).collect()):
                if n > rank:
                    break
                rank -= n
            if lo == hi:
                return lo

    at = (whole - 1) * q
    below = ranked(math.floor(at))
    above = below if at == math.floor(at) else ranked(math.floor(at) + 1)
    return below + (above - below) * (at - math.floor(at))


def fit_llr(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id: str = "doc_id",
    trusted: str = "quality = 1",
    n_buckets: int = 8192,
    smoothing: float = 1.0,
    sample_rows: float = math.inf,
    keep_share: float = 0.995,
    margin: float = 0.01,
) -> LlrModel:
    """n_buckets is a power of two. All trusted rows count, unless a caller bounds them by sample_rows. The driver gets n_buckets counts and one quantile.

    threshold: below the (1 - keep_share) quantile of the trusted rows' scores by margin. Without trusted rows, or on an
    empty table, the target equals the raw corpus, all weights are 0 and every row is kept.
    """
    raw = {r["bucket"]: r["n"] for r in _counts(docs, text_col, n_buckets).collect()}
    good = cut(trusted_rows(docs, labels, id_col, label_id, F.expr(trusted), text_col, sample_rows))
    target = {r["bucket"]: r["n"] for r in _counts(good, text_col, n_buckets).collect()}
    if not target:
        free(good)
        return LlrModel([0.0] * n_buckets, 0.0)
    t, r, pad = sum(target.values()), sum(raw.values()), smoothing * n_buckets
    weights = [math.log((target.get(b, 0) + smoothing) / (t + pad)) - math.log((raw.get(b, 0) + smoothing) / (r + pad)) for b in range(n_buckets)]
    scored = cut(good.select(_hashed(F.col(text_col), lambda h, p: _score(h, p, weights)).alias("score")))
    low = exact_quantile(scored, "score", 1 - keep_share)
    free(scored, good)
    return LlrModel(weights, (low if low is not None else 0.0) - margin)


def _score(h: Column, p: Column, weights: list[float]) -> Column:
    """Mean weight over the row's 1- and 2-grams; 0 without any."""
    table = F.split(F.lit(",".join(f"{w:.6f}" for w in weights)), ",").cast("array<double>")
    add = lambda acc, x: acc + F.get(table, x.bitwiseAND(len(weights) - 1).cast("int"))
    return F.when(F.size(h) > 0, F.aggregate(p, F.aggregate(h, F.lit(0.0), add), add) / (2 * F.size(h))).otherwise(0.0)


def _repeated_words(h: Column, p: Column) -> Column:
    """Words inside windows of five words that occur twice or more in the text, first occurrence included.

    Window hashes are sorted beside their positions; equal neighbours give the repeated positions; windows at
    sorted positions cover min(5, distance to the next) words each. No step is quadratic in the text's length.
    """
    five = F.transform(p, lambda x, i: F.xxhash64(x, F.get(p, i + 2), F.get(h, i + 4)))
    keys = F.slice(five, 1, F.greatest(F.size(h) - 4, F.lit(0)))
    placed = lambda k: F.sort_array(F.transform(k, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def covered(s: Column) -> Column:
        twin = lambda x, i: (x["x"] == F.get(s, i - 1)["x"]) | (x["x"] == F.get(s, i + 1)["x"])
        where = F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x["i"]))
        step = lambda q: F.transform(q, lambda x, i: F.least(F.coalesce(F.get(q, i + 1) - x, F.lit(5)), F.lit(5)))
        return _let(where, lambda q: F.aggregate(step(q), F.lit(0), lambda acc, x: acc + x))

    return _let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), 0).otherwise(_let(placed(k), covered))).cast("long")


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c))
    return text


def _let(value: Column, body) -> Column:
    """body(value) with value computed once per row: a one-element array binds it to a lambda's variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def quality_verdicts(
    docs: DataFrame,
    model: LlrModel,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 10,
    max_repeat_percent: int = 20,
    keep: list[str] = (),
) -> DataFrame:
    """One row per row of docs: id_col, the base counts, llr_score, base_failed, kept, and the columns named in keep.

    Null and empty texts have no words, counts of 0 and fail. A line is the text between \\n characters; a line
    with a word that equals an earlier line of the text counts as duplicate. Repeated rows are judged alike,
    an empty table gives an empty table, and columns not named are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    a = docs.select(F.col(id_col), *[F.col(c) for c in keep if c != id_col], text.alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of = _hashed(F.col("_text"), lambda h, p: F.struct(F.size(h).alias("n"), _repeated_words(h, p).alias("r"), _score(h, p, model.weights).alias("s")))
    a = a.select(
        *[c for c in a.columns if c != "_text"],
        F.length(_without(F.col("_text"), " \t\n\x0b\f\r")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(_without(F.col("_text"), SYMBOLS))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        of.alias("_of"),
    )
    a = a.withColumn("n_words", F.col("_of.n").cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("_of.r") > max_repeat_percent * F.col("n_words"))
    verdict = F.col("llr_score") >= model.threshold
    a = a.withColumn("n_repeat_words", F.col("_of.r")).withColumn("llr_score", F.col("_of.s")).withColumn("base_failed", failed)
    return a.withColumn("kept", ~F.col("base_failed") & verdict).drop("_of")
