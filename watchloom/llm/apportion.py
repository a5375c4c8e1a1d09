"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks (DataFrame functions only).

1. One scan counts the words of every row; nothing but ids, sources and counts moves afterwards.
2. Water filling gives each source its target: its weighted share of the budget, but at most
   ``max_repeats`` times its own size; what is cut off goes to the others by weight.
3. Seats: the budget is cut into blocks of ``block_tokens``; sources get blocks by the highest
   quotients target/(2k+1), and each source's blocks go to its shards by the same rule.
4. Rows lie in a shard in seeded order. A quota of blocks takes the whole shard as often as it fits, and the
   blocks at the start of the seeded order once more.

A source may hold any part of the rows: its rows are dealt to as many shards as it needs, so no window
runs over more than about ``shard_rows`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.llm.storage import cut
from watchloom.llm.words import word_count


def highest_quotients(items: DataFrame, group: list[str], weight: str, seats: str, out: str) -> DataFrame:
    """Adds ``out``: the seats of each item when its group's ``seats`` go to the highest quotients weight/(2k+1).

    With S items of total weight W and N seats, the Sainte-Laguë result differs from N*weight/W by at most
    weight/W * S/2 + 1/2, so only that window of quotients is ranked: O(S) rows instead of N.
    Ties go to the item first in the order of all columns. Items of zero weight and groups of zero weight get none.
    """
    over = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    w = F.col(weight).cast("double")
    names = [c for c in items.columns]
    a = (
        items.withColumn("_sum", F.sum(w).over(over))
        .withColumn("_n", F.count(F.lit(1)).over(over))
        .withColumn("_share", F.when(F.col("_sum") > 0, w / F.col("_sum")).otherwise(0.0))
        .withColumn("_at", F.col(seats) * F.col("_share"))
        .withColumn("_pad", F.ceil(F.col("_share") * F.col("_n") / 2) + 1)
        .withColumn("_low", F.greatest(F.floor("_at") - F.col("_pad"), F.lit(0)).cast("long"))
        .withColumn("_high", (F.floor("_at") + F.col("_pad")).cast("long"))
        .withColumn("_left", F.when(F.col("_sum") > 0, F.col(seats) - F.sum("_low").over(over)).otherwise(0))
    )
    q = a.withColumn("_k", F.explode(F.sequence("_low", "_high"))).withColumn("_q", w / (2 * F.col("_k") + 1))
    order = [F.col("_q").desc(), *(F.col(c).asc_nulls_last() for c in names), F.col("_k").asc()]
    won = F.row_number().over(over.orderBy(*order)) <= F.col("_left")
    return (
        q.withColumn("_won", (won & (w > 0)).cast("long"))
        .groupBy(*names)
        .agg((F.first("_low") + F.sum("_won")).alias(out))
    )


def source_targets(sizes: DataFrame, weights: list[float], max_repeats: float, budget_ratio: float) -> DataFrame:
    """(source, source_size, source_rows) plus target: weighted shares of the budget under the caps, by water filling.

    Sources sorted by cap/weight fill up in that order, so the water level is found in one pass over them.
    Weights repeat over the sources in code-point order, null last.
    Below the water line the level rises from source to source, above it falls: the largest level that its own
    source can hold is the right one; where even the last source is full, every target is its cap.
    """
    one = Window.partitionBy(F.lit(0))
    by_name = one.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    by_ratio = one.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return (
        sizes.withColumn("_weight", pick)
        .withColumn("_cap", F.col("source_size") * float(max_repeats))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_budget", F.sum("source_size").over(one) * float(budget_ratio))
        .withColumn("_level", (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(from_here))
        .withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(one))
        .withColumn("target", F.least(F.col("_cap"), F.col("_weight") * F.coalesce("_level", F.lit(float("inf")))))
        .drop("_weight", "_cap", "_ratio", "_budget", "_level")
    )


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: list[float] = (5, 2, 1),
    max_repeats: int = 3,
    budget_ratio: float = 1.0,
    block_tokens: int = 16,
    shard_rows: int = 20_000,
    seed: int = 17,
    whole_rows: bool = False,
    keep: list[str] = (),
) -> DataFrame:
    """One row per row of docs: id_col, size, source_size, target, taken, copies and a struct ``kept`` of the columns in keep.

    size: words of the text (null or empty: 0). taken: words the mix takes of the row, repeats counted, never more
    than max_repeats * size. A block that ends inside a row takes its first words; with whole_rows the row is
    then taken whole if more than half of it lies in the block. copies: how often the whole row is taken.
    A null source is a source of its own, last in order. Rows of size 0 take nothing. Repeated rows are rows of
    their own; an empty table gives an empty table. Columns not named are ignored, whatever their names.
    Only counts of sources and of a source's shards meet in one task, as running sums over them need it.
    """
    def counted(*more: Column) -> DataFrame:
        return docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("size"), *more)

    counts = cut(counted())
    sizes = counts.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    one = Window.partitionBy(F.lit(0))
    targets = source_targets(sizes, list(weights), max_repeats, budget_ratio)
    targets = targets.withColumn("_seats", F.coalesce(F.round(F.sum("target").over(one) / block_tokens), F.lit(0)).cast("long"))
    targets = highest_quotients(targets, [], "target", "_seats", "_seats_won")
    targets = cut(targets.withColumn("_shards", F.ceil(F.col("source_rows") / shard_rows).cast("long")).drop("_seats", "source_rows"))

    def dealt(rows: DataFrame) -> DataFrame:
        """Rows with their source's numbers and their shard; the hash decides, so reruns agree."""
        shard = F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), F.col("_id"), F.col("size")), F.col("_shards"))
        return rows.join(targets, rows["_source"].eqNullSafe(targets["source"])).withColumn("_shard", shard).drop("source")

    null_safe = F.struct(F.col("_source").isNull().alias("n"), F.coalesce("_source", F.lit("")).alias("s"))
    shards = dealt(counts).groupBy(null_safe.alias("_key"), "_shard", "_seats_won").agg(F.sum("size").alias("_shard_size"))
    shards = highest_quotients(shards, ["_key"], "_shard_size", "_seats_won", "_quota").drop("_seats_won")

    rows = dealt(counted(F.struct(*[F.col(c) for c in keep]).alias("kept")) if keep else counts).withColumn("_key", null_safe)
    in_order = Window.partitionBy("_key", "_shard").orderBy(F.xxhash64(F.lit(seed), F.col("_id")), "_id", "size")
    rows = rows.withColumn("_end", F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    wanted = F.least(F.col("_quota") * block_tokens, F.col("_shard_size") * max_repeats)
    passes = F.when(F.col("_shard_size") > 0, F.floor(wanted / F.greatest("_shard_size", F.lit(1)))).otherwise(0).cast("long")
    once_more = wanted - F.col("_passes") * F.col("_shard_size")
    inside = F.greatest(F.least(once_more, F.col("_end")) - (F.col("_end") - F.col("size")), F.lit(0))
    if whole_rows:
        inside = F.when(2 * inside > F.col("size"), F.col("size")).otherwise(0)
    return (
        rows.join(shards, ["_key", "_shard"])
        .withColumn("_passes", passes)
        .withColumn("_inside", inside)
        .select(
            F.col("_id").alias(id_col),
            "size",
            "source_size",
            "target",
            (F.col("_passes") * F.col("size") + F.col("_inside")).cast("long").alias("taken"),
            F.when(F.col("size") > 0, F.col("_passes") + (F.col("_inside") == F.col("size")).cast("long")).otherwise(0).alias("copies"),
            *(["kept"] if keep else []),
        )
    )
