"""Exact top-k by inner product with the no-random-access algorithm over sorted component lists.

Rows are dealt to shards of bounded size. A shard keeps one list per component, sorted by the size of its values, and the rows'
norms; batches of queries stream past it. All lists are read in parallel, stretch by stretch, to a common depth. What a row has
contributed so far is its score but for the components not read yet, and these add at most the product of what is left of
the two norms (Cauchy-Schwarz): that bounds the score from above and below. Rows whose upper bound is under
the k-th best lower bound are out, rows never seen included. A query stops when few rows are left; their scores are
then resolved exactly. A stretch is read for all queries of a batch at once, as a matrix that holds its entries and is zero elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.llm.storage import cut

LONG = np.iinfo(np.int64)
LEAST, MOST = float(LONG.min), float(LONG.max)  # scores beyond are cut to these and tie
#: Depths, as parts of each list, at which bounds are looked at.
DEPTHS = (1 / 32, 1 / 8, 1 / 4, 1 / 2, 3 / 4, 1.0)


class SortedLists:
    """The component lists of one shard, over its distinct vectors; of equal ones the smallest ids stand for all, as ties go to them."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, most: int = 6):
        by_id = np.argsort(ids, kind="stable")
        ids, x = ids[by_id], np.ascontiguousarray(x[by_id])
        whole = x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel() if x.shape[1] else np.zeros(len(x))
        _, first, same = np.unique(whole, return_index=True, return_inverse=True)
        self.x = x[first]
        order = np.argsort(same, kind="stable")
        starts = np.searchsorted(same[order], np.arange(len(first)))
        self.ids = [ids[order[a : min(a + most, b)]] for a, b in zip(starts, [*starts[1:], len(order)])]
        self.rows_of = np.array([len(i) for i in self.ids], dtype=np.int64)
        self.at = np.repeat(np.arange(len(first)), self.rows_of)
        flat = np.concatenate(self.ids) if len(first) else np.empty(0, dtype=np.int64)
        self.by_id = np.argsort(flat, kind="stable")
        self.flat = flat[self.by_id]
        self.real = self.x.astype(np.float64)
        self.order = np.argsort(-np.abs(self.real), axis=0, kind="stable")
        self.square = np.einsum("ij,ij->i", self.real, self.real)
        self.stretches: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _stretch(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        """The lists' entries between two depths as a matrix of values, and which they are."""
        if r not in self.stretches:
            n = len(self.x)
            rows = self.order[int(n * ((0.0, *DEPTHS)[r])) : int(np.ceil(n * DEPTHS[r])) if DEPTHS[r] == 1 else int(n * DEPTHS[r])]
            read = np.zeros(self.real.shape)
            np.put_along_axis(read, rows, 1.0, axis=0)
            self.stretches[r] = self.real * read, read
        return self.stretches[r]

    def top(self, q: np.ndarray, k: int, own: int, stop_at: int) -> tuple[list[int], list[int], int]:
        """Ids and scores of the k best rows other than id own, and how many list entries were read."""
        return self.tops(q[None, :], k, [own], stop_at)[0]

    def tops(self, qs: np.ndarray, k: int, owns: list[int], stop_at: int) -> list[tuple[list[int], list[int], int]]:
        """top() of several queries."""
        n, out = len(self.x), [([], [], 0)] * len(qs)
        if not n:
            return out
        w = qs.astype(np.float64).T
        norm = (w * w).sum(axis=0)
        # float sums of rounded products are off by less than this; sums of integers under 2**53 are not off at all
        slack = 1e-13 * (len(w) + 4) * np.sqrt(self.square)
        going = np.arange(len(qs))
        seen, read_q, left_x, entries = np.zeros((n, len(qs))), np.zeros((n, len(qs))), self.square.copy(), 0
        for r in range(len(DEPTHS)):
            values, read = self._stretch(r)
            seen += values @ w[:, going]
            read_q += read @ (w[:, going] ** 2)
            left_x = np.maximum(left_x - np.einsum("ij,ij->i", values, values), 0)
            entries += int(read.sum())
            last = r + 1 == len(DEPTHS) or not left_x.any()  # or all that is unread is zero
            left = np.zeros((n, 1)) if last else np.sqrt(np.maximum(norm[going] - read_q, 0) * left_x[:, None])
            left = left + slack[:, None] * np.sqrt(norm[going])
            stay = []
            for c, g in enumerate(going):
                here = self._others(owns[g])
                low = _kth(np.repeat(seen[:, c] - left[:, c], np.minimum(here, k)), k)
                alive = np.flatnonzero((np.maximum(seen[:, c] + left[:, c], LEAST) >= min(low, MOST)) & (here > 0))
                if len(alive) <= stop_at or last:
                    score = _exact(self.x[alive], qs[g])
                    best = sorted((-s, int(i)) for s, at in zip(score, alive) for i in self.ids[at] if i != owns[g])[:k]
                    out[g] = [i for _, i in best], [-s for s, _ in best], entries
                else:
                    stay.append(c)
            going, seen, read_q = going[stay], seen[:, stay], read_q[:, stay]
            if not len(going):
                break
        return out

    def _others(self, own: int) -> np.ndarray:
        """How many candidates each distinct vector stands for, those with id own apart."""
        here = self.rows_of.copy()
        np.subtract.at(here, self.at[self.by_id[np.searchsorted(self.flat, own, "left") : np.searchsorted(self.flat, own, "right")]], 1)
        return here


def _kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def _exact(x: np.ndarray, q: np.ndarray) -> list[int]:
    """Inner products, in Python's integers where 64 bits might not do; beyond 64 bits the largest or smallest value there is."""
    if len(x) and float(np.abs(x.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).sum()) < 2.0**62:
        return (x @ q).tolist()
    return [min(max(sum(a * b for a, b in zip(r, q.tolist())), LONG.min), LONG.max) for r in x.tolist()]


def quantised(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component as double, within 64 bits; null if the vector or a component is null or not finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & F.coalesce(sound, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * factor)))


def _matrix(vectors: list, width: int) -> np.ndarray:
    if all(len(v) == width for v in vectors):
        return np.array(vectors, dtype=np.int64).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _search(k: int, stop_at: int, together: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ids, vectors, lists, width = None, [], [], None, 0
        asks: list[tuple[int, list[int]]] = []

        def answers() -> Iterator[pa.RecordBatch]:
            nonlocal lists, vectors, width
            if asks and ids:
                if lists is None:
                    width = max(map(len, vectors))
                    lists, vectors = SortedLists(np.array(ids, dtype=np.int64), _matrix(vectors, width), k + 1), []
                found = lists.tops(_matrix([v[:width] for _, v in asks], width), k, [own for own, _ in asks], stop_at)
                out = [(own, i, s) for (own, _), (got, score, _) in zip(asks, found) for i, s in zip(got, score)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["query_id", "id", "score"])
            asks.clear()

        for b in batches:
            for now, asking, own, v in zip(b["task"].to_pylist(), b["asks"].to_pylist(), b["id"].to_pylist(), b["v"].to_pylist()):
                if now != task:
                    yield from answers()
                    task, ids, vectors, lists = now, [], [], None
                if asking:
                    asks.append((own, v))
                    if len(asks) >= together:
                        yield from answers()
                else:
                    ids.append(own)
                    vectors.append(v)
        yield from answers()

    return run


def exact_topk(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "vector",
    k: int = 5,
    shard_rows: int = 16384,
    block_rows: int = 64,
    stop_at: int = 64,
) -> DataFrame:
    """query_id, rank from 1, id_col, score: for each row of queries the k rows of vectors with the largest inner product.

    Vectors are arrays of integers; a shorter one is filled up with zeros, a null one takes no part, and neither does one without an id. Rows
    with the query's own id are no candidates; every other row is one for every query, rows that repeat an id too, and query
    rows that share an id share its ranks. Equal scores go to the smaller id; with fewer than k other rows all are returned.
    Scores beyond 64 bits are cut to the largest or smallest 64-bit value. Empty tables give no rows; other columns are ignored.

    A shard's lists are built once for each of its tasks; there are several only while shards are fewer than shuffle partitions, each
    with block_rows queries or more. A task holds one shard, and queries in batches of at most 64.
    """
    side = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    rows, asked = cut(side(vectors)), cut(side(queries))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_shards = max(1, -(-rows.count() // shard_rows))
    n_parts = max(1, min(-(-parts // n_shards), -(-asked.count() // block_rows)))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")  # noqa: E731  # not by id: an id may repeat
    held = rows.select("id", "v", dealt(n_shards).alias("shard")).select("id", "v", "shard", upto(n_parts).alias("part"), F.lit(False).alias("asks"))
    asks = asked.select("id", "v", dealt(n_parts).alias("part")).select("id", "v", upto(n_shards).alias("shard"), "part", F.lit(True).alias("asks"))
    both = held.unionByName(asks).select((F.col("shard") * n_parts + F.col("part")).alias("task"), "asks", "id", "v")
    found = both.repartition(max(parts, n_shards * n_parts), "task").sortWithinPartitions("task", "asks").mapInArrow(_search(k, stop_at, min(block_rows, 64)), "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
