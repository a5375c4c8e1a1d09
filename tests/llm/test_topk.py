"""Exact top-k: repeated ids, equal vectors, large values, and how much of the lists is read."""

import numpy as np
from pyspark.sql import functions as F

from watchloom.llm.nra_topk import LONG, SortedLists, exact_topk, quantised


def _brute(rows, queries, k):
    out = []
    for own in sorted({i for i, _ in queries}):
        found = []
        for i, q in queries:
            if i == own:
                found += [(-min(max(sum(a * b for a, b in zip(q, v)), LONG.min), LONG.max), j) for j, v in rows if j != own]
        out += [(own, r + 1, j, -s) for r, (s, j) in enumerate(sorted(found)[:k])]
    return out


def _got(spark, rows, queries, **more):
    schema = "vec_id long, vector array<long>, id string, task int"
    make = lambda r: spark.createDataFrame([(i, v, "x", 1) for i, v in r], schema)
    return [tuple(r) for r in exact_topk(make(rows), make(queries), **more).orderBy("query_id", "rank").collect()]


def test_repeated_ids_count_as_rows(spark):
    rows = [(0, [1]), (1, [2]), (1, [1]), (2, [0]), (3, [-5]), (3, [-5]), (3, [-5])]
    for queries in ([(0, [256])], [(1, [3]), (1, [-1])], [(9, [1])]):
        assert _got(spark, rows, queries) == _brute(rows, queries, 5)


def test_many_equal_vectors_and_small_shards(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i), [int(c) for c in rng.integers(-9, 9, 6)]) for i in rng.permutation(400)]
    rows = [(i, [3, 0, 1, 0, 0, 2]) if i % 3 == 0 else (i, v) for i, v in rows]
    queries = [r for r in rows if r[0] % 50 == 0]
    for shard in (37, 1000):
        assert _got(spark, rows, queries, shard_rows=shard, block_rows=2, stop_at=3) == _brute(rows, queries, 5)


def test_large_values_have_a_result(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [int(c) for c in rng.integers(-(10**e), 10**e, 4)]) for i, e in enumerate([3, 9, 12, 12, 15, 18, 18, 18] * 4)]
    assert _got(spark, rows, rows[:9], k=4, stop_at=2) == _brute(rows, rows[:9], 4)
    d = spark.createDataFrame([(0, [1e12, -1.0]), (50, [1.7e308, 1e-300]), (51, [-1.7e308, 5.0]), (52, [2.5e10, 4.0])], "vec_id long, embedding array<double>")
    v = d.select("vec_id", quantised(F.col("embedding")).alias("vector"))
    got = [tuple(r) for r in exact_topk(v, v.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    plain = [(r["vec_id"], list(r["vector"])) for r in v.collect()]
    assert got == _brute(plain, [r for r in plain if r[0] % 50 == 0], 5)


def test_entries_read():
    rng = np.random.default_rng(9)
    n, width = 4000, 32
    sparse = np.where(rng.random((n, width)) < 0.05, rng.integers(1, 100, (n, width)), 0)
    skewed = (rng.normal(size=(n, width)) * 200 / (1 + np.arange(width)) ** 2).astype(np.int64)
    for x, share in ((sparse, 0.26), (skewed, 0.51)):
        lists = SortedLists(np.arange(n), x)
        for q in range(0, n, 500):
            ids, scores, entries = lists.top(x[q], 5, q, 64)
            s = x @ x[q]
            best = [int(j) for j in np.lexsort((np.arange(n), -s)) if j != q][:5]
            assert (ids, scores) == (best, [int(s[j]) for j in best]) and entries <= share * x.size
