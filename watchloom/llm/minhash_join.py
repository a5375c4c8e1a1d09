"""Near-duplicates by an inverted join over MinHash signature coordinates, confirmed on full shingle sets.

1. Each text becomes its set of word shingles; equal sets are one class, represented by its smallest id.
2. A class has a signature of ``coordinates`` minima. A (coordinate, value) pair is a token. Two sets of
   similarity s agree in about s * coordinates tokens.
3. Prefix: in one global order of tokens, rare ones first, two signatures with ``matches`` agreements share one of the first
   coordinates - matches + 1 tokens. Only these are posted. The order comes from a table of token counts of fixed
   size; any order is right, a good one keeps frequent passages out of the prefixes.
4. Leaders: the member with the most frequent tokens of each posting list meets the others, which is linear in the lists. Pairs
   with ``matches`` collisions are confirmed on full sets, and the links found make components.
5. Merging: where other members of a leader's lists lie in different components, they are dealt by size of set (sets that
   link differ little) and into blocks of bounded size, and block meets block. In a pair of blocks the posting
   lists of all coordinates are merged: short ones are read and collisions counted, long ones are skipped through and only
   asked about pairs that can still reach ``matches``. Who has such a pair left comes again with its full
   set; pairs of different components are compared, and what a link has tied is not compared again.

What leaves a pair of blocks are ids or the links of a forest, never its pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.llm.components import connected_components
from watchloom.llm.shingles import mix, shingle_sets
from watchloom.llm.storage import cut, free

SKETCH_BITS = 12
KEY = ["leader", "size", "lo", "hi"]


def _seeds(k: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return x[:k] | np.uint64(1), x[k:]


def signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """k 32-bit minima for each non-empty set; zeros for empty ones."""
    out = np.zeros((len(sets), k), dtype=np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        starts = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
        for j, (a, b) in enumerate(zip(*_seeds(k))):
            out[full, j] = np.minimum.reduceat(((flat ^ b) * a) >> np.uint64(32), starts).astype(np.uint32)
    return out


def _sign(k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0), 0
            for sets in shingle_sets(batch.column(1).to_pylist(), width):
                sig = signatures(sets, k)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([r.tobytes() if len(s) else None for s, r in zip(sets, sig)], pa.binary()),
                    ],
                    names=["id", "n_shingles", "class", "sig"],
                )
                at += len(sets)

    return run


def _matrix(column: pa.Array | pa.ChunkedArray, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, k)


def _sketch_cells(sig: np.ndarray) -> np.ndarray:
    k = sig.shape[1]
    return (np.arange(k, dtype=np.int64) << SKETCH_BITS) | (sig >> np.uint32(32 - SKETCH_BITS)).astype(np.int64)


def _spread(sig: np.ndarray) -> np.ndarray:
    """Minima are small numbers; multiplied, equal ones stay equal and different ones spread over the sketch's cells."""
    return sig * np.uint32(2654435761)


def _sketch(reps: DataFrame, k: int) -> np.ndarray:
    """How often tokens occur, in k * 2**SKETCH_BITS cells: a fixed size whatever the number of rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k << SKETCH_BITS, dtype=np.int64)
        for b in batches:
            if b.num_rows:
                total += np.bincount(_sketch_cells(_spread(_matrix(b.column(0), k))).ravel(), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    got = reps.select("sig").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(k << SKETCH_BITS, dtype=np.int64)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out


def _post(k: int, prefix: int, sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = sketch.value
        for b in batches:
            if not b.num_rows:
                continue
            sig = _matrix(b.column(1), k)
            token = (np.arange(k, dtype=np.int64) << 32) | sig.astype(np.int64)
            n = np.minimum(seen[_sketch_cells(_spread(sig))], (1 << 24) - 1)
            first = np.argsort((n << 38) | token, axis=1)[:, :prefix]
            picked = np.take_along_axis(token, first, axis=1)
            ids = b.column(0).to_numpy(zero_copy_only=False)
            weight = (n.sum(axis=1) << 20) | (mix(ids.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(picked.ravel()), pa.array(np.repeat(ids, prefix)), pa.array(np.repeat(weight, prefix))], names=["token", "id", "weight"])

    return run


def _colliding(k: int, matches: int):
    """Keeps pairs (a, b) whose signatures, the last two columns, agree in ``matches`` coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keep = pa.array((_matrix(b.column(2), k) == _matrix(b.column(3), k)).sum(axis=1) >= matches)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return run


def collisions(x: np.ndarray, y: np.ndarray, matches: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i of x and j of y whose signatures agree in at least ``matches`` coordinates, and in how many.

    y's posting lists are the runs of equal (coordinate, value) in one sorted array. Of each row of x the k - matches + 1
    shortest lists are read and their entries counted; a pair with enough agreements is in one of them. The longer lists
    are not read: only pairs that can still reach ``matches`` are looked up in them, list by list.
    """
    (nx, k), ny = x.shape, len(y)
    coordinate = np.arange(k, dtype=np.int64) << 32
    posted = (coordinate | y.astype(np.int64)).ravel()
    by_token = np.argsort(posted, kind="stable")
    posted, owner = posted[by_token], by_token // k
    asked = (coordinate | x.astype(np.int64)).ravel()
    begin = np.searchsorted(posted, asked, "left").reshape(nx, k)
    length = np.searchsorted(posted, asked, "right").reshape(nx, k) - begin
    short_first = np.argsort(length, axis=1, kind="stable")
    cells = np.zeros(nx * ny, dtype=np.int16)
    read = short_first[:, : k - matches + 1]
    for c in range(read.shape[1]):  # one list of each row at a time: memory for one list a row
        n = np.take_along_axis(length, read[:, c : c + 1], 1)[:, 0]
        at = np.take_along_axis(begin, read[:, c : c + 1], 1)[:, 0]
        entry = np.repeat(at - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        cells[np.repeat(np.arange(nx) * ny, n) + owner[entry]] += 1  # a list holds a row of y once
    i, j = np.divmod(np.flatnonzero(cells), ny)
    if not len(i):
        return i, j, cells[:0]
    found = cells[i * ny + j]
    for c in range(k - matches + 1, k):
        at = short_first[i, c]
        found = found + (x[i, at] == y[j, at])
        alive = found + (k - 1 - c) >= matches
        i, j, found = i[alive], j[alive], found[alive]
    alive = found >= matches
    return i[alive], j[alive], found[alive]


def _agree(s: np.ndarray, t: np.ndarray, both: int, percent: int) -> bool:
    return both > 0 and 100 * both >= percent * (len(s) + len(t) - both)


def _confirm(percent: int):
    """Keeps pairs (a, b) whose full sets, the last two columns, have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = _sets(b.column(2)), _sets(b.column(3))
            keep = pa.array([_agree(s, t, len(np.intersect1d(s, t, assume_unique=True)), percent) for s, t in zip(left, right)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return run


def _sets(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        return [s for chunk in column.chunks for s in _sets(chunk)]
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    ends = ends - ends[0]
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _with_sets(width: int):
    """(id, text) to (id, sorted shingle hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for sets in shingle_sets(b.column(1).to_pylist(), width):
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate([np.sort(s.view(np.int64)) for s in sets])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(sets)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "s"])
                at += len(sets)

    return run


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted rows as one table for each run of equal keys; holds one run and one batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in keys])
        ends = [*(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        at = 0
        for end in ends:
            now = tuple(key[:, at].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(at, end - at))
            last, at = now, end
    if held:
        yield pa.Table.from_batches(held)


def _meetings(t: pa.Table, k: int, matches: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of a pair of blocks that collide often enough, may link by size, and lie in different components."""
    block, comp, n, own = (t[c].to_numpy() for c in ("block", "c", "n_shingles", "own"))
    sig = _matrix(t["sig"], k)
    first, second = np.flatnonzero(block == t["lo"][0].as_py()), np.flatnonzero(block == t["hi"][0].as_py())
    if not len(first) or not len(second) or comp.min() == comp.max():
        return np.empty(0, int), np.empty(0, int), np.empty(0, int)
    i, j, found = collisions(sig[first], sig[second], matches)
    i, j = first[i], second[j]
    fit = (comp[i] != comp[j]) & (own[i] | own[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
    if t["lo"][0].as_py() == t["hi"][0].as_py():
        fit &= i < j
    return i[fit], j[fit], found[fit]


def _open_ids(k: int, matches: int, percent: int):
    """Per pair of blocks the members that have a pair left to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, KEY):
            i, j, _ = _meetings(t, k, matches, percent)
            if len(i):
                at = np.union1d(i, j)
                yield pa.RecordBatch.from_arrays([pa.array(t["leader"].to_numpy()[at]), pa.array(t["id"].to_numpy()[at])], names=["leader", "id"])

    return run


def _forest(k: int, matches: int, percent: int):
    """Per pair of blocks links (a, b), confirmed on full sets, that connect what all its links connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, KEY):
            i, j, found = _meetings(t, k, matches, percent)
            if not len(i):
                continue
            ids, sets = t["id"].to_numpy(), _sets(t["s"])
            root = {int(c): int(c) for c in t["c"].to_numpy()}
            comp = t["c"].to_numpy().tolist()

            def find(c: int) -> int:
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            out = []
            order = np.argsort(-found, kind="stable")  # likely links first: what they tie needs no comparison
            for a, b in zip(i[order].tolist(), j[order].tolist()):
                x, y = find(comp[a]), find(comp[b])
                if x != y and _agree(sets[a], sets[b], len(np.intersect1d(sets[a], sets[b], assume_unique=True)), percent):
                    root[max(x, y)] = min(x, y)
                    out.append((min(ids[a], ids[b]), max(ids[a], ids[b])))
            if out:
                a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _dealt(member: DataFrame, percent: int, block_rows: int, *more: str) -> DataFrame:
    """(leader, id, c, n_shingles, sig) dealt by leader, size class and pair of blocks, sorted by these.

    Sizes of sets that link differ by a factor of 100/percent at most, so they lie in one size class or two that follow each
    other: a member goes to the list of its own class and, as a guest, to the next one's. Guests don't meet guests.
    """
    size = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(1.001 * 100 / percent)).cast("long")
    both = F.explode(F.array(F.struct(size.alias("size"), F.lit(True).alias("own")), F.struct((size + 1).alias("size"), F.lit(False).alias("own"))))
    listed = member.withColumn("_at", both).select("*", "_at.size", "_at.own").drop("_at")
    held = listed.groupBy("leader", "size").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("owned")).where("owned and n > 1").select("leader", "size", F.ceil(F.col("n") / block_rows).alias("blocks"))
    listed = listed.join(held, ["leader", "size"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    other = listed.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = other.select("leader", "size", F.least("block", "_other").alias("lo"), F.greatest("block", "_other").alias("hi"), "block", "own", "id", "c", "n_shingles", "sig", *more)
    parts = int(member.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(parts, *KEY).sortWithinPartitions(*KEY)


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 85,
    coordinates: int = 64,
    matches: int = 40,
    block_rows: int = 512,
) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id, kept, class_id (the smallest id with an equal set).

    Links hold between rows whose full sets have 100 * intersection >= percent * union. component_id is the smallest id reachable
    over links, kept says that it is the row's own. Texts with fewer than ``width`` words are one shingle; null and
    empty texts have none and link with nothing. Repeated rows and equal texts are one class; rows that share an id
    share its component. A row without an id links with nothing and is kept, without component and class. An empty table gives an
    empty table; other columns are ignored. Ids are integers.

    At the defaults a pair of similarity 0.85 agrees in fewer than 40 of 64 coordinates with a probability of 2.4e-6 (binomial),
    more similar pairs with far smaller ones. All else is exact. matches=1 posts every coordinate and skips nothing.

    Two members of one block list are compared only if sizes, collisions and components leave them open; a block pair holds at most
    about 2 * block_rows rows, so a hot list means more tasks and not longer ones.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = cut(texts.mapInArrow(_sign(coordinates, width), "id long, n_shingles long, class binary, sig binary"))
    # one row per task and class first, so a class of any size is small when it meets
    least = cut(signed.where("class is not null and id is not null").groupBy("class").agg(F.min(F.struct("id", "n_shingles", "sig")).alias("r")).select("class", "r.*"))
    reps = least.select("id", "n_shingles", "sig")
    links = _links(texts, reps, width, percent, coordinates, matches, block_rows)
    classes = signed.select("id", "n_shingles", "class").join(least.select("class", F.col("id").alias("rep")), "class", "left")
    classes = classes.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep"))
    # rows that share an id but not a text tie their classes together
    same_id = classes.where("rep <> id").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    shared = same_id.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("c")).where("b <> c").select(F.col("b").alias("a"), F.col("c").alias("b"))
    members = connected_components(links.union(shared), "a", "b")
    component = F.coalesce("component", "rep")
    found = classes.join(members, classes["rep"] == members["node"], "left").select("id", "n_shingles", component.alias("component_id"), "rep")
    out = cut(found)
    free(signed, least, links, members)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"), F.col("rep").alias("class_id"))


def _links(texts: DataFrame, reps: DataFrame, width: int, percent: int, k: int, matches: int, block_rows: int) -> DataFrame:
    """Confirmed links (a, b) between class representatives that connect whatever all links connect."""
    sketch = reps.sparkSession.sparkContext.broadcast(_sketch(reps, k))
    lists = reps.select("id", "sig").mapInArrow(_post(k, k - matches + 1, sketch), "token long, id long, weight long")
    leaders = lists.groupBy("token").agg(F.max_by("id", "weight").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").select("token", "leader")
    stars = cut(lists.select("token", "id").join(leaders, "token").where("leader <> id").select("leader", "id").distinct())
    sig = lambda side: reps.select(F.col("id").alias(side), F.col("sig").alias(f"sig_{side}"))
    met = stars.select(F.col("leader").alias("a"), F.col("id").alias("b")).join(sig("b"), "b").join(sig("a"), "a").select("a", "b", "sig_a", "sig_b")
    pairs = cut(met.mapInArrow(_colliding(k, matches), "a long, b long"))
    sets = cut(_sets_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), texts, width))
    full = lambda side: sets.select(F.col("id").alias(side), F.col("s").alias(f"s_{side}"))
    both = pairs.join(full("b"), "b").join(full("a"), "a").select("a", "b", "s_a", "s_b")
    first = cut(both.mapInArrow(_confirm(percent), "a long, b long"))
    free(pairs, sets, shuffles=True)

    # members of a leader's lists, itself apart, that lie in several components
    comp = connected_components(first, "a", "b")
    held = stars.join(comp, stars["id"] == comp["node"], "left").select("leader", "id", F.coalesce("component", "id").alias("c"))
    mixed = held.groupBy("leader").agg(F.min("c").alias("l"), F.max("c").alias("h")).where("l <> h").select("leader")
    member = cut(held.join(mixed, "leader", "left_semi").join(reps, "id"))
    free(stars, comp)
    dealt = _dealt(member, percent, block_rows)
    still = cut(dealt.mapInArrow(_open_ids(k, matches, percent), "leader long, id long").distinct())
    sets = cut(_sets_of(still.select("id"), texts, width))
    whole = member.join(still, ["leader", "id"]).join(sets, "id")
    more = _dealt(whole, percent, block_rows, "s").mapInArrow(_forest(k, matches, percent), "a long, b long")
    out = cut(first.union(more))
    free(first, member, still, sets, shuffles=True)
    return out


def _sets_of(ids: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(id, s): full sets of the rows of texts whose id is among ids, and of some more; repeated rows give one.

    A bitmap of fixed size, 2**17 words of 64 bits, picks them, so other texts don't move.
    """
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 23))
    one = lambda h: F.expr(f"shiftleft(1L, cast({h} & 63 as int))")
    marks = ids.select(at(F.col("id")).alias("h")).select(F.shiftright("h", 6).alias("w"), one("h").alias("bit"))
    marks = marks.groupBy("w").agg(F.bit_or("bit").alias("bits"))
    a = texts.withColumn("h", at(F.col("id")))
    some = a.join(F.broadcast(marks), F.shiftright("h", 6) == F.col("w")).where(F.col("bits").bitwiseAND(one("h")) != 0).select("id", "text")
    return some.mapInArrow(_with_sets(width), "id long, s array<long>").dropDuplicates(["id", "s"])
