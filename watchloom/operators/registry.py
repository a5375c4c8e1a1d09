"""The site-scoped embedding registry: lookup, aggregation, tagging, clustering and deduplication.

Registry rows are (id, site_id, person_id, name, role, department, notes, camera_id, embedding). An untagged row's
name is '', never null. Every operator returns a new DataFrame; writing it back is the sink's business.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from watchloom.functions import vectors as V
from watchloom.operators import blocks
from watchloom.operators.folds import fold


def in_site(rows: DataFrame, site_id) -> DataFrame:
    return rows.where(F.col("site_id") == F.lit(site_id))


def untagged(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("name") == "")


def nearest(queries: DataFrame, registry: DataFrame, *, k: int = 1, threshold: float | None = None, exclude_self: bool = False) -> DataFrame:
    """(query_id, id, score, rank): each query's k most similar rows of its site by cosine of unit vectors; ties to the smaller id.

    Pairs of blocks of a site are scored by matrix products; each block pair passes on a query's k best at most. Vectors that are null
    or hold null or non-finite components take no part.
    """
    a = blocks.best_in_blocks(queries, registry, k, threshold, exclude_self)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return a.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def within_distance(queries: DataFrame, registry: DataFrame, *, threshold: float) -> DataFrame:
    """(query_id, id, distance): all pairs nearer than a Euclidean distance, over all sites, but a row and itself; misses none."""
    return blocks.near_in_blocks(queries, registry, threshold)


def people(rows: DataFrame) -> DataFrame:
    """(site_id, name, n, notes): rows per person of a site, with the notes of the row with the least id."""
    return rows.groupBy("site_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min_by("notes", "id").alias("notes"))


def best_score(matches: DataFrame) -> DataFrame:
    """Largest positive score per name."""
    return matches.groupBy("name").agg(F.max("score").alias("score")).where("score > 0")


def mean_embedding(rows: DataFrame, *keys: str) -> DataFrame:
    """The mean of each group's vectors, scaled to length 1."""
    a = rows.select(*keys, F.posexplode("embedding").alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    a = a.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("mean"))
    return a.select(*keys, V.unit(F.col("mean")).alias("embedding"))


def first_then_best(rows: DataFrame, group: str, arrival: Column, quality: Column, k: int) -> DataFrame:
    """Of each group's first 3k rows the k of best quality; ties to the earlier."""
    w = Window.partitionBy(group)
    a = rows.withColumn("_a", F.row_number().over(w.orderBy(arrival))).where(F.col("_a") <= 3 * k)
    return a.withColumn("rank", F.row_number().over(w.orderBy(quality.desc(), "_a")).cast("int")).where(F.col("rank") <= k).drop("_a")


def first_k(rows: DataFrame, group: str, arrival: Column, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(arrival)).cast("int")).where(F.col("rank") <= k)


def largest(rows: DataFrame, keys: list[str], size: Column, order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(size.desc(), order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def tag_upsert(registry: DataFrame, tags: DataFrame) -> DataFrame:
    """The registry with tags (id, name, role, department, notes) applied: null keeps the old value, '' overwrites. Blank ids or names are no tags."""
    good = valid_tags(tags)
    a = registry.join(good.select("id", *[F.col(c).alias(f"_{c}") for c in ("name", "role", "department", "notes")]), "id", "left")
    return a.select(*[F.coalesce(f"_{c}", c).alias(c) if c in ("name", "role", "department", "notes") else F.col(c) for c in registry.columns])


def valid_tags(tags: DataFrame) -> DataFrame:
    return tags.where((F.trim(F.col("id").cast("string")) != "") & (F.trim("name") != ""))


def missed_tags(registry: DataFrame, tags: DataFrame) -> DataFrame:
    return valid_tags(tags).join(registry.select("id"), "id", "left_anti")


def upsert(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """rows with changes by id: changed rows replace, new ones are added."""
    return rows.join(changes.select("id"), "id", "left_anti").unionByName(changes)


def delete(rows: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """What stays, and how many go."""
    hit = F.coalesce(predicate, F.lit(False))
    return rows.where(~hit), rows.agg(F.count_if(hit).alias("deleted"))


def by_prefix(rows: DataFrame, prefix: str) -> DataFrame:
    """The first row by id whose id starts with prefix."""
    return rows.where(F.startswith(F.col("id"), F.lit(prefix))).orderBy("id").limit(1)


def similar_pairs(centroids: DataFrame, threshold: float) -> DataFrame:
    """(site_id, a, b, score) of centroids of one site with a cosine of at least threshold, a before b; block by block."""
    return blocks.pairs_in_blocks(centroids, threshold)


# --- ordered folds: a site's rows in id order, batch by batch ----------------------------------------------


class Centroids:
    """Running centroids of length 1: a vector joins the most similar one, if that is similar enough, else it founds one."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.sums = np.empty((0, 0))  # room for more rows than are in use
        self.sizes: list[int] = []

    @property
    def centres(self) -> np.ndarray:
        return self.sums[: len(self.sizes)]

    def join(self, v: np.ndarray) -> int:
        """The number of the centroid that takes v."""
        likeness = self.centres @ v if self.sizes else np.empty(0)
        at = int(likeness.argmax()) if len(likeness) else -1
        if at < 0 or likeness[at] < self.threshold:
            at = len(self.sizes)
            if at == len(self.sums):
                self.sums = np.vstack([self.sums.reshape(-1, len(v)), np.zeros((max(8, at), len(v)))])
            self.sums[at] = v
            self.sizes.append(1)
        else:
            # the direction of the mean is all that counts, so the weighted sum needs no division by the size
            self.sums[at] = _unit(self.sizes[at] * self.sums[at] + v)
            self.sizes[at] += 1
        return at


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v / n if n > 0 else v


def lead_clusters(vectors: np.ndarray, threshold: float) -> tuple[list[list[int]], np.ndarray]:
    """Positions of each cluster's vectors, and the centroids."""
    c = Centroids(threshold)
    label = np.array([c.join(v) for v in vectors], dtype=int)
    return [np.flatnonzero(label == i).tolist() for i in range(len(c.sizes))], c.centres.copy()


def merged_groups(sizes: np.ndarray, centres: np.ndarray, threshold: float) -> np.ndarray:
    """For each centroid the number of the group that it ends in, when the most similar pair of groups merges while it is similar enough.

    Each group remembers its most similar partner. A merge changes one row of similarities, and only groups whose partner was one of
    the two look for a new one, so all merges together take time in proportion to the square of the number of centroids, if few do.
    """
    n = len(centres)
    group, weight, c = np.arange(n), np.array(sizes, dtype=float), np.array(centres, dtype=float)
    like = c @ c.T
    np.fill_diagonal(like, -np.inf)
    partner = like.argmax(axis=1) if n > 1 else np.zeros(n, dtype=int)
    peak = like[np.arange(n), partner]
    while n > 1:
        i = int(peak.argmax())
        j = int(partner[i])
        if not peak[i] >= threshold:
            break
        i, j = min(i, j), max(i, j)
        c[i] = _unit(weight[i] * c[i] + weight[j] * c[j])
        weight[i] += weight[j]
        group[group == j] = i
        like[j, :] = like[:, j] = -np.inf
        row = c @ c[i]
        row[[i, j]] = -np.inf
        row[~np.isfinite(like[i])] = -np.inf
        like[i, :] = like[:, i] = row
        # who lost its partner looks again; the others only compare the changed one with the partner they have
        for r in np.flatnonzero(((partner == i) | (partner == j)) & np.isfinite(peak)).tolist() + [i, j]:
            partner[r] = like[r].argmax()
            peak[r] = like[r, partner[r]]
        better = (row > peak) | ((row == peak) & (i < partner) & np.isfinite(row))
        partner[better], peak[better] = i, row[better]
        n -= 1
    return group


def agglomerate(members: list[list[int]], centres: np.ndarray, threshold: float) -> list[list[int]]:
    """The members of the merged groups, in the order of their first centroid."""
    group = merged_groups(np.array([len(m) for m in members]), np.asarray(centres), threshold)
    return [[p for k in np.flatnonzero(group == g) for p in members[k]] for g in np.unique(group)]


class _Lead:
    """Labels a site's rows as they come; its centroids follow at the end, as rows without an id."""

    def __init__(self, threshold: float, ids: pa.DataType):
        self.centroids, self.ids, self.site = Centroids(threshold), ids, None

    def step(self, part: pa.RecordBatch) -> dict:
        self.site = part.column("site_id").slice(0, 1)
        labels = [self.centroids.join(np.asarray(v, dtype=np.float64)) for v in part.column("embedding").to_pylist()]
        none = pa.nulls(len(labels))
        return {"site_id": part.column("site_id"), "id": part.column("id"), "leader": pa.array(labels, pa.int64()), "size": none.cast(pa.int64()), "centre": none.cast(pa.list_(pa.float64()))}

    def finish(self) -> dict:
        n = len(self.centroids.sizes)
        return {
            "site_id": pa.concat_arrays([self.site] * n),
            "id": pa.nulls(n, self.ids),
            "leader": pa.array(range(n), pa.int64()),
            "size": pa.array(self.centroids.sizes, pa.int64()),
            "centre": pa.array(self.centroids.centres.tolist(), pa.list_(pa.float64())),
        }


def cluster_sites(rows: DataFrame, threshold: float, merge: bool = True) -> DataFrame:
    """(site_id, id, cluster): clusters are named by their smallest id.

    A task holds a site's centroids and one batch of its rows; merging sees the centroids only.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    arrow = to_arrow_type(rows.schema["id"].dataType)
    schema = f"site_id {kinds['site_id']}, id {kinds['id']}, leader bigint, size bigint, centre array<double>"
    led = fold(rows.select("site_id", "id", "embedding"), "site_id", ["id"], lambda: _Lead(threshold, arrow), schema)
    labels = led.where("id is not null").select("site_id", "id", "leader")
    if merge:

        def merged(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("leader")
            return pd.DataFrame({"site_id": pdf["site_id"], "leader": pdf["leader"], "group": merged_groups(pdf["size"].to_numpy(), np.stack(pdf["centre"].to_numpy()), threshold)})

        groups = led.where("id is null").groupBy("site_id").applyInPandas(merged, f"site_id {kinds['site_id']}, leader bigint, group bigint")
        labels = labels.join(groups, ["site_id", "leader"]).select("site_id", "id", F.col("group").alias("leader"))
    least = labels.groupBy("site_id", "leader").agg(F.min("id").alias("cluster"))
    return labels.join(least, ["site_id", "leader"]).select("site_id", "id", "cluster")


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """(site_id, cluster, size), the largest of a site first; of equal ones the smaller name."""
    sizes = clusters.groupBy("site_id", "cluster").agg(F.count(F.lit(1)).alias("size"))
    return sizes.orderBy("site_id", F.col("size").desc(), "cluster")


def reconcile(clusters: DataFrame, rows: DataFrame) -> DataFrame:
    """(site_id, id, cluster, conflict, new_person_id, new_name, changed) for each row.

    A cluster with more than one person id (own ids aside) or name is a conflict and stays; otherwise its only person
    id, or its smallest row id, becomes everyone's, and so does its only name.
    """
    a = clusters.join(rows.select("site_id", "id", "person_id", "name"), ["site_id", "id"])
    w = Window.partitionBy("site_id", "cluster")
    pids = F.collect_set(F.when((F.col("person_id") != F.col("id")) & (F.col("person_id").cast("string") != ""), F.col("person_id"))).over(w)
    names = F.collect_set(F.when(F.col("name") != "", F.col("name"))).over(w)
    a = a.withColumn("_p", pids).withColumn("_n", names).withColumn("conflict", (F.size("_p") > 1) | (F.size("_n") > 1))
    a = a.withColumn("new_person_id", F.when(~F.col("conflict"), F.coalesce(F.get("_p", F.lit(0)), F.min("id").over(w))).otherwise(F.col("person_id")))
    a = a.withColumn("new_name", F.when(~F.col("conflict"), F.coalesce(F.get("_n", F.lit(0)), F.col("name"))).otherwise(F.col("name")))
    changed = (F.col("new_person_id") != F.col("person_id")) | (F.col("new_name") != F.col("name"))
    return a.select("site_id", "id", "cluster", "conflict", "new_person_id", "new_name", changed.alias("changed"))


def dedup_online(candidates: DataFrame, stored: DataFrame, threshold: float) -> DataFrame:
    """(site_id, id, gate): how each candidate fares in id order: cache (like an accepted one), stored (like a stored row) or accepted.

    The stored gate is a join; only what it leaves open folds in order, against the accepted rows.
    """
    hits = nearest(candidates, stored, k=1, threshold=threshold).select(F.col("query_id").alias("id"), F.lit(True).alias("_hit"))
    a = candidates.select("site_id", "id", "embedding").join(hits, "id", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))

    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}
    return fold(a.select("site_id", "id", "embedding", "_hit"), "site_id", ["id"], lambda: _Gate(threshold), f"site_id {kinds['site_id']}, id {kinds['id']}, gate string")


class _Gate:
    """Holds a site's accepted vectors."""

    def __init__(self, threshold: float):
        self.accepted = Accepted(threshold)

    def step(self, part: pa.RecordBatch) -> dict:
        gates = []
        for v, hit in zip(part.column("embedding").to_pylist(), part.column("_hit").to_pylist()):
            v = np.asarray(v, dtype=np.float64)
            gates.append("cache" if self.accepted.like(v) else "stored" if hit else "accepted")
            if gates[-1] == "accepted":
                self.accepted.add(v)
        return {"site_id": part.column("site_id"), "id": part.column("id"), "gate": pa.array(gates, pa.string())}

    def finish(self) -> None:
        return None


class Accepted:
    """Vectors in one growing matrix."""

    def __init__(self, threshold: float):
        self.threshold, self.rows, self.n = threshold, np.empty((0, 0)), 0

    def like(self, v: np.ndarray) -> bool:
        return self.n > 0 and float((self.rows[: self.n] @ v).max()) >= self.threshold

    def add(self, v: np.ndarray) -> None:
        if self.n == len(self.rows):
            self.rows = np.vstack([self.rows.reshape(-1, len(v)), np.zeros((max(8, self.n), len(v)))])
        self.rows[self.n] = v
        self.n += 1


# --- quality ---------------------------------------------------------------------------------------------


def quality_reason(x1: Column, y1: Column, x2: Column, y2: Column, blur: Column, *, min_size: float, blur_floor: float, aspect: tuple[float, float]) -> Column:
    """The first test that a box fails, or ok."""
    x1, y1, x2, y2 = (F.greatest(F.lit(0).cast("long"), v.cast("long")) for v in (x1, y1, x2, y2))
    w, h = x2 - x1, y2 - y1
    ratio = w / F.greatest(h, F.lit(1))
    return (
        F.when((w <= 0) | (h <= 0), "invalid_box")
        .when((w < min_size) | (h < min_size), "too_small")
        .when((ratio < aspect[0]) | (ratio > aspect[1]), "bad_aspect")
        .when(blur.isNull(), "empty_crop")
        .when(blur < blur_floor, "too_blurry")
        .otherwise("ok")
    )


def threshold_cascade(detections: DataFrame, high: float, low: float) -> DataFrame:
    """Detections above high; in frames without any, those above low."""
    top = F.max("score").over(Window.partitionBy("stream_id", "frame_index"))
    return detections.withColumn("_top", top).where((F.col("score") > high) | ((F.col("_top") <= high) & (F.col("score") > low))).drop("_top")


def calibration(sizes: DataFrame, size_pct: float, blur_pct: float, min_samples: int) -> DataFrame:
    """(n, min_size, blur_floor): exact percentiles, or the fixed fallbacks 20 and 30 for too few samples."""
    a = sizes.agg(F.count(F.lit(1)).alias("n"), F.percentile("size", F.lit(size_pct / 100)).alias("_s"), F.percentile("blur", F.lit(blur_pct / 100)).alias("_b"))
    enough = F.col("n") >= min_samples
    return a.select("n", F.when(enough, F.col("_s").cast("int")).otherwise(20).alias("min_size"), F.when(enough, F.col("_b")).otherwise(30.0).alias("blur_floor"))
