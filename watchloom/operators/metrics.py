"""How well a keep set or predicted change points meet labels. Definitions are this library's own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hit_labels(labels: DataFrame, found: DataFrame, tolerance: int) -> DataFrame:
    """Labels (stream_id, frame_index) with a found frame within the tolerance: an equi-join on the frames around each label."""
    near = labels.withColumn("_near", F.explode(F.sequence(F.col("frame_index") - tolerance, F.col("frame_index") + tolerance)))
    look = found.select("stream_id", F.col("frame_index").alias("_near")).distinct()
    return near.join(look, ["stream_id", "_near"], "left_semi").select("stream_id", "frame_index").distinct()


def event_retention(labels: DataFrame, keep: DataFrame, tolerance: int) -> DataFrame:
    """(n_labels, n_hit, retention): share of labels that the keep set meets; 1 without labels."""
    n = labels.agg(F.count(F.lit(1)).alias("n_labels"))
    hit = hit_labels(labels, keep, tolerance).agg(F.count(F.lit(1)).alias("n_hit"))
    a = n.withColumn("_k", F.lit(1)).join(hit.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return a.withColumn("retention", F.when(F.col("n_labels") > 0, F.col("n_hit") / F.col("n_labels")).otherwise(1.0))


def change_point_scores(labels: DataFrame, predicted: DataFrame, tolerance: int) -> DataFrame:
    """Per stream with labels or predictions: n_labels, n_predicted, recall, precision within the tolerance (1 where there is nothing to meet)."""
    count = lambda df, name: df.groupBy("stream_id").agg(F.count(F.lit(1)).alias(name))
    parts = [
        count(labels, "n_labels"),
        count(predicted, "n_predicted"),
        count(hit_labels(labels, predicted, tolerance), "n_recalled"),
        count(hit_labels(predicted, labels, tolerance), "n_right"),
    ]
    a = parts[0]
    for p in parts[1:]:
        a = a.join(p, "stream_id", "full")
    a = a.na.fill(0)
    share = lambda x, n: F.when(F.col(n) > 0, F.col(x) / F.col(n)).otherwise(1.0)
    return a.select("stream_id", "n_labels", "n_predicted", share("n_recalled", "n_labels").alias("recall"), share("n_right", "n_predicted").alias("precision"))


def label_stability(labels: DataFrame, predictions: DataFrame, tolerance: int) -> DataFrame:
    """(n, n_stable, stability): share of consecutive predictions away from labelled changes that keep their class."""
    near = labels.withColumn("frame_index", F.explode(F.sequence(F.col("frame_index") - tolerance, F.col("frame_index") + tolerance))).distinct()
    a = predictions.join(near, ["stream_id", "frame_index"], "left_anti")
    return a.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("label_changed")).alias("n_stable")).withColumn("stability", F.when(F.col("n") > 0, F.col("n_stable") / F.col("n")).otherwise(1.0))
