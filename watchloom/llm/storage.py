"""Cutting lineage through the folder that the driver and every executor share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where none is set, a temporary folder for a local master and one in the warehouse for a cluster."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        found = tempfile.mkdtemp(prefix="watchloom-") if sc.master.startswith("local") and not sc.master.startswith("local-cluster") else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_watchloom"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so that a lost executor costs no recomputation and free() can give its room back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/watchloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def free(*tables: DataFrame, shuffles: bool = False) -> None:
    """Deletes what cut() wrote for these tables, which nobody may read any more; with shuffles, also lets Spark's cleaner remove finished shuffles now."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._cut_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    if shuffles:
        gc.collect()
        jvm.System.gc()
