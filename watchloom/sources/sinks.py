"""Where results go: tables of frames and chunks, sidecars, reports, messages with a spool, registry snapshots."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def write_kept(keep: DataFrame, path: str) -> None:
    """Kept frames as Parquet; Spark's committer makes the folder appear whole."""
    keep.write.mode("overwrite").parquet(path)


def write_chunks(records: DataFrame, path: str) -> None:
    """Frame records, one folder per chunk index."""
    records.write.mode("overwrite").partitionBy("chunk_index").parquet(path)


def write_sidecars(chunks: DataFrame, path: str) -> None:
    """One JSON object per chunk, with its frames if they were collected."""
    chunks.write.mode("overwrite").json(path)


def copy_clip(spark: SparkSession, source: str, target: str) -> bool:
    """Copies a file through Spark's file systems; the target appears whole, and an old one is replaced. False if there is no source."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    part = b.suffix(".part")
    from_fs, to_fs = a.getFileSystem(conf), b.getFileSystem(conf)
    if not from_fs.exists(a):
        return False
    jvm.org.apache.hadoop.fs.FileUtil.copy(from_fs, a, to_fs, part, False, True, conf)
    to_fs.delete(b, False)
    if not to_fs.rename(part, b):
        raise OSError(f"can't rename {part.toString()}")
    return True


def chunk_folder(chunks_dir: str | None, output_dir: str | None, asset_path: str) -> str:
    """The first folder that is given."""
    return chunks_dir or output_dir or asset_path


def write_report(report: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, default=str)


def filter_metadata(keep: DataFrame, dropped: DataFrame, timeline: DataFrame, path: str) -> None:
    """Kept and dropped frames and the timeline as JSON tables under one folder."""
    for name, df in (("kept", keep), ("dropped", dropped), ("timeline", timeline)):
        df.write.mode("overwrite").json(f"{path}/{name}")


def kafka_options(config: dict) -> dict[str, str]:
    """Writer options from a config: brokers and topic, and security where it is set."""
    from watchloom.plans.settings import brokers

    out = {"kafka.bootstrap.servers": brokers(config), "topic": str(config.get("topic", "chunks")), "kafka.acks": str(config.get("acks", "all"))}
    for key, option in (("compression_type", "kafka.compression.type"), ("batch_size", "kafka.batch.size"), ("linger_ms", "kafka.linger.ms"), ("security_protocol", "kafka.security.protocol"), ("sasl_mechanism", "kafka.sasl.mechanism")):
        if config.get(key) not in (None, ""):
            out[option] = str(config[key])
    if config.get("sasl_username"):
        out["kafka.sasl.jaas.config"] = f'org.apache.kafka.common.security.plain.PlainLoginModule required username="{config["sasl_username"]}" password="{config.get("sasl_password", "")}";'
    return out


def kafka_writer(config: dict) -> Callable[[DataFrame], None]:
    """Sends (value) rows to Kafka; needs Spark's Kafka connector."""
    options = kafka_options(config)
    return lambda values: values.write.format("kafka").options(**options).save()


def json_writer(path: str) -> Callable[[DataFrame], None]:
    return lambda values: values.select("value").write.mode("append").text(path)


def publish(values: DataFrame, write: Callable[[DataFrame], None], spool: str, retries: int = 1, wait: float = 0.0, required: bool = False) -> bool:
    """Writes (value) rows; after the last failed try they are appended to the spool, or with required the error is raised."""
    for attempt in range(max(1, retries)):
        try:
            write(values)
            return True
        except Exception as error:  # noqa: BLE001  any sink may fail in its own way
            log.warning("publishing failed (try %d): %s", attempt + 1, str(error).splitlines()[0])
            if attempt + 1 < retries:
                time.sleep(wait)
            elif required:
                raise
    json_writer(spool)(values)
    return False


def start_chunk_sink(chunks: DataFrame, folder: str, checkpoint: str, message: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], None], available_now: bool = True):
    """Starts a query that stores each micro-batch of chunks as JSON, keyed by batch so that a repeated one replaces itself, and publishes it."""

    def batch(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").json(f"{folder}/chunks/batch={epoch}")
        publish(message(df.sparkSession.read.schema(df.schema).json(f"{folder}/chunks/batch={epoch}")), write, f"{folder}/spool")

    w = chunks.writeStream.option("checkpointLocation", checkpoint).outputMode("append").foreachBatch(batch)
    return (w.trigger(availableNow=True) if available_now else w).start()


def stream_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Per stream: chunks and frames stored."""
    return spark.read.json(f"{folder}/chunks").groupBy("stream_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("frame_count").alias("frames"))


def append_registry(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("site_id").parquet(path)


def replace_registry(rows: DataFrame, path: str) -> None:
    """Writes a new snapshot; path must not be one that rows read from."""
    rows.write.mode("overwrite").partitionBy("site_id").parquet(path)
