"""The event log as a stream: every event once, whatever is delivered again within the watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def _is_folder(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


def deduplicated(spark: SparkSession, sf_dir: str, delay: str = "1 hour") -> DataFrame:
    """event_id, ts, user_id, event_type of the events, replayed from events.parquet (one file or a folder of part files);
    repeated ids are dropped. All files are one batch: those of a folder needn't be in order of time, and rows behind the
    watermark of an earlier batch would be lost. The stream's state and its output are in the folder that
    spark.checkpoint.dir names."""
    path = f"{shared_dir(spark)}/meridex/stream-{uuid.uuid4().hex}"
    table = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(table).schema)
    # a stream reads folders, and the filter is on the names of files: a single file is picked from its folder
    source = reader.parquet(table) if _is_folder(spark, table) else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    once = source.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    run = once.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(once.schema).parquet(f"{path}/out")
