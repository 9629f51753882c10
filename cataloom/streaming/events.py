"""Structured Streaming over the events: windows, and upserts in batches."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cataloom.workspace import shared_folder, table


def windowed(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """``start, event_type, n, cents`` of tumbling windows, in batch or stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        rows = rows.withWatermark("ts", late)
    g = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "cents")


def source(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The table as a stream of files."""
    schema = table(spark, sf_dir, name).schema
    path = f"{sf_dir}/{name}.parquet"
    if os.path.isdir(path):
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs the windows over the whole source; state and offsets survive in the checkpoint."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    agg = windowed(source(spark, sf_dir))

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out")

    query = agg.writeStream.outputMode("complete").option("checkpointLocation", f"{root}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("start timestamp_ntz, event_type string, n long, cents long").parquet(f"{root}/out")


def streamed_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest event per user: each batch is merged into a new version of the state table."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    versions: list[str] = []
    columns = ["user_id", "event_id", "event_type", "ts"]
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))

    def merge(batch: DataFrame, epoch: int) -> None:
        rows = batch.select(*columns)
        if versions:
            rows = rows.unionByName(spark.read.parquet(versions[-1]))
        path = f"{root}/v{epoch}"
        rows.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r").write.mode("overwrite").parquet(path)
        versions.append(path)

    query = source(spark, sf_dir).writeStream.option("checkpointLocation", f"{root}/checkpoint").foreachBatch(merge).trigger(availableNow=True).start()
    query.awaitTermination()
    state = spark.read.parquet(versions[-1]) if versions else table(spark, sf_dir, "events").limit(0).select(*columns)
    return state.select("user_id", "event_id", "event_type")
