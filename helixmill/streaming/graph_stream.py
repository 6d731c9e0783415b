"""The graph kept up by a stream of mentions.

Each micro-batch of mentions (files that arrive) is merged into counts by node and by day. A replayed batch changes
nothing: the batch's number is kept with the table it made, and a number that is there already is passed over.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from helixmill.operators.graph import with_node_ids


def merge_batches(mentions: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Read all there is of a stream of mentions, appending each batch's partial counts under its number; ends when done."""

    def write(batch: DataFrame, number: int) -> None:
        part = with_node_ids(batch).groupBy("node_id").agg(F.count(F.lit(1)).alias("frequency"), F.max("confidence").alias("confidence_max"), F.min_by("surface", "seq").alias("label"), F.min("seq").alias("seq"), F.sort_array(F.collect_set("pmid")).alias("sources"))
        # overwriting the one partition of this number makes a replay harmless
        part.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    return mentions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_nodes(spark: SparkSession, target: str) -> DataFrame:
    """Nodes of all batches."""
    parts = spark.read.parquet(target)
    return parts.groupBy(F.col("node_id").alias("id")).agg(F.min_by("label", "seq").alias("label"), F.sum("frequency").alias("frequency"), F.max("confidence_max").alias("confidence_max"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))


def mention_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(os.path.join(folder, "*"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of events by type in windows of event time; events later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
