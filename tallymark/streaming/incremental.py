"""Structured Streaming: label what has landed since the last run, then stop.

The query's checkpoint remembers which files are done, so a stopped or failed run redoes
only what was not committed.  Labelling keeps no state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators.joins import same, small
from tallymark.session import exists, written


def landed(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .format(fmt)
        .load(path)
    )


def run_available(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
) -> None:
    """Apply a stateless transform to everything available and commit it to ``out``."""
    query = (
        transform(stream)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def first_seen(stream: DataFrame, key: str, event_time: str, delay: str = "7 days") -> DataFrame:
    """Drop ids already seen within ``delay`` of event time; the state is bounded by the watermark."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


#: Folders that the ids of one batch are dealt to.
BUCKETS = 16


def pass_on_first_seen(stream: DataFrame, key: str, out: str, checkpoint: str, buckets: int = BUCKETS) -> None:
    """Write the rows whose ``key`` has not been written before, one for each key; what was seen is the output itself.

    For ids without an event time, whose state would grow with them: there is none in memory.  A batch
    meets the folders of its keys' hash buckets only, whose files carry a bloom filter on the key; the keys that are there
    already come back as a slim list.  A batch that is run again writes over its own folder and does not count as seen.
    """
    spark = stream.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
        new = written(batch.dropDuplicates([key]).select("*", bucket), "batch")
        if exists(spark, out):
            seen = spark.read.parquet(out).where(F.col("batch") != number)
            # the keys of a batch are the smaller side: history is scanned, not shuffled
            there = seen.alias("a").join(small(new.select("bucket", key)).alias("b"), same("bucket", key), "left_semi").select("bucket", key).distinct()
            new = new.alias("a").join(there.alias("b"), same("bucket", key), "left_anti")
        new.write.partitionBy("bucket").mode("overwrite").option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_first_seen(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).drop("batch", "bucket")
