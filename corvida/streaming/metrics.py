"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvida.session import shared_dir


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts and sums per hour and type of what arrives in time, in partial rows of each micro-batch's windows."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(cents).alias("cents")).select(F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", "cents")


def hourly_complete(events: DataFrame, name: str = "hourly") -> DataFrame:
    """Counts and sums per hour and type of a drained stream: nothing is lost, however rows fall into micro-batches.

    Each micro-batch writes its own partial sums under its number, so one that runs twice replaces itself; late rows
    are just further partial sums, and the hours still open at the end are there like the others.
    """
    import uuid

    spark = events.sparkSession
    path = f"{shared_dir(spark)}/corvida-stream-{name}-{uuid.uuid4().hex}"
    keys = [F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH").alias("hour"), "event_type"]

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    events.writeStream.foreachBatch(write).option("checkpointLocation", path + "-state").trigger(availableNow=True).start().awaitTermination()
    parts = spark.read.schema("hour string, event_type string, n bigint, cents bigint, batch bigint").parquet(path)
    return parts.groupBy("hour", "event_type").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))


def once_per_key(rows: DataFrame, keys: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """One row a key within the watermark, for streams whose repeats come soon; older repeats come through."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def settle_once(rows: DataFrame, keys: list[str], name: str = "settled") -> DataFrame:
    """Exactly one settlement a key, for ever and without state: every micro-batch is joined against the settled keys
    (left anti) and written under its number, so a batch that runs twice replaces itself."""
    import uuid

    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/corvida-stream-{name}-{uuid.uuid4().hex}"
    schema = rows.select(*keys).schema

    def write(batch: DataFrame, number: int) -> None:
        earlier = spark.read.schema(schema).parquet(*[f"{path}/batch={i}" for i in range(number)]) if number else spark.createDataFrame([], schema)
        batch.select(*keys).distinct().join(earlier, keys, "left_anti").write.mode("overwrite").parquet(f"{path}/batch={number}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", path + "-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/batch=*")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all there is and read back what it wrote to the shared folder."""
    import uuid

    spark: SparkSession = stream.sparkSession
    path = f"{shared_dir(spark)}/corvida-stream-{name}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", path + "-state").trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def refresh_partitions(stream: DataFrame, path: str, by: str):
    """Replace the partitions (scopes) that a micro-batch brings; others stay. Returns the foreachBatch writer."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)

    return stream.writeStream.foreachBatch(write)
