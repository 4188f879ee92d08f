"""A file-backed record log under the schema of Spark's Kafka source.

One folder is one topic. Producers append parquet files; consumers are Structured Streaming
queries over that folder, each with its own checkpoint as its consumer group. A real broker
can take its place through ``sources.kafka_reader`` without a change to the consumers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.keys import part_of, place_in_part
from ..session import discard, scratch, stored

RECORD = "key BINARY, value BINARY, topic STRING, partition INT, offset BIGINT, timestamp TIMESTAMP, timestampType INT"


class Log:
    """A topic with ``partitions`` partitions."""

    def __init__(self, spark: SparkSession, topic: str, partitions: int = 1):
        """K2: make the topic; it is ready when this returns."""
        self.spark, self.topic, self.partitions = spark, topic, partitions
        self.path = scratch(spark, f"log-{topic}")
        spark.createDataFrame([], RECORD).write.parquet(self.path)

    def produce(self, df: DataFrame, value: str, order: list[str], *, partition: str | None = None) -> None:
        """K6, K7: append the bytes of column ``value``; the files are durable on return.

        ``partition`` is an integer column with the partition of each record (0 if None).
        Offsets are dense within a partition, in the order of ``order``, after those already
        there. They are assigned by ranges of ``order``, so that a partition that holds most
        of the records is still numbered by many tasks.
        """
        part = F.col(partition).cast("int") if partition else F.lit(0)
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        keyed = df.select(F.struct(*order).alias("o"), F.col(value).alias("value"), part.alias("partition"))
        ordered = stored(keyed.repartitionByRange(n, "o").sortWithinPartitions("partition", "o").withColumn("place", F.monotonically_increasing_id()), "produce")
        ranged = ordered.select("value", "partition", part_of("place").alias("slice"), place_in_part("place").alias("place"))
        counts = ranged.groupBy("partition", "slice").agg(F.count("*").alias("n"), F.min("place").alias("first"))
        ends = self.read().groupBy("partition").agg((F.max("offset") + 1).alias("end"))
        before = Window.partitionBy("partition").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        # a row for each log partition and slice
        bases = counts.join(ends, "partition", "left").select("partition", "slice", (F.coalesce(F.sum("n").over(before), F.lit(0)) + F.coalesce("end", F.lit(0)) - F.col("first")).alias("base"))
        offset = F.col("place") + F.col("base")
        ranged.join(F.broadcast(bases), ["partition", "slice"]).select(
            F.lit(None).cast("binary").alias("key"), "value", F.lit(self.topic).alias("topic"), "partition", offset.cast("bigint").alias("offset"), F.current_timestamp().alias("timestamp"), F.lit(0).alias("timestampType")
        ).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        """All records, as a batch."""
        return self.spark.read.schema(RECORD).parquet(self.path)

    def stream(self) -> DataFrame:
        """Records from the earliest one; those without a value are skipped."""
        return self.spark.readStream.schema(RECORD).parquet(self.path).where("value IS NOT NULL")

    def consume(self, sink: str, group: str, select=lambda df: df, *, deadline_s: int = 600) -> DataFrame:
        """Drain what is new for ``group`` into parquet files at ``sink``.

        ``group`` is a checkpoint folder: a second call with it reads only later records.
        """
        query = select(self.stream()).writeStream.format("parquet").option("path", sink).option("checkpointLocation", group).trigger(availableNow=True).start()
        await_or_fail(query, deadline_s)
        return self.spark.read.parquet(sink)

    def delete(self) -> None:
        """Best-effort deletion."""
        discard(self.spark, self.path)


def await_or_fail(query: StreamingQuery, deadline_s: int) -> None:
    """Wait for the end of ``query``; past the deadline raise, and always stop it."""
    try:
        if not query.awaitTermination(deadline_s):
            raise TimeoutError(f"nothing more than {query.lastProgress} within {deadline_s} s")
    finally:
        query.stop()


def first_message(df: DataFrame, order: str = "offset") -> DataFrame:
    """The first record by ``order``; each task sends one row at most."""
    return df.orderBy(order).limit(1)
