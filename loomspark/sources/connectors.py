"""Options of the external connectors.

The Kafka connector and the Postgres driver are not on this machine, so only the JDBC reader
has been run (against the Derby database that ships with Spark).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import env


def jdbc_options(url: str | None = None, *, timeout_s: int = 10, **more: str) -> dict[str, str]:
    """A session with a bounded connect time."""
    return {"url": url or env("DATABASE_URL", "jdbc:postgresql://localhost:5432/postgres"), "loginTimeout": str(timeout_s)} | more


def jdbc_reader(spark: SparkSession, table: str, url: str | None = None, *, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **more: str) -> DataFrame:
    """A table or query over JDBC, read in parallel where a column with bounds is given."""
    reader = spark.read.format("jdbc").options(**jdbc_options(url, **more)).option("dbtable", table)
    if partition_column and bounds:
        reader = reader.options(partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return reader.load()


def kafka_options(brokers: str | None = None) -> dict[str, str]:
    """What reader and writer share."""
    return {"kafka.bootstrap.servers": brokers or env("KAFKA_BROKER", "localhost:9092")}


def kafka_reader_options(topics: list[str], brokers: str | None = None) -> dict[str, str]:
    """K8, K9: a list of topics from the earliest record."""
    return kafka_options(brokers) | {"subscribe": ",".join(topics), "startingOffsets": "earliest"}


def kafka_writer_options(topic: str, brokers: str | None = None) -> dict[str, str]:
    """K5: one topic, with the strongest acknowledgement."""
    return kafka_options(brokers) | {"kafka.acks": "all", "topic": topic}


def kafka_reader(spark: SparkSession, topics: list[str], brokers: str | None = None) -> DataFrame:
    return spark.readStream.format("kafka").options(**kafka_reader_options(topics, brokers)).load()


def kafka_write(df: DataFrame, topic: str, brokers: str | None = None) -> None:
    """K5, K6, K7: append the bytes of column ``value``; all records are acknowledged on return."""
    df.select("value").write.format("kafka").options(**kafka_writer_options(topic, brokers)).save()
