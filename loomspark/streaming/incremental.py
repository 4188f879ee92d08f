"""A stateful stream as a series of jobs (extension): each run takes what is new and goes on from the checkpoint."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, scratch, stored
from .log import await_or_fail

#: State store that keeps state on disk and in the checkpoint, and not in the memory of executors.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Incremental:
    """A streaming query over folders of Parquet files, run again and again.

    ``make`` gets one streaming DataFrame for each of ``sources`` (a name and a schema each) and returns the
    query's DataFrame, which is appended to a sink. Folder, checkpoint and sink are below ``path`` in the shared folder: an object made
    anew with that path goes on where the last one ended, with its state and its watermark.

    A row is *late* if the query's state for it is closed, which depends on the largest time in all
    earlier runs, less the delay of ``withWatermark``. Within a run no row makes another one late.
    """

    def __init__(self, spark: SparkSession, sources: dict[str, str], make: Callable[..., DataFrame], *, path: str | None = None):
        self.spark, self.sources, self.make = spark, sources, make
        self.path = path or scratch(spark, "incremental")
        if path is None:
            for name, ddl in sources.items():
                spark.createDataFrame([], ddl).write.parquet(f"{self.path}/in/{name}")

    def feed(self, name: str, rows: DataFrame) -> None:
        """Add rows to a source; they are durable on return and belong to the next run."""
        schema = self.spark.createDataFrame([], self.sources[name]).schema
        rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema)).write.mode("append").parquet(f"{self.path}/in/{name}")

    def run(self, *, deadline_s: int = 1800) -> None:
        """Process what is new, and close what the new watermark closes."""
        streams = [self.spark.readStream.schema(ddl).parquet(f"{self.path}/in/{name}") for name, ddl in self.sources.items()]
        before = self.spark.conf.get(ROCKS[0], None)
        self.spark.conf.set(*ROCKS)
        try:
            query = self.make(*streams).writeStream.format("parquet").option("path", f"{self.path}/out").option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True).start()
            await_or_fail(query, deadline_s)
        finally:
            self.spark.conf.unset(ROCKS[0]) if before is None else self.spark.conf.set(ROCKS[0], before)

    def watermark(self) -> int:
        """The watermark that the next run starts with, in milliseconds; 0 before the first. It is read from the
        checkpoint's offsets, of which there are a few hundred small files at most."""
        if not self._there("state/offsets"):
            return 0
        texts = self.spark.read.text(f"{self.path}/state/offsets", wholetext=True).collect()
        return max((json.loads(r.value.split("\n")[1])["batchWatermarkMs"] for r in texts), default=0)

    def result(self, ddl: str) -> DataFrame:
        """All rows that runs have appended; rows of a run that failed are not among them."""
        if not self._there("out/_spark_metadata"):
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(f"{self.path}/out")

    def drop(self) -> None:
        discard(self.spark, self.path)

    def _there(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def replay(job: Incremental, rows: dict[str, DataFrame], batch: Column, batches: int, *, close: dict[str, DataFrame] | None = None, late: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame | None:
    """Run ``job`` once for each value from 0 of ``batch``, a column of each table of ``rows``, with the rows of that value.

    ``close`` are rows for a last run, whose times move the watermark past all others, so that all state
    closes. ``late`` gets the rows of each batch and the watermark before it; what it makes of them is returned, for all batches.
    """
    parts = {name: stored(df.withColumn("__batch", batch.cast("int")), "arrivals") for name, df in rows.items()}
    lost = []
    for b in range(batches):
        new = {name: df.where(F.col("__batch") == b).drop("__batch") for name, df in parts.items()}
        if late is not None:
            watermark = job.watermark()
            lost += [late(df, watermark) for df in new.values()]
        for name, df in new.items():
            job.feed(name, df)
        job.run()
    for name, df in (close or {}).items():
        job.feed(name, df)
    if close:
        job.run()
    out = None
    for df in lost:
        out = df if out is None else out.unionByName(df)
    return out
