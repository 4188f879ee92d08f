"""Session set-up and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths that the innermost ``temporaries`` is to delete.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: Bytes of rows in one Arrow batch; a task holds a batch outside the JVM's heap and once more in its Python worker.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def env(name: str, default: str) -> str:
    """An environment variable, or ``default`` where it is unset."""
    return os.environ.get(name, default)


def build(master: str | None = None, app: str = "loomspark", **conf: str) -> SparkSession:
    """A session with the library's defaults; ``conf`` (dots as ``__``) overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def small_batches(spark: SparkSession) -> None:
    """Let no Arrow batch of this session hold much more than ``BATCH_BYTES``, where Spark's default is 64 MB; a bound that was
    set before stays. Spark reads the setting when a query runs, so it stays after the operator that asked for it."""
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else one made for local runs.

    A machine-local folder is only made on a local master, where driver and executors are one
    process; on a cluster an unset ``spark.checkpoint.dir`` is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


@contextmanager
def temporaries(spark: SparkSession) -> Iterator[list[str]]:
    """Delete all that is stored below the shared folder within the block, once it ends, but for paths that are removed from
    the list. DataFrames that read it can't be used after that, so what is to stay must be stored and taken off the list."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)
        for path in made:
            discard(spark, path)


def stored(df: DataFrame, kind: str = "stored") -> DataFrame:
    """``df`` written to the shared folder and read back.

    This cuts the lineage in a form that outlives lost executors, and it fixes values that a
    second evaluation might not repeat.
    """
    path = scratch(df.sparkSession, kind)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote, once everything made of it has been written itself."""
    for df in tables:
        if path := getattr(df, "stored_at", None):
            discard(df.sparkSession, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete ``path`` if it is there; errors are swallowed."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001
        pass
