"""Tables with update, delete, merge and commits over several of them (extension; R2 for writes).

A table is dealt to buckets by its key, and a bucket is one folder of Parquet files that never changes. A change
writes new folders for the buckets that it touches. A commit writes one manifest, which names the folder of every bucket
of every table: readers see all changes of a transaction or none, and old versions stay readable until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.keys import assert_key
from ..session import discard, scratch, stored


class Conflict(RuntimeError):
    """Another commit came first."""


class VersionedTables:
    """Tables below ``path``, by default a new folder in the shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark, "tables")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._hadoop, self._files = hadoop, hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last committed version, 0 if there is none."""
        return max((int(n.removesuffix(".json")) for n in self._names("versions") if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/versions/{version}.json", wholetext=True).first().value)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of ``version``, by default the last one."""
        return self._read(self.manifest(version)[name])

    @contextmanager
    def transaction(self) -> Iterator[Transaction]:
        """Changes that are committed together at the end, or not at all if the block raises. A commit that another writer has come
        before raises ``Conflict``, and what was written is removed."""
        change = Transaction(self)
        try:
            yield change
            self._commit(change)
        except BaseException:
            for folder in change.written:
                discard(self.spark, folder)
            raise

    def vacuum(self) -> None:
        """Remove old versions and all folders that the last one doesn't name. No reader or writer may be at work."""
        last = self.version()
        used = {path.split("/")[-2] for table in self.manifest(last).values() for path in table["buckets"].values()}
        for name in self._names("data"):
            if name not in used:
                discard(self.spark, f"{self.path}/data/{name}")
        for name in self._names("versions"):
            if name != f"{last}.json":
                discard(self.spark, f"{self.path}/versions/{name}")

    def _commit(self, change: Transaction) -> None:
        if not change.written and not change.changed:
            return
        folder = f"{self.path}/versions"
        self._files.mkdirs(self._hadoop.Path(folder))
        draft = self._hadoop.Path(f"{folder}/.{uuid.uuid4().hex}")
        out = self._files.create(draft)
        out.write(bytearray(json.dumps(change.tables).encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self._files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:  # fails if the name is taken
            context.rename(draft, self._hadoop.Path(f"{folder}/{change.base + 1}.json"), self._none())
        except Exception as e:
            self._files.delete(draft, False)
            if self.version() > change.base:
                raise Conflict(f"version {change.base + 1} is taken") from e
            raise

    def _none(self):
        options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        return options

    def _names(self, folder: str) -> list[str]:
        path = self._hadoop.Path(f"{self.path}/{folder}")
        return [f.getPath().getName() for f in self._files.listStatus(path)] if self._files.exists(path) else []

    def _read(self, table: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(table["schema"])
        paths = [p for b, p in table["buckets"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


class Transaction:
    """Changes on top of one version; each sees those before it."""

    def __init__(self, store: VersionedTables):
        self.store, self.base, self.changed = store, store.version(), False
        self.tables: dict = store.manifest(self.base)
        self.written: list[str] = []

    def read(self, name: str) -> DataFrame:
        return self.store._read(self.tables[name])

    def create(self, name: str, rows: DataFrame, key: list[str], *, buckets: int = 8) -> None:
        """A new table with ``rows``. Its keys may repeat and may be null."""
        if name in self.tables:
            raise ValueError(f"{name} is there")
        if bad := set(key) - set(rows.columns):
            raise ValueError(f"no such columns: {sorted(bad)}")
        self.tables[name] = {"schema": rows.schema.jsonValue(), "key": key, "n": buckets, "buckets": {}}
        self._write(name, rows, None)

    def drop(self, name: str) -> None:
        del self.tables[name]
        self.changed = True

    def insert(self, name: str, rows: DataFrame) -> None:
        """Add rows; keys aren't compared."""
        self.merge(name, rows, on=[])

    def delete(self, name: str, condition: Column) -> None:
        """Remove the rows for which ``condition`` is true; where it is null a row stays."""
        self._each(name, condition, lambda rows: rows.where(~F.coalesce(condition, F.lit(False))))

    def update(self, name: str, condition: Column, values: dict[str, Column]) -> None:
        """Set columns, which may not be of the key, of the rows for which ``condition`` is true. All values are of the old row."""
        if bad := set(values) & set(self.tables[name]["key"]):
            raise ValueError(f"columns of the key: {sorted(bad)}")
        kinds = StructType.fromJson(self.tables[name]["schema"])
        now = lambda c: F.when(condition, values[c].cast(kinds[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c) if c in values else F.col(f"`{c}`")
        self._each(name, condition, lambda rows: rows.select(*map(now, rows.columns)))

    def merge(self, name: str, source: DataFrame, *, matched: dict[str, Column] | None = None, delete: Column | None = None, insert: bool = True, on: list[str] | None = None) -> None:
        """Merge ``source`` into a table by its key.

        Rows of the table whose key is in ``source`` get the ``matched`` values or, where ``delete`` is true, are removed; both may
        use the table's columns as ``t.`` and the source's as ``s.``. Rows of ``source`` whose key isn't in the table are
        added if ``insert``, with nulls for columns they lack. Null keys match nothing. A key that ``source`` has twice
        raises, as it leaves open which row is meant. Only buckets that hold keys of ``source`` are read and written.
        """
        table = self.tables[name]
        key = table["key"] if on is None else on
        schema = StructType.fromJson(table["schema"])
        source = stored(source.withColumn("__bucket", self._bucket(table, source)), "source")
        touched = sorted(r[0] for r in source.select("__bucket").distinct().collect())  # a number for each bucket
        kept, new = self.store._read(table, touched), source
        if key:
            known = reduce(lambda a, b: a & b, (F.col(f"`{c}`").isNotNull() for c in key))
            match = reduce(lambda a, b: a & b, (F.col(f"t.`{c}`") == F.col(f"s.`{c}`") for c in key))
            keyed = assert_key(source.where(known), key).withColumn("__met", F.lit(True))
            new = source.alias("s").join(kept.alias("t"), match, "left_anti")
            both, met = kept.alias("t").join(keyed.alias("s"), match, "left"), F.col("s.__met").isNotNull()
            if delete is not None:
                both = both.where(~(met & F.coalesce(delete, F.lit(False))))
            old, values = lambda c: F.col(f"t.`{c}`"), matched or {}
            kept = both.select(*((F.when(met, values[f.name].cast(f.dataType)).otherwise(old(f.name)) if f.name in values else old(f.name)).alias(f.name) for f in schema))
        if insert:
            kept = kept.unionByName(new.select(*((F.col(f"`{f.name}`") if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema)))
        self._write(name, kept, touched)

    def _each(self, name: str, condition: Column, change) -> None:
        """Rewrite the buckets that have a row for which ``condition`` is true."""
        table = self.tables[name]
        rows = self.read(name)
        touched = sorted(r[0] for r in rows.where(condition).select(self._bucket(table, rows).alias("b")).distinct().collect())  # a number for each bucket
        if touched:
            self._write(name, change(self.store._read(table, touched)), touched)

    def _bucket(self, table: dict, rows: DataFrame) -> Column:
        kinds = StructType.fromJson(table["schema"])
        return F.pmod(F.xxhash64(*(F.col(f"`{c}`").cast(kinds[c].dataType) for c in table["key"])), F.lit(table["n"])).cast("int")

    def _write(self, name: str, rows: DataFrame, touched: list[int] | None) -> None:
        """Put ``rows`` in place of the ``touched`` buckets (all of them if None)."""
        table = self.tables[name]
        folder = f"{self.store.path}/data/{name}-{uuid.uuid4().hex}"
        self.written.append(folder)
        # a bucket may hold most rows: its rows come from many tasks and lie in many files
        rows.withColumn("__bucket", self._bucket(table, rows)).write.partitionBy("__bucket").parquet(folder)
        made = {int(n.split("=")[1]): f"{folder}/{n}" for n in self.store._names(folder.removeprefix(f"{self.store.path}/")) if n.startswith("__bucket=")}
        kept = {} if touched is None else {b: p for b, p in table["buckets"].items() if int(b) not in touched}
        self.tables[name] = table | {"buckets": kept | {str(b): p for b, p in made.items()}}
        self.changed = True
