"""Table scan, lookup and session tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import discard, scratch


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A parquet table of ``folder``."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def point_lookup(df: DataFrame, key: str, value: object, columns: list[str]) -> DataFrame:
    """``columns`` of the rows whose ``key`` equals a bound value.

    The filter and the column list reach the scan. A null value matches nothing.
    """
    spark = df.sparkSession
    names = ", ".join(f"`{c}`" for c in columns)
    return spark.sql(f"SELECT {names} FROM {{df}} WHERE `{key}` = :value", args={"value": value}, df=df)


def scalar(df: DataFrame) -> object:
    """The first column of the first row; None where there is no row."""
    row = df.first()
    return None if row is None else row[0]


class SessionTable:
    """An insertable table that only this session sees, backed by parquet files.

    It ends with the session or with ``drop``, which also removes the files. Appends commit
    as one Spark job each; there is no transaction over several (R2).
    """

    def __init__(self, spark: SparkSession, name: str, ddl: str):
        self.spark, self.name, self.path = spark, name, scratch(spark, "table")
        self.schema = spark.createDataFrame([], ddl).schema
        spark.createDataFrame([], self.schema).write.parquet(self.path)
        spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW `{name}` ({ddl}) USING parquet OPTIONS (path '{self.path}')")

    def append(self, df: DataFrame) -> None:
        """Add rows; columns that ``df`` lacks become null, unknown ones are an error."""
        if extra := set(df.columns) - set(self.schema.names):
            raise ValueError(f"no such columns: {sorted(extra)}")
        self.append_all(df)

    def append_all(self, df: DataFrame) -> DataFrame:
        """Add rows and return them as they were written. Columns that the table doesn't have are written beside its own,
        which the table doesn't read, and returned. One writer at a time is assumed."""
        have, own = set(df.columns), set(self.schema.names)
        cols = [f"CAST({'`' + f.name + '`' if f.name in have else 'NULL'} AS {f.dataType.simpleString()}) AS `{f.name}`" for f in self.schema]
        typed = df.selectExpr(*cols, *(f"`{c}`" for c in df.columns if c not in own))
        before = self._files()
        typed.write.mode("append").parquet(self.path)
        self.spark.catalog.refreshTable(self.name)
        new = sorted(self._files() - before)  # a name for each task
        return self.spark.read.schema(typed.schema).parquet(*new) if new else typed.limit(0)

    def _files(self) -> set[str]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        return {f.getPath().toString() for f in files if f.getPath().getName().startswith("part-")}

    def insert(self, columns: list[str], values: list[object]) -> None:
        """One row of bound values."""
        names, marks = ", ".join(f"`{c}`" for c in columns), ", ".join("?" * len(values))
        self.spark.sql(f"INSERT INTO `{self.name}` ({names}) VALUES ({marks})", args=values)

    def df(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.catalog.dropTempView(self.name)
        discard(self.spark, self.path)
