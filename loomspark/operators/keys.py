"""Generated keys and key validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from ..sources.tables import SessionTable


def with_serial(df: DataFrame, order: list[str], name: str = "id", *, start: int = 1) -> DataFrame:
    """``df`` with dense integers from ``start`` in the order of the columns ``order``.

    The rows are range-partitioned and sorted by those columns and written once, each with its
    place in its partition; a row's number is that and the sum of the counts before it. Nothing
    runs in one task but the running sum over one row per partition, and nothing is shuffled twice.
    Ties of ``order`` are numbered in any order. Nulls sort first. Values past the range of INT raise.
    """
    spark = df.sparkSession
    if {"__place", "__part", "__base"} & set(df.columns):
        raise ValueError("__place, __part and __base are used here")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = stored(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()), "serial")
    ranged = ordered.withColumns({"__part": part_of("__place"), "__place": place_in_part("__place")})
    counts = ranged.groupBy("__part").agg(F.count("*").alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each shuffle partition
    bases = counts.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    number = F.col("__place") + F.col("__base") + F.lit(start)
    return ranged.join(F.broadcast(bases), "__part").select(*df.columns, number.cast("int").alias(name))


def part_of(place: str) -> Column:
    """The partition in a value of ``monotonically_increasing_id``."""
    return F.shiftright(place, 33).cast("int")


def place_in_part(place: str) -> Column:
    """The place of a row within its partition in such a value."""
    return F.col(place).bitwiseAND(F.lit((1 << 33) - 1))


def key_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """The keys that break a primary key, with their counts.

    A key is reported if it occurs more than once or has a null part. The counts are
    combined before the shuffle, so a hot key costs one row for each task.
    """
    missing = F.lit(False)
    for c in key:
        missing = missing | F.col(c).isNull()
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).where((F.col("n_rows") > 1) | missing)


def assert_key(df: DataFrame, key: list[str]) -> DataFrame:
    """``df`` unchanged, or an error that names one bad key."""
    bad = key_violations(df, key).first()
    if bad is not None:
        raise ValueError(f"key {key} is violated by {bad.asDict()}")
    return df


def insert_returning(table: SessionTable, rows: DataFrame, order: list[str], key: str = "id") -> DataFrame:
    """Give ``rows`` the next keys, append them, and return the keyed rows.

    The keyed rows are written once, into the table, and read from there, so what is returned and what is stored
    agree. One writer at a time is assumed.
    """
    last = table.df().agg(F.max(key)).first()[0] or 0
    keyed = table.append_all(with_serial(rows, order, key, start=last + 1))
    return keyed.select(*(c for c in keyed.columns if c == key or c in rows.columns))
