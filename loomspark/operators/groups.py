"""Grouping sets, range frames, top rows and mergeable sketches (extensions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timejoins import ticks


def grouping_sets(df: DataFrame, sets: list[list[str]], *, sums: dict[str, Column], distinct: dict[str, str] | None = None) -> DataFrame:
    """``sums`` (names and what to add up) and numbers of ``distinct`` values (names and columns) for each grouping of ``sets``,
    with ``grouping_id``: the bits of the columns that a row's grouping leaves out, the first column highest.

    A null in a column that the grouping has is a group of its own, told from one that is left out by ``grouping_id``. Nulls add nothing and
    are no distinct value; a sum over nothing but nulls is null. Without rows there is no group, not even of an empty grouping.
    Rows are first added up by all columns and distinct values together, so that only groups, not rows, are multiplied by the sets.
    """
    keys = list(dict.fromkeys(c for s in sets for c in s))
    counted = distinct or {}
    fine = df.groupBy(*keys, *(F.col(c).alias(f"__{n}") for n, c in counted.items())).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    aggregates = [F.sum(n).alias(n) for n in sums] + [F.count_distinct(f"__{n}").alias(n) for n in counted]
    return fine.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(*aggregates, F.grouping_id().alias("grouping_id"))


def rollup_sets(columns: list[str]) -> list[list[str]]:
    return [columns[:n] for n in range(len(columns), -1, -1)]


def cube_sets(columns: list[str]) -> list[list[str]]:
    return [[c for i, c in enumerate(columns) if not bits >> (len(columns) - 1 - i) & 1] for bits in range(1 << len(columns))]


def trailing(df: DataFrame, *, by: list[str], time: str, before: int, aggregates: dict[str, Column], slice_: int | None = None) -> DataFrame:
    """``df`` with aggregates over the rows of the same ``by`` columns whose time is at most ``before`` (in ``ticks``) earlier, and not later.

    Rows at one time, each included, see each other. A null key is a key; rows with a null time see each other alone. Keys are cut into slices of
    ``slice_`` ticks, by default a hundred times ``before``, and the last ``before`` ticks of a slice are dealt to the next one too, as rows that
    are seen but not returned. So a key with most rows is many tasks.
    """
    width = max(slice_ or 100 * before, before, 1)
    t = ticks(df, time)
    own = F.floor(t / width)
    # of a row near its slice's end, a copy goes to the next slice
    near = F.floor((t + before) / width)
    places = F.when(t.isNull(), F.array(F.lit(None).cast("long"))).when(near > own, F.array(own, near)).otherwise(F.array(own))
    dealt = df.withColumns({"__t": t, "__own": own}).withColumn("__slice", F.explode(places))
    w = Window.partitionBy(*by, "__slice").orderBy("__t").rangeBetween(-before, 0)
    seen = dealt.withColumns({n: c.over(w) for n, c in aggregates.items()})
    return seen.where(F.col("__slice").eqNullSafe(F.col("__own"))).drop("__t", "__own", "__slice")


def top_rows(df: DataFrame, *, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key in ``order``, numbered from 1; a null key is a key. Every task passes on ``k`` rows of a key
    at most, so a key with most rows is no large group. Rows that tie in all of ``order`` come in any order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


#: log2 of the registers of a distinct-count sketch, and its relative standard error; the k of a quantile sketch, and its rank error.
HLL_BITS, HLL_ERROR = 14, 1.04 / (1 << 7)
KLL_K, KLL_ERROR = 400, 0.0068


def sketches(df: DataFrame, *, by: list[Column], distinct: str, value: str) -> DataFrame:
    """For each key a row with mergeable state: ``distinct_sketch`` (HyperLogLog of a column), ``value_sketch`` (KLL of a double column) and ``n`` rows."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(distinct, HLL_BITS).alias("distinct_sketch"), F.expr(f"kll_sketch_agg_double(CAST(`{value}` AS DOUBLE), {KLL_K})").alias("value_sketch"), F.count("*").alias("n"))


def merged(kept: DataFrame, *, by: list[Column]) -> DataFrame:
    """``sketches`` of coarser keys, from those of finer ones."""
    return kept.groupBy(*by).agg(F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.expr("kll_merge_agg_double(value_sketch)").alias("value_sketch"), F.sum("n").alias("n"))
