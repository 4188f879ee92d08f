"""Mixing sources to target weights by Poisson replication (operator 5, DataFrame functions only).

A document of source s is repeated n times, n being the inverse of the Poisson distribution with
mean ``epochs * weight_s * total mass / mass_s`` at a uniform number hashed from seed and doc_id.
Copies are decided row by row, so a hot source needs no split, and the same seed gives the same
result on any cluster.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .bounded import MOST_BYTES, unused

#: Sources with means up to this have a table of their distribution; with larger ones, which are small beside the rest,
#: it is summed for each row, in proportion to the row's copies.
MOST = 100
#: A row's terms and copies are listed in blocks of so many.
BLOCK = 10_000
#: Characters that a partition of the result has, about; it has as many partitions as the session shuffles to at least.
PARTITION_CHARS = 128 << 20


def hashed(*parts: Column | str, digits: int) -> Column:
    """The first hex digits of an md5 as a long."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def _last(mean: Column) -> Column:
    """The last term that is summed: as far as doubles tell the distribution from 1."""
    return F.ceil(mean + 12 * F.sqrt(mean) + 30)


def poisson_table(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson distribution, as far as doubles tell it from 1."""
    last = _last(mean).cast("int")
    start = F.struct((-mean).alias("lp"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("cdf"))

    def step(s: Column, k: Column) -> Column:
        lp = s["lp"] + F.log(mean / k)
        c = s["c"] + F.exp(lp)
        return F.struct(lp.alias("lp"), c.alias("c"), F.concat(s["cdf"], F.array(c)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["cdf"]


def _blocks(last: Column, body, start: Column) -> Column:
    """Aggregates body(state, k) over k = 1 ... last, without a list of all k."""
    at = F.sequence(F.lit(0).cast("long"), F.floor((last - 1) / BLOCK))
    return F.aggregate(at, start, lambda s, b: F.aggregate(F.sequence(b * BLOCK + 1, F.least((b + 1) * BLOCK, last)), s, body))


def poisson_inverse(mean: Column, uniform: Column) -> Column:
    """How many of P(X <= 0), P(X <= 1), ... are below ``uniform``; the same as by a table, with work
    in proportion to the mean, as the copies have, and no list of that length."""
    start = F.struct((-mean).alias("lp"), F.exp(-mean).alias("c"), F.when(F.exp(-mean) < uniform, 1).otherwise(0).cast("long").alias("n"))

    def step(s: Column, k: Column) -> Column:
        lp = s["lp"] + F.log(mean / k)
        c = s["c"] + F.exp(lp)
        return F.struct(lp.alias("lp"), c.alias("c"), (s["n"] + F.when(c < uniform, 1).otherwise(0)).alias("n"))

    return _blocks(_last(mean), step, start)["n"].cast("int")


def source_rates(docs: DataFrame, weights: dict[str, float] | None, power: float, epochs: float) -> DataFrame:
    """A row for each source: its rate, up to a rate of MOST its Poisson table (null beyond), and the characters expected of it."""
    source = F.coalesce("source", F.lit("")).alias("__source")
    mass = (F.coalesce(F.length("text"), F.lit(0)) + 1).cast("long")
    # a few rows for each task reach the shuffle, however many rows a source has
    sizes = stored(docs.groupBy(source).agg(F.sum(mass).alias("mass")), "sources")
    if weights is None:
        weighted = sizes.withColumn("raw", F.pow(F.col("mass").cast("double"), F.lit(power)))
        total = weighted.agg(F.sum("mass").alias("total"), F.sum("raw").alias("raws"))
        rated = weighted.crossJoin(F.broadcast(total)).withColumn("weight", F.col("raw") / F.col("raws"))  # one row
    else:
        left = 1 - sum(weights.values())
        if left < -1e-9 or min(weights.values(), default=0) < 0:
            raise ValueError("weights must not be negative nor sum to more than 1")
        named = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("__source")] if weights else F.lit(None).cast("double")
        weighted = sizes.withColumn("named", named)
        rest = F.when(F.col("named").isNull(), F.col("mass")).otherwise(0)
        total = weighted.agg(F.sum("mass").alias("total"), F.sum(rest).alias("rests"))
        rated = weighted.crossJoin(F.broadcast(total)).withColumn("weight", F.coalesce("named", F.lit(max(0.0, left)) * F.col("mass") / F.col("rests")))
    rate = F.lit(float(epochs)) * F.col("weight") * F.col("total") / F.col("mass")
    rated = rated.select("__source", rate.alias("__rate"), (rate * F.col("mass")).alias("chars"))
    return stored(rated.withColumn("__cdf", F.when(F.col("__rate") <= MOST, poisson_table(F.col("__rate")))).select("__source", "__rate", "__cdf", "chars"), "rates")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, *, power: float = 0.5, epochs: float = 1.0, seed: int = 17) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with each row repeated and all rows shuffled.

    ``weights`` are shares of the result's characters by source; sources that it doesn't name
    share the rest by their size, and None weighs every source by its size to the ``power``.
    All columns stay; ``copy`` (from 1), ``n_copies`` and ``shuffle_key`` are added (columns of
    these names are replaced; any other name may occur). Rows are dealt to partitions by the hashed key and sorted by it
    within each. A null source counts as '', a null or empty text as one character; rows with
    the same doc_id and source, repeated rows among them, get the same number of copies each; an empty table gives no rows.
    """
    spark, own = docs.sparkSession, ["copy", "n_copies", "shuffle_key"]
    docs = docs.drop(*own)
    rates = source_rates(docs, weights, power, epochs)
    source, rate, cdf, block_no = (unused(docs, c) for c in ("__source", "__rate", "__cdf", "__block"))
    held = F.lit(64) + F.octet_length("__source") + 8 * F.greatest(F.size("__cdf"), F.lit(0))
    size, chars = rates.agg(F.coalesce(F.sum(held), F.lit(0)), F.coalesce(F.sum("chars"), F.lit(0.0))).first()
    rates = rates.drop("chars").toDF(source, rate, cdf)
    if size <= MOST_BYTES:
        rates = F.broadcast(rates)
    uniform = (hashed(str(seed), F.col("doc_id"), digits=13) + F.lit(0.5)) / F.lit(float(1 << 52))
    n = F.when(F.col(cdf).isNotNull(), F.size(F.filter(cdf, lambda c: c < uniform))).otherwise(poisson_inverse(F.col(rate), uniform))
    counted = docs.withColumn(source, F.coalesce("source", F.lit(""))).join(rates, source).withColumn("n_copies", n).where("n_copies > 0")
    blocks = counted.select(*docs.columns, "n_copies", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_copies") - 1) / BLOCK).cast("int"))).alias(block_no))
    block = F.sequence(F.col(block_no) * BLOCK + 1, F.least((F.col(block_no) + 1) * BLOCK, F.col("n_copies")))
    copies = blocks.select(*docs.columns, "n_copies", F.explode(block).alias("copy"))
    keyed = copies.withColumn("shuffle_key", hashed(str(seed), F.col("doc_id"), F.col("copy"), digits=15))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(chars / PARTITION_CHARS))
    return keyed.repartition(parts, "shuffle_key").sortWithinPartitions("shuffle_key")
