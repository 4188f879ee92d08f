"""Names and the constant health record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def unique_name(prefix: str = "smoke-") -> Column:
    """K3: ``prefix`` and eight random hex digits."""
    return F.expr(f"concat('{prefix}', substr(replace(uuid(), '-', ''), 1, 8))")


def health(spark: SparkSession) -> DataFrame:
    """One row that says ok."""
    return spark.sql("SELECT 'ok' AS status")
