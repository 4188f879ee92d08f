"""JSON encode, decode and equality."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FAILFAST = {"mode": "FAILFAST", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def encode(*columns: str | Column) -> Column:
    """K4: the columns as one JSON object in UTF-8 bytes; null fields are written."""
    return F.encode(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), "UTF-8")


def decode(value: Column, ddl: str, mode: str = "failfast") -> Column:
    """A JSON object (bytes or string) as a typed struct.

    ``failfast`` raises where Spark's parser finds the input malformed; it accepts text behind the
    object and gives null for empty input. ``strict`` raises on these too, by parsing every document
    in full with Python first. ``permissive`` makes a struct of nulls of malformed input. All ignore
    unknown keys and read a missing key as null. Null input gives null.
    """
    if mode == "strict":
        return F.from_json(canonical_json(value), ddl, FAILFAST)
    return F.from_json(value.cast("string"), ddl, {"failfast": FAILFAST, "permissive": {"mode": "PERMISSIVE"}}[mode])


def _canonical(values: pd.Series) -> pd.Series:
    def one(b):
        return None if b is None else json.dumps(json.loads(bytes(b).decode("utf-8")), sort_keys=True)

    return values.map(one)


def canonical_json(value: Column) -> Column:
    """K12, strict form: sorted JSON text; malformed JSON, trailing text or bad UTF-8 raise."""
    return F.pandas_udf(_canonical, "string")(value.cast("binary"))


def same_document(left: Column, right: Column) -> Column:
    """K13 on raw documents: equal whatever the key order; extra keys make them unequal."""
    return canonical_json(left) == canonical_json(right)
