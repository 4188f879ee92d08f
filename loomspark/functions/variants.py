"""JSON documents as variants (extension): any shape in one column, read by paths.

Spark's parser is lenient where the strict reader of ``jsoncodec`` is not: text behind the first document is
ignored and an empty text is null. Of a key that a document has twice, ``parse_json`` raises; integers become the smallest
fitting type, and other numbers decimals where they are written without an exponent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def document(value: Column, *, strict: bool = True) -> Column:
    """A JSON text as a variant. Malformed text raises, or is null if not ``strict``; null stays null."""
    return F.parse_json(value) if strict else F.try_parse_json(value)


def field(doc: Column, path: str, kind: str, *, strict: bool = False) -> Column:
    """What is at a path such as ``$.a[0].b``, cast to a type. A missing path is null, and so is a value that can't be cast unless
    ``strict``, which raises then. A JSON null is null."""
    return F.variant_get(doc, path, kind) if strict else F.try_variant_get(doc, path, kind)


def shape(doc: Column) -> Column:
    """Aggregate: the one schema that all documents fit, as DDL; where types clash it has VARIANT. Merged in tasks before the shuffle."""
    return F.schema_of_variant_agg(doc)
