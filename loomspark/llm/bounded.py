"""Joins that broadcast one side only where its size has been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Bytes that one broadcast may hold, as its rows count in memory; more are joined by a shuffle.
MOST_BYTES = 64 << 20
#: What a row takes beside its columns there.
ROW_BYTES = 16


def few(df: DataFrame, *, width: int = 0) -> DataFrame:
    """``df`` written once and hinted to be broadcast if it is small: its rows are counted, and each
    has 8 bytes a column and ``width`` more for what its columns hold beside that."""
    df = df if hasattr(df, "stored_at") else stored(df, "few")
    if df.count() * (ROW_BYTES + 8 * len(df.columns) + width) > MOST_BYTES:
        return df
    out = F.broadcast(df)
    out.stored_at = df.stored_at
    return out


def with_lists(docs: DataFrame, lists: DataFrame, *, inner: bool = False, also: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with the array columns of ``lists``, which has a row for each doc_id at most.

    ``also`` are columns of ``docs`` and those of ``lists`` that they equal where doc_id alone is no key."""
    also = also or {}
    arrays = [c for c in lists.columns if c != "doc_id" and c not in also.values()]
    size = lists.agg(F.sum(F.lit(64) + sum(F.lit(8) * F.greatest(F.size(c), F.lit(0)) for c in arrays))).first()[0] or 0
    if size <= MOST_BYTES:
        lists = F.broadcast(lists)
    own = unused(docs, "own")
    match, renamed = F.col("doc_id").eqNullSafe(F.col(own)), lists.withColumnRenamed("doc_id", own)
    for mine, theirs in also.items():
        name = unused(docs, f"{own}_{theirs}")
        match, renamed = match & (F.col(mine) == F.col(name)), renamed.withColumnRenamed(theirs, name)
    return docs.join(renamed, match, "inner" if inner else "left").select(*(docs[c] for c in docs.columns), *arrays)


def unused(df: DataFrame, name: str) -> str:
    """``name`` behind as many underscores as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
