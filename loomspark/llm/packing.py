"""Vector best-fit packing of documents into token sequences (operator 10).

Every sequence has three capacities: tokens, documents and attention cost (the sum of squared
piece lengths). Pieces come in falling length; each goes to the open sequence that can take it
under every capacity and scores best, by the weighted norm of what the sequence would have left or
by the weighted dot product of the piece and what is left. Pieces are dealt to shards of bounded size
by hash, and each shard is packed on its own; a shard loses less than one sequence to the others.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_batches
from .tokens import CHUNK, Encoder
from .words import U, chunks, mix

#: A shard has about so many bytes of text, or so many documents, whichever is fewer.
SHARD_BYTES, SHARD_DOCS = 16 << 20, 4_000


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each piece and its place there."""
    cap = np.array(capacity, float)
    size = np.stack([lengths, np.ones_like(lengths), lengths.astype(np.int64) ** 2], 1).astype(float)
    if len(size) and (size > cap).any():
        raise ValueError("a piece is larger than a sequence")
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left = np.empty((max(1, len(lengths)), 3))  # of each sequence
    w, n, low = np.array(weights) / cap**2, 0, 0
    full = lengths == capacity[0]
    k = int(full.sum())
    sequence[full], offset[full] = np.arange(k), 0
    n = low = k
    for i in np.argsort(-lengths, kind="stable"):
        if full[i]:
            continue
        s = size[i]
        open_ = left[low:n]
        fits = np.flatnonzero((open_[:, 0] >= s[0]) & (open_[:, 1] >= s[1]) & (open_[:, 2] >= s[2]))
        if len(fits):
            rest = open_[fits]
            score = ((rest - s) ** 2) @ w if rule == "norm" else -(rest @ (s * w))
            b = low + int(fits[np.argmin(score)])
        else:
            b, n = n, n + 1
            left[b] = cap
        sequence[i], offset[i] = b, capacity[0] - left[b, 0]
        left[b] -= s
    return sequence, offset


def _pieces(tokenizer: str, end_id: int, most: int, shards: int) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for number, (batch, data, offsets) in enumerate(chunks(batches, limit=CHUNK)):
            ids, sizes = encoder.encode(data, offsets)
            ids = np.insert(ids, np.cumsum(sizes), end_id).astype("<u4")
            sizes = sizes + 1
            base = np.cumsum(sizes) - sizes
            count = -(-sizes // most)
            doc = np.repeat(np.arange(len(sizes)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            short = (sizes - (count - 1) * most)[doc]  # the first piece has what does not fill a sequence
            start = np.where(piece == 0, 0, short + (piece - 1) * most)
            length = np.where(piece == 0, short, most)
            names = batch.column("doc_id")
            # rows that share a doc_id are told apart by their chunk and number within it, so that many of them spread over shards
            known = np.asarray(names.fill_null(-1), np.int64)
            order = np.argsort(known, kind="stable")
            new = np.append(True, known[order][1:] != known[order][:-1])
            again = np.empty(len(order), np.int64)
            again[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            key = mix(known.view(U) + U(0x9E3779B97F4A7C15) * (again + (number << 20)).astype(U))[doc]
            shard = (mix(key + piece.astype(U)) % U(shards)).astype(np.int32)
            cuts = np.concatenate([[0], np.cumsum(length)]) * 4
            blob = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), blob], ["shard", "doc_id", "piece", "start", "length", "ids"])

    return cut


def packed(docs: DataFrame, tokenizer: str, *, tokens: int = 2048, documents: int | None = None, attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm", end_id: int = 0) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text) with their places: doc_id, piece, start, length,
    sequence_id, offset and ``ids`` (little-endian unsigned 32-bit).

    Only documents of more than ``tokens`` ids, the end id included, are cut (of more than the
    square root of ``attention``, where that is less). ``documents`` and
    ``attention`` bound the pieces in a sequence and the sum of their squared lengths; None
    leaves the token count alone to decide (no sequence could exceed the two then). A null text
    is the end id alone. Repeated rows are packed each on its own, other columns are ignored,
    and an empty table gives no pieces.
    """
    small_batches(docs.sparkSession)
    capacity = (tokens, documents or tokens, attention or tokens * tokens)
    most = min(tokens, math.isqrt(capacity[2]))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(1, -(-size // SHARD_BYTES), -(-n // SHARD_DOCS))
    pieces = rows.mapInArrow(_pieces(tokenizer, end_id, most, shards), "shard int, doc_id long, piece int, start long, length long, ids binary")

    def place(table: pa.Table) -> pa.Table:
        # order by content, so that a second run of a lost task packs alike
        order = pc.sort_indices(table.drop_columns(["ids"]), [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]).to_numpy()
        sequence, offset = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        sequence[order], offset[order] = best_fit(table.column("length").to_numpy()[order], capacity, weights, rule)
        shard = np.asarray(table.column("shard"), np.int64)
        return table.drop_columns(["shard"]).append_column("sequence_id", pa.array((shard << 32) + sequence)).append_column("offset", pa.array(offset))

    return pieces.groupBy("shard").applyInArrow(place, "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")
