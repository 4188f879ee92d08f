"""Token ids in flat binary files with 64-bit document offsets (operator 8).

A set of files is one folder. For each range of doc_id it has ``<name>.bin`` (the ids in a row,
little-endian unsigned integers of 2 or 4 bytes), ``<name>.off`` (n + 1 unsigned 64-bit offsets
counted in ids from the file's start) and ``<name>.doc`` (n signed 64-bit doc_ids, 0 for null).
``manifest`` is a Parquet table with a row for each range; a range's base in the whole corpus is the
prefix sum of the ids before it. Null doc_ids come first in a range, and ``n_nulls`` counts them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import CHUNK, Encoder
from .words import chunks

MANIFEST = "first_doc long, name string, n_docs long, n_nulls long, n_tokens long, width int"
#: Bytes of text in a range, about; there are as many ranges as the session has shuffle partitions at least.
RANGE_BYTES = 256 << 20
#: Documents that ``read`` deals together.
SLICE_DOCS = 1 << 16
#: Ids that are held at once in reading; a longer document is held alone.
IDS = 1 << 20
#: Characters of a text by which rows with equal doc_ids are dealt to ranges.
PREFIX = 256


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def _writer(folder: str, tokenizer: str, end_id: int, width: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out = Encoder.of(tokenizer), None
        n_docs = n_nulls = n_tokens = 0
        first = None
        for batch, data, offsets in chunks(batches, limit=CHUNK):
            if out is None:
                # a retried or speculative task writes other files; only the manifest counts
                name = f"part-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}"
                where, path = place(f"{folder}/{name}")
                where.create_dir(path.rpartition("/")[0], recursive=True)
                out = {k: where.open_output_stream(f"{path}.{k}") for k in ("bin", "off", "doc")}
                out["off"].write(np.zeros(1, "<u8").tobytes())
                first = batch.column("doc_id")[0].as_py()
            ids, sizes = encoder.encode(data, offsets)
            ends = np.cumsum(sizes)
            ids = np.insert(ids, ends, end_id)
            if width == 2 and len(ids) and ids.max() > 0xFFFF:
                raise ValueError("an id takes more than 2 bytes")
            out["bin"].write(ids.astype(f"<u{width}").tobytes())
            out["off"].write((ends + np.arange(1, len(ends) + 1) + n_tokens).astype("<u8").tobytes())
            out["doc"].write(np.asarray(batch.column("doc_id").fill_null(0), "<i8").tobytes())
            n_docs, n_nulls, n_tokens = n_docs + len(sizes), n_nulls + batch.column("doc_id").null_count, n_tokens + len(ids)
        if out is not None:
            for f in out.values():
                f.close()
            yield pa.RecordBatch.from_pylist([{"first_doc": first, "name": name, "n_docs": n_docs, "n_nulls": n_nulls, "n_tokens": n_tokens, "width": width}], pa.schema([("first_doc", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_nulls", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())]))

    return write


def write(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = 0, width: int = 2, range_bytes: int = RANGE_BYTES) -> None:
    """Encode ``docs`` (doc_id, text) into files below ``folder``, a folder all executors share.

    Rows are range-partitioned and sorted by doc_id (null first; rows with equal doc_ids follow each
    other, in the order of their texts, over as many ranges as they fill, but that texts with the same first ``PREFIX`` characters
    and more share one), each partition is one range, and a document is
    its ids and ``end_id``. A range has about ``range_bytes`` of text, or less. A null or empty text is the end id
    alone, repeated rows are documents each, other columns are ignored, and of an empty table no range is written. A lost
    task is written again under another name.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))
    prefix = F.substring("text", 1, PREFIX)
    # equal texts that are not longer may lie in several ranges, before the longer ones that begin with them
    salt = F.when(prefix.eqNullSafe(F.col("text")), F.monotonically_increasing_id()).otherwise(F.lit((1 << 63) - 1))
    ordered = rows.withColumn("salt", salt).repartitionByRange(parts, "doc_id", prefix, "salt").sortWithinPartitions("doc_id", "text")
    ordered.select("doc_id", "text").mapInArrow(_writer(folder, tokenizer, end_id, width), MANIFEST).write.parquet(f"{folder}/manifest")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each range of files with ``base``, the ids of all ranges before it."""
    ranges = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # a row for each file, so one task does for the running sum; names begin with the number of their range
    before = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class Numbers:
    """A file of numbers, memory-mapped where it is on a mounted file system and read by places elsewhere."""

    def __init__(self, folder: str, name: str, kind: str, dtype: str):
        where, path = place(f"{folder}/{name}.{kind}")
        self.dtype, self.file, self.map = np.dtype(dtype), None, None
        if not isinstance(where, fs.LocalFileSystem):
            self.file = where.open_input_file(path)
        else:
            self.map = np.memmap(path, dtype, "r") if where.get_file_info(path).size else np.zeros(0, dtype)

    def __getitem__(self, at: slice) -> np.ndarray:
        if self.map is not None:
            return self.map[at]
        return np.frombuffer(self.file.read_at((at.stop - at.start) * self.dtype.itemsize, at.start * self.dtype.itemsize), self.dtype)


def read(spark: SparkSession, folder: str, *, slice_docs: int = SLICE_DOCS) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens,
    and ``ids``, its ids as little-endian unsigned 32-bit integers. Tasks take ``slice_docs`` documents of a
    file at a time and read only their places in it."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, lo = Numbers(folder, r["name"], "bin", f"<u{r['width']}"), r["lo"]
                n = min(slice_docs, r["n_docs"] - lo)
                off = Numbers(folder, r["name"], "off", "<u8")[lo : lo + n + 1].astype(np.int64)
                doc = Numbers(folder, r["name"], "doc", "<i8")[lo : lo + n]
                at = 0
                while at < n:
                    to = min(n, max(at + 1, int(np.searchsorted(off, off[at] + IDS, "right")) - 1))
                    part = ids[int(off[at]) : int(off[to])].astype("<u4")
                    cuts = ((off[at : to + 1] - off[at]) * 4).astype(np.int32)
                    blob = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(cuts), pa.py_buffer(part)])
                    own = pa.array(doc[at:to], pa.int64(), mask=np.arange(lo + at, lo + to) < r["n_nulls"])
                    yield pa.RecordBatch.from_arrays([own, pa.array(off[at:to] + r["base"]), pa.array(np.diff(off[at : to + 1])), blob], ["doc_id", "start", "n_tokens", "ids"])
                    at = to

    files = manifest(spark, folder)
    # the files are dealt by slices of documents, and by more tasks the more slices there are
    slices = files.select("name", "width", "base", "n_docs", "n_nulls", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(slice_docs).cast("long"))).alias("lo"))
    n = files.agg(F.sum(F.ceil(F.col("n_docs") / slice_docs))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 16)
    return slices.repartition(parts).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")
