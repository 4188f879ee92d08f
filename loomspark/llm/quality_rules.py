"""Rule bitmask ledger (operator 1).

Every rule is evaluated once for each document. The ledger keeps the measurements and one long
whose bits are the rules that failed; a policy is a named, versioned set of bits, so that applying
another policy, or leaving one rule out, reads the ledger and no text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import small_batches
from .words import U, Words, chunks, groups, mix, spans_hash

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")

#: Bit i is rule i; each is a SQL predicate over the measurements that is true where it FAILS.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 20 * n_words"),
    ("duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 30 * n_words"),
    ("shouting", "n_letters >= 50 AND 100 * n_upper > 60 * n_letters"),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: (name, version) -> the rules that reject.
POLICIES = {
    ("base", 1): ("few_words", "repeated_words"),
    ("web", 1): ("few_words", "repeated_words", "symbols"),
    ("web", 2): tuple(BITS),
}

_SYMBOL, _UPPER, _LETTER = (np.zeros(256, bool) for _ in range(3))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in chunks(batches):
        w = Words(data, offsets)
        # lines: the spans between line feeds and the ends of texts; an empty text has none with a word
        cuts = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10), np.flatnonzero(data == 10) + 1]))
        at, to = cuts[:-1], cuts[1:]
        words_before = np.concatenate([[0], np.cumsum(w.inside)])
        worded = words_before[to] > words_before[at]
        at, to = at[worded], to[worded]
        line_text = np.searchsorted(offsets, at, "right") - 1
        _, first = groups(mix(spans_hash(data, at, to) + line_text.astype(U) * U(0x9E3779B97F4A7C15)))
        n = len(offsets) - 1
        # 3-word windows found twice or more in one text
        h, text, place = w.windows_at(3)
        count, _ = groups(mix(h + text.astype(U) * U(0x9E3779B97F4A7C15)))
        covered = np.zeros(len(w.hashes) + 2, bool)
        for j in range(3):
            covered[place[count > 1] + j] = True
        repeat = np.concatenate([[0], np.cumsum(covered)])
        cols = {
            "n_words": w.counts,
            "word_chars": w.per_text(w.inside & ((data & 0xC0) != 0x80)),
            "n_symbols": w.per_text(_SYMBOL[data]),
            "n_dup_lines": np.bincount(line_text[~first], minlength=n),
            "n_repeat_words": np.diff(repeat[w.first]),
            "n_lines": np.bincount(line_text, minlength=n),
            "n_upper": w.per_text(_UPPER[data]),
            "n_letters": w.per_text(_LETTER[data]),
        }
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(cols[m], pa.int64()) for m in MEASURES)], ["doc_id", *MEASURES])


def failed_bits(prefix: str = "") -> Column:
    """The rules' bits from measurement columns whose names begin with ``prefix``."""
    bits = F.lit(0).cast("long")
    for name, fails in RULES:
        fails = re.sub("|".join(MEASURES), lambda m: prefix + m[0], fails)
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(BITS[name])).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failed_bits`` of every row of ``docs`` (doc_id, text).

    No shuffle: each task measures the rows it reads, about 1 MB of text at a time. A null text
    counts as empty; it fails ``few_words`` alone. Repeated rows give repeated results, other
    columns are ignored, and an empty table gives an empty ledger.
    """
    small_batches(docs.sparkSession)
    measured = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_measured, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    return measured.withColumn("failed_bits", failed_bits())


def mask(policy: tuple[str, int]) -> int:
    return sum(BITS[r] for r in POLICIES[policy])


def passes(policy: tuple[str, int], bits: Column | None = None) -> Column:
    """Whether a ledger row passes a policy."""
    bits = F.col("failed_bits") if bits is None else bits
    return bits.bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(rows: DataFrame, policy: tuple[str, int]) -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it rejects, and that the
    policy without it would keep.

    One bitwise aggregation: rows are counted by their masked bits (at most 2**rules groups,
    combined before the shuffle), and the few groups are then spread over the rules.
    """
    m = mask(policy)
    grouped = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(m).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit")) for r in POLICIES[policy]))).alias("r")
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    rest = F.col("bits").bitwiseAND(F.lit(m).cast("long").bitwiseXOR(F.col("r.bit")))
    return grouped.select("bits", "n", rules).groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit & (rest == 0), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def decisive(policy: tuple[str, int], bits: Column | None = None) -> Column:
    """The rule without which a policy would keep a ledger row that it rejects; null for any other row."""
    own = (F.col("failed_bits") if bits is None else bits).bitwiseAND(F.lit(mask(policy)).cast("long"))
    return F.when(F.bit_count(own) == 1, F.element_at(F.create_map(*(F.lit(x).cast("long") if i % 2 == 0 else F.lit(x) for r in POLICIES[policy] for i, x in enumerate((BITS[r], r)))), own))


def keep(docs: DataFrame, policy: tuple[str, int] = ("web", 2)) -> DataFrame:
    """The rows of ``docs`` that pass a policy, with all their columns.

    Text and verdict travel together through one Arrow pass, so no join is needed and repeated
    rows are each judged on their own.
    """
    small_batches(docs.sparkSession)
    prefix = "__"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    names = [prefix + m for m in MEASURES]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in chunks(batches):
            for m in _measured(iter([batch.select(["doc_id", "text"])])):
                yield pa.RecordBatch.from_arrays([*batch.columns, *m.columns[1:]], [*batch.schema.names, *names])

    ddl = StructType(list(docs.schema))
    for n in names:
        ddl = ddl.add(n, "long")
    return docs.mapInArrow(judged, ddl).where(passes(policy, failed_bits(prefix))).select(*docs.columns)
