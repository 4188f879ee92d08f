"""Search for benchmark passages in documents by Wu-Manber multi-pattern matching (operator 13).

Test strings are all windows of some words of the benchmark's items, and the whole of an item that has fewer.
The symbols of the search are words. For the strings of one length m, a shift table has for each block of B
words how far a text may be skipped if that block ends at the place looked at: m - B + 1 where no
string has it, and less the nearer a string's end it is. Where the shift is 0 the block may end a string; the
strings with that block as suffix form a bucket, in which those with the hash of all words of the
place are compared word by word.

The strings are dealt to slices of a bounded number of words, each of which is a few array files in the shared
folder. A task takes the slices one after the other over each part of its texts. So neither
the benchmark nor a slice passes through the driver, and documents are neither shuffled nor joined.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch, stored
from .embedding_dedup import _get, _put
from .words import LOWER, U, blocks, mix, runs_hash, spans_hash, utf8

#: Words of a test string, and of a block of the shift table.
WINDOW, BLOCK = 10, 3
#: Words of a piece of an item, and of a slice.
PIECE, SLICE_WORDS = 1 << 12, 1 << 20
#: Bytes of text that are searched at once. A longer text is searched in parts.
CHUNK = 1 << 21
#: Places of a text that one head of the search goes over.
STRIDE = 64
#: Slices that a worker holds.
HELD = 4

#: Bytes of words once A-Z are lower case: digits, letters, and all that is not ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


class Text:
    """The words of some texts. Words ``first[i]`` up to ``first[i + 1]`` are those of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = LOWER[data]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = WORD[self.data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        self.starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        self.ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = spans_hash(self.data, self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.starts)


def _keys(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` words that end at each place."""
    key = hashes[at]
    for j in range(1, size):
        key = mix(key * U(0x9FB21C651E98DF25) + hashes[at - j])
    return key


def _same(x: Text, a: np.ndarray, y: Text, b: np.ndarray, m: int) -> np.ndarray:
    """Whether the m words from each place a of x equal those from place b of y, byte by byte."""
    a, b = (a[:, None] + np.arange(m)).ravel(), (b[:, None] + np.arange(m)).ravel()
    size = x.ends[a] - x.starts[a]
    equal = size == y.ends[b] - y.starts[b]
    a, b, at = a[equal], b[equal], np.flatnonzero(equal)
    if len(at):
        left, _, first = blocks(x.data, x.starts[a], x.ends[a])
        right, _, _ = blocks(y.data, y.starts[b], y.ends[b])
        equal[at] = np.logical_and.reduceat(left == right, first)
    return equal.reshape(-1, m).all(1)


def _tables(text: Text, at: np.ndarray, m: int, items: np.ndarray) -> dict[str, np.ndarray]:
    """The shift table and the buckets of the test strings of m words that start at the places ``at``.

    Equal strings are one, with a list of their items; a bucket is sorted by the hashes of whole strings."""
    block = min(BLOCK, m)
    bits = max(10, int(len(at) * (m - block + 1)).bit_length() + 1)
    shift = np.full(1 << bits, m - block + 1, np.uint8)
    for end in range(block - 1, m):
        np.minimum.at(shift, (_keys(text.hashes, at + end, block) >> U(64 - bits)).astype(np.int64), m - 1 - end)
    suffix, whole = _keys(text.hashes, at + m - 1, block), runs_hash(text.hashes, m)[at]
    order = np.lexsort((at, whole, suffix))
    at, suffix, whole = at[order], suffix[order], whole[order]
    new = np.append(True, (suffix[1:] != suffix[:-1]) | (whole[1:] != whole[:-1]))
    leader = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
    new |= ~_same(text, at, text, leader, m)  # other words under one hash are strings of their own
    owners = np.unique(np.stack([np.cumsum(new) - 1, items[at]]), axis=1)
    return {"shift": shift, "suffix": suffix[new], "whole": whole[new], "at": at[new], "of": np.searchsorted(owners[0], np.arange(int(new.sum()) + 1)), "owner": owners[1]}


def _build(folder: str, window: int) -> Callable:
    """Pieces (slice, item, size, text) of one slice as array files: the words, whose they are, and the tables."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by([("item", "ascending"), ("text", "ascending")])
        put = _put(f"{folder}/{table.column('slice')[0].as_py()}")
        data, offsets = utf8(table.column("text").combine_chunks())
        text = Text(data, offsets)
        names = table.column("item").combine_chunks().dictionary_encode()
        blob, ends = utf8(names.dictionary)
        counts = np.diff(text.first)
        items = np.repeat(names.indices.to_numpy(), counts)
        for name, values in (("data", text.data), ("starts", text.starts), ("ends", text.ends), ("names", blob), ("name_ends", ends)):
            put(name, values)
        of = np.repeat(np.arange(len(counts)), counts)
        left = text.first[1:][of] - np.arange(len(text))  # words from here to the end of the piece
        lengths = []
        for m in range(1, window + 1):
            at = np.flatnonzero(left >= m if m == window else (counts[of] == m) & (left == m))
            if len(at):
                lengths.append(m)
                for name, values in _tables(text, at, m, items).items():
                    put(f"{name}{m}", values)
        put("lengths", np.array(lengths))
        return pa.table({"slice": table.column("slice")[:1]})

    return build


class Slice(Text):
    """Test strings that were written by ``_build``."""

    def __init__(self, folder: str):
        get = _get(folder)
        self.data, self.starts, self.ends = (np.asarray(get(x)) for x in ("data", "starts", "ends"))
        blob, ends = get("names").tobytes(), get("name_ends")
        self.names = [blob[a:b].decode() for a, b in zip(ends[:-1], ends[1:])]
        self.tables = {int(m): {x: np.asarray(get(f"{x}{m}")) for x in ("shift", "suffix", "whole", "at", "of", "owner")} for m in get("lengths")}

    def places(self, text: Text, m: int) -> np.ndarray:
        """The last words of all places where a string of m words may end, by shifts. Each head goes over
        ``STRIDE`` places of one text."""
        shift, block = self.tables[m]["shift"], min(BLOCK, m)
        move = U(64 - (len(shift).bit_length() - 1))
        count = np.maximum(np.diff(text.first) - m + 1, 0)
        heads = -(-count // STRIDE)
        nth = np.arange(int(heads.sum())) - np.repeat(np.cumsum(heads) - heads, heads)
        at = np.repeat(text.first[:-1], heads) + m - 1 + nth * STRIDE
        stop = np.minimum(at + STRIDE, np.repeat(text.first[1:], heads))
        found = [np.zeros(0, np.int64)]
        while len(at):
            skip = shift[(_keys(text.hashes, at, block) >> move).astype(np.int64)]
            found.append(at[skip == 0])
            at = at + np.maximum(skip, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        return np.concatenate(found)

    def found(self, text: Text) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length m, the first words of occurrences and the string that occurs there."""
        for m, table in self.tables.items():
            end = self.places(text, m)
            suffix = _keys(text.hashes, end, min(BLOCK, m))
            low, high = np.searchsorted(table["suffix"], suffix), np.searchsorted(table["suffix"], suffix, "right")
            at, low, high = end[high > low] - (m - 1), low[high > low], high[high > low]
            whole = runs_hash_at(text.hashes, at, m)
            string = _lower_bound(table["whole"], low, high, whole)
            while len(at):  # more than once only where strings share a hash
                on = string < high
                on[on] = table["whole"][string[on]] == whole[on]
                at, string, high, whole = at[on], string[on], high[on], whole[on]
                equal = _same(text, at, self, table["at"][string], m)
                yield m, at[equal], string[equal]
                string = string + 1

    def owners(self, m: int, text: np.ndarray, string: np.ndarray) -> Iterator[tuple[int, str]]:
        """Each text with the names of the items of its strings."""
        table = self.tables[m]
        text, string = np.unique(np.stack([text, string]), axis=1)
        for t, s in zip(text.tolist(), string.tolist()):
            for o in table["owner"][table["of"][s] : table["of"][s + 1]].tolist():
                yield t, self.names[o]


def _lower_bound(values: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The first place from low below high, where ``values`` are sorted, of a value that isn't below the one wanted."""
    low, high = low.copy(), high.copy()
    while (on := low < high).any():
        middle = (low + high) >> 1
        less = on & (values[np.minimum(middle, len(values) - 1)] < wanted)
        low[less] = middle[less] + 1
        high[on & ~less] = middle[on & ~less]
    return low


def runs_hash_at(hashes: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """``runs_hash`` of the m words from each place."""
    near = (at[:, None] + np.arange(m)).ravel()
    # runs of m among the m words of a place: each m-th is the place's own
    return runs_hash(hashes[near], m)[::m]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, bool]]:
    """Texts up to ``CHUNK`` bytes at once as (doc_ids, bytes, offsets, whether more of the last text follows).
    A longer text is cut between words."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
            ids, start, end = batch.column("doc_id").slice(at, to - at), int(offsets[at]), int(offsets[to])
            while end - start > CHUNK:  # one text
                cut = start + CHUNK
                while cut < end and WORD[LOWER[data[cut]]]:
                    cut += 1
                yield ids, data[start:cut], np.array([0, cut - start]), cut < end
                start = cut
            if start < end or start == offsets[at]:
                yield ids, data[start:end], np.append(0, offsets[at + 1 : to + 1] - start), False
            at = to


def _search(folder: str, slices: list[int], window: int) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Slice] = {}

        def slice_(i: int) -> Slice:
            if i not in held:
                if len(held) >= HELD:
                    del held[next(iter(held))]
                held[i] = Slice(f"{folder}/{i}")
            return held[i]

        tail, was_hit, words, spans, names = b"", np.zeros(0, bool), 0, [], set()  # of a text that goes on
        for ids, data, offsets, more in _parts(batches):
            data, offsets = np.concatenate([np.frombuffer(tail, np.uint8), data]), np.append(0, offsets[1:] + len(tail))
            text = Text(data, offsets)
            cover, items = np.zeros(len(text) + 1, np.int64), defaultdict(set, {0: names})
            for i in slices:
                strings = slice_(i)
                for m, at, string in strings.found(text):
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + m, -1)
                    for t, name in strings.owners(m, np.searchsorted(text.first, at, "right") - 1, string):
                        items[t].add(name)
            hit = np.cumsum(cover[:-1]) > 0
            hit[: len(was_hit)] |= was_hit
            counts, found, before = np.diff(text.first), [[]] * len(ids), words - len(was_hit)
            counts[0] += before  # the words of earlier parts, but for those that are seen again
            for t in {0, *items}:
                a, b = int(text.first[t]), int(text.first[t + 1])
                shown = b - min(window - 1, b - a) if more else b  # what follows may hit the last words
                edge = np.diff(np.concatenate([[False], hit[a:shown], [False]]).astype(np.int8))
                skip = before if t == 0 else 0
                own = [(int(x) + skip, int(y - x)) for x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
                found[t] = own if t else _joined(spans, own)
            if more:
                keep = min(window - 1, len(text))
                words, was_hit, spans, names = int(counts[0]), hit[len(text) - keep :], found[0], items[0]
                tail = data[text.starts[len(text) - keep] :].tobytes() if keep else b""
            else:
                yield _out(ids, counts, found, [sorted(items[t]) if t in items else [] for t in range(len(ids))])
                tail, was_hit, words, spans, names = b"", np.zeros(0, bool), 0, [], set()

    return search


def _joined(spans: list, more: list) -> list:
    if spans and more and sum(spans[-1]) == more[0][0]:
        return [*spans[:-1], [spans[-1][0], spans[-1][1] + more[0][1]], *more[1:]]
    return spans + more


def _out(ids: pa.Array, counts: np.ndarray, spans: list, items: list) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    spans = [[{"start": a, "length": b} for a, b in s] for s in spans]
    return pa.RecordBatch.from_arrays([ids, pa.array(counts), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], ["doc_id", "n_words", "hits", "items"])


def pieces(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, size, text) of ``benchmark`` (item_id, text, ...), whose long texts are cut into pieces of ``size`` words that
    share all but one of a window's words, so that each window is in one piece."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), F.lit(0))
    own = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - window + 1), F.lit(PIECE - window + 1))
    cut = own.select("item", F.explode(F.transform(starts, lambda s: F.slice("words", s, PIECE))).alias("words"))
    return cut.select("item", F.size("words").alias("size"), F.array_join("words", " ").alias("text")).distinct()


def search(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """For each row of ``docs`` (doc_id, text, ...): doc_id, n_words, ``hits`` (start and length, in words, of the spans
    that occurrences of test strings cover) and ``items`` (those with strings that occur, as sorted strings).

    A-Z are lower-cased; words are runs of digits, letters a-z and what is not ASCII. A test string is each window of
    ``window`` consecutive words of a text of ``benchmark`` (item_id, text, ...), or all words of one that has fewer;
    a text without words gives none. Rows that share an item_id are one item, and a null item_id is the item ''.
    A null or empty text has no words, repeated rows of documents are each searched, doc_id may be null, and
    other columns are not read. No documents give no rows; an empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "strings")
    cut = stored(pieces(benchmark, window), "pieces")
    n_slices = max(1, -(-(cut.agg(F.sum("size")).first()[0] or 0) // SLICE_WORDS))
    dealt = cut.withColumn("slice", F.pmod(F.xxhash64("item", "text"), F.lit(n_slices)).cast("int"))
    built = stored(dealt.groupBy("slice").applyInArrow(_build(folder, window), "slice int"), "slices")
    slices = sorted(r.slice for r in built.collect())  # a number for each slice
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_search(folder, slices, window), f"doc_id {kind}, n_words long, hits array<struct<start: long, length: long>>, items array<string>")
