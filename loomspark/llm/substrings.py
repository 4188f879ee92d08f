"""Removal of repeated passages by a compacted de Bruijn graph of words (operator 6).

Edges are windows of ``window`` words. A window's anchor is the k-mer in it with the smallest hash
(the first of these), so equal windows have equal anchors at equal places. Consecutive windows of a
document with one anchor are a path, and its key is a hash of all its words; each path knows the
one behind and the one before it. Compaction:

1. paths are dealt by anchor; anchors of one document only are dropped. Of every different path that
   is left, the documents that hold it give the first of them and its degrees: whether one and the
   same path follows it wherever it occurs, and whether one and the same precedes it;
2. repeated paths that are each other's only neighbour are linked, and joins that double their
   reach in every round bring them together to one nonbranching stretch. Wherever its first path
   occurs, all of it occurs, so a stretch has one source: its first document;
3. where different paths share an anchor (a branch), they are taken apart into their windows, which
   are matched one by one;
4. the source of each stretch gives a digest of its words. Each document is read again with the
   stretches and windows that it repeats, compares the words at each place of a stretch with that
   digest, adds what repeats within itself, and drops the covered words.

Stretches and windows are compared with those of smaller doc_ids, windows also with earlier ones of
their own document, always on the input as it was.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import forget, stored
from .bounded import with_lists
from .words import U, Words, chunks, groups, mix, runs_hash

#: Words in an anchor.
ANCHOR = 8


class Graph:
    """Windows and paths of the texts of one chunk."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int):
        self.words, self.window = Words(data, offsets), window
        w = self.words
        self.hash, self.text, self.at = w.windows_at(window)
        span = window - ANCHOR + 1
        anchors = runs_hash(w.hashes, ANCHOR, 7)
        n = max(0, len(anchors) - span + 1)
        low, place = anchors[:n].copy(), np.zeros(n, np.int64)
        for j in range(1, span):
            less = anchors[j : j + n] < low
            low[less], place[less] = anchors[j : j + n][less], j
        self.anchor, place = low[self.at], self.at + place[self.at]
        # a path: consecutive windows of one text with the anchor at one place
        new = np.ones(len(self.at), bool)
        new[1:] = (place[1:] != place[:-1]) | (self.text[1:] != self.text[:-1])
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.append(self.first, len(self.at)))
        self.path_of = np.repeat(np.arange(len(self.first)), self.size)
        # its words are those of its windows, so the sum of their hashes by place tells them apart
        nth = np.arange(len(self.at)) - np.repeat(self.first, self.size)
        part = mix(self.hash + nth.astype(U) * U(0x9E3779B97F4A7C15))
        sums = np.concatenate([[U(0)], np.cumsum(part)])
        self.path = mix(sums[self.first + self.size] - sums[self.first] + self.size.astype(U))
        self.path_anchor, self.path_text = self.anchor[self.first], self.text[self.first]

    def different_paths(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One place of each different path of a text, and the keys of the paths behind and before it;
        0 where there is none, or not one and the same at all its places."""
        n = len(self.path)
        after, before = np.zeros(n, U), np.zeros(n, U)
        same = self.path_text[1:] == self.path_text[:-1]
        after[:-1][same], before[1:][same] = self.path[1:][same], self.path[:-1][same]
        key = _of_text(self.path, self.path_text)
        order = np.argsort(key)
        start = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if n else np.zeros(0, np.int64)
        one = [np.zeros(0, U)] * 2
        if n:
            one = [np.where(np.minimum.reduceat(x, start) == np.maximum.reduceat(x, start), x[start], U(0)) for x in (after[order], before[order])]
        return order[start], *one

    def stretches(self, heads: pa.Array, sizes: pa.Array) -> Iterator[tuple[int, int, int, bytes]]:
        """Every place in these texts of the stretches listed for each text by first path and number
        of paths: the number in the list, the first window and the one behind the last, and the digest
        of the words there."""
        owner, keys, paths = _entries(heads)[0], _entries(heads)[1], _entries(sizes)[1].view(np.int64)
        if not len(keys) or not len(self.path):
            return
        listed = _of_text(keys, owner)
        order = np.argsort(listed)
        found = _of_text(self.path, self.path_text)
        at = np.minimum(np.searchsorted(listed[order], found), len(order) - 1)
        for i in np.flatnonzero(listed[order][at] == found):
            e = int(order[at[i]])
            last = i + int(paths[e]) - 1
            if last < len(self.path) and self.path_text[last] == self.path_text[i]:
                a, b = int(self.first[i]), int(self.first[last] + self.size[last])
                yield e, a, b, hashlib.blake2b(self.spaced[self.spaced_at[self.at[a]] : self.spaced_at[self.at[b - 1] + self.window]], digest_size=16).digest()

    def space(self) -> None:
        """Keep the words of these texts with one space behind each."""
        w = self.words
        self.spaced, stop = spaced(w.data, w.starts, w.ends)
        self.spaced_at = np.append(0, stop)


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words [start, end) in a row with one space behind each, and where each one's space ends."""
    size = ends - starts + 1
    stop = np.cumsum(size)
    source = np.arange(stop[-1] if len(stop) else 0) + np.repeat(starts - (stop - size), size)
    out = np.append(data, np.uint8(32))[np.minimum(source, len(data))]
    out[stop - 1] = 32
    return out, stop


def _of_text(values: np.ndarray, text: np.ndarray) -> np.ndarray:
    return mix(values + text.astype(U) * U(0x9E3779B97F4A7C15))


def _entries(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The text of each entry and the entries of a column of lists; a null is an empty list."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U)


def _ints(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _paths(window: int) -> Callable:
    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches):
            g = Graph(data, offsets, window)
            at, after, before = g.different_paths()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(g.path_text[at])), _ints(g.path_anchor[at]), _ints(g.path[at]), _ints(after), _ints(before)], ["doc_id", "anchor", "path", "after", "before"])

    return paths


def _digests(window: int) -> Callable:
    """The digests of the stretches listed in ``heads`` and ``sizes`` of each document."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches):
            g = Graph(data, offsets, window)
            g.space()
            heads, sizes = batch.column("heads"), batch.column("sizes")
            _, keys = _entries(heads)
            _, n = _entries(sizes)
            got = {e: d for e, _, _, d in g.stretches(heads, sizes)}
            at = np.fromiter(got, np.int64, len(got))
            d = np.frombuffer(b"".join(got.values()), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([_ints(keys[at]), _ints(n[at]), pa.array(d[:, 0]), pa.array(d[:, 1])], ["path", "size", "d1", "d2"])

    return digests


def _windows(window: int) -> Callable:
    """The windows of the paths asked for in ``paths`` of each document."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches):
            g = Graph(data, offsets, window)
            asked = _listed(batch.column("paths"), g.path, g.path_text)[g.path_of]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(g.text[asked])), _ints(g.hash[asked])], ["doc_id", "window"])

    return windows


def _listed(lists: pa.Array, values: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether each value is in the list of its text."""
    owner, keys = _entries(lists)
    have = np.sort(_of_text(keys, owner))
    if not len(have):
        return np.zeros(len(values), bool)
    asked = _of_text(values, text)
    return have[np.minimum(np.searchsorted(have, asked), len(have) - 1)] == asked


def _cleaned(window: int) -> Callable:
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches):
            g = Graph(data, offsets, window)
            w = g.words
            gone = _listed(batch.column("windows"), g.hash, g.text)
            g.space()
            digests = [_entries(batch.column(c))[1].view(np.int64) for c in ("d1", "d2")]
            for e, a, b, digest in g.stretches(batch.column("heads"), batch.column("sizes")):
                if digest == digests[0][e].tobytes() + digests[1][e].tobytes():  # the words are those of the source
                    gone[a:b] = True
            _, once = groups(_of_text(g.hash, g.text))
            gone |= ~once  # it starts earlier in the same document
            depth = np.zeros(len(w.hashes) + window + 1, np.int64)
            np.add.at(depth, g.at[gone], 1)
            np.add.at(depth, g.at[gone] + window, -1)
            keep = np.cumsum(depth)[: len(w.hashes)] == 0
            starts, ends, text = w.starts[keep], w.ends[keep], w.text_of_word()[keep]
            # kept words with a space behind each; the last one of a text is cut off
            size = ends - starts + 1
            out, stop = spaced(data, starts, ends)
            last = np.ones(len(text), bool)
            last[:-1] = text[1:] != text[:-1]
            if len(stop):
                out = np.delete(out, stop[last] - 1)
            kept = np.bincount(text, minlength=len(w.counts))
            length = np.bincount(text, weights=size, minlength=len(w.counts)).astype(np.int64) - (kept > 0)
            cuts = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
            blob = pa.Array.from_buffers(pa.large_utf8(), len(length), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(out))]).cast(pa.utf8())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(w.counts), pa.array(w.counts - kept), blob], ["doc_id", "n_words", "n_removed", "text"])

    return clean


def _stretches(units: DataFrame) -> DataFrame:
    """Maximal nonbranching stretches of the repeated paths in ``units`` (path, first, last, after and
    before as a single neighbour or 0): path (the first one), first and size (in paths).

    A path that is always followed by one that it always precedes has the same documents as that one.
    A round follows each path's pointer twice as far; what has reached the end of its stretch leaves the
    join's left side, so there are as many rounds as the longest stretch has binary digits. A
    stretch cannot be a circle, since documents end."""
    repeated = units.where("first <> last")
    ends = repeated.where("before <> 0").select(F.col("path").alias("after"), F.col("before").alias("from_path"))
    linked = repeated.where("after <> 0").select("path", "after").join(ends, "after").where("path = from_path").select("path", F.col("after").alias("to"))
    links = stored(linked, "links")
    reach = stored(repeated.select("path").join(links, "path", "left").select("path", "to", F.col("to").isNotNull().cast("long").alias("hops")), "reach")
    while not reach.where("to IS NOT NULL").isEmpty():
        beyond = reach.select(F.col("path").alias("to"), F.col("to").alias("next"), F.col("hops").alias("more"))
        moved = reach.where("to IS NOT NULL").join(beyond, "to").select("path", F.col("next").alias("to"), (F.col("hops") + F.col("more")).alias("hops"))
        after = stored(moved.union(reach.where("to IS NULL")), "reach")
        forget(reach)
        reach = after
    heads = repeated.select("path", "first").join(links.select(F.col("to").alias("path")), "path", "left_anti")
    out = stored(heads.join(reach, "path").select("path", "first", (F.col("hops") + 1).alias("size")), "stretches")
    forget(links, reach)
    return out


def dedup(docs: DataFrame, *, window: int = 20) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, and ``text``, its kept
    words joined by single spaces.

    A word goes if a window of ``window`` words that covers it also starts at an earlier place: in
    a document with a smaller doc_id, or earlier in the same one. A null text has no words.
    Rows that share a doc_id are each judged against smaller doc_ids and themselves, not against
    each other; rows with a null doc_id only against themselves. Other columns are ignored; an empty table gives no
    rows.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    paths = rows.where("doc_id IS NOT NULL").mapInArrow(_paths(window), "doc_id long, anchor long, path long, after long, before long")
    anchors = paths.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("path").alias("p1"), F.max("path").alias("p2"))
    shared = anchors.where("first <> last").select("anchor", (F.col("p1") != F.col("p2")).alias("branch"))
    met = stored(paths.join(shared, "anchor"), "paths")
    # different paths: their first document and their only neighbours
    only = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.lit(0)).alias(c)
    units = stored(met.groupBy("path").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max("branch").alias("branch"), only("after"), only("before")), "units")
    stretches = _stretches(units)
    sources = stretches.groupBy(F.col("first").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("path", "size"))).alias("s"))
    sources = stored(sources.select("doc_id", F.col("s.path").alias("heads"), F.col("s.size").alias("sizes")), "sources")
    digests = with_lists(rows, sources, inner=True).mapInArrow(_digests(window), "path long, size long, d1 long, d2 long")
    digests = stored(digests.join(stretches.select("path", "first"), "path").distinct(), "digests")
    repeats = met.select("doc_id", "path").join(digests, "path").where("doc_id > first").groupBy("doc_id")
    repeats = repeats.agg(F.sort_array(F.collect_set(F.struct("path", "size", "d1", "d2"))).alias("s"))
    by_stretch = repeats.select("doc_id", F.col("s.path").alias("heads"), F.col("s.size").alias("sizes"), F.col("s.d1").alias("d1"), F.col("s.d2").alias("d2"))
    # the different paths at branches, window by window
    asked = stored(units.where("branch").groupBy(F.col("first").alias("doc_id")).agg(F.collect_set("path").alias("paths")), "asked")
    windows = stored(with_lists(rows, asked, inner=True).mapInArrow(_windows(window), "doc_id long, window long").distinct(), "windows")
    firsts = windows.groupBy("window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last").select("window", "first")
    by_window = windows.join(firsts, "window").where("doc_id > first").groupBy("doc_id").agg(F.collect_set("window").alias("windows"))
    known = stored(by_stretch.join(by_window, "doc_id", "full"), "known")
    forget(met, units, stretches, sources, digests, asked, windows)
    return with_lists(rows, known).mapInArrow(_cleaned(window), "doc_id long, n_words long, n_removed long, text string")
