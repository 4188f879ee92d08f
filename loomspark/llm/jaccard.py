"""Exact Jaccard self-join on word shingles with token-combination prefixes (operator 4).

A document's tokens are its distinct shingles, in one order that all documents share: the frequent
ones last. Two sets with similarity t or more have a common token among the first
``n - ceil(t * n) + 1`` of each, and k common tokens among the first k - 1 more of each. So

1. documents with equal sets become one class, which one of their rows stands for;
2. of two similar sets the smaller one shares tokens of a still shorter prefix, so a token counts only if
   it is in such a prefix of one set and in a prefix of another. Prefixes are grouped by token, and each member is verified against the one of its group that
   has the fewest rare tokens; that links most members of a group of near copies by one pair each;
3. only groups that still hold several components go on. There a rare token is a key by itself,
   and frequent tokens are keys by twos (or one by one, for sets with very many of them), and every
   pair of members of different components that meets under a key is verified.

Pairs whose sizes or marks (a bit for each class of tokens, 512 and then 4,096 of them) rule similarity out are not verified, which loses none. Every
verification is exact, on the whole texts. No pair is capped or sampled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import forget, small_batches, stored
from .bounded import few
from .graph import components
from .words import U, Words, by_text, chunks, mix

#: Text, in bytes, in which a token must be in several sets to be reported as common.
BLOCK = 8 << 20
#: Common tokens kept for the order. More would only order better; 8 bytes each are broadcast.
COMMON = 500_000
#: A group of more members has a frequent token.
FREQUENT = 48
#: A set with more frequent tokens in its prefix indexes them one by one.
WIDE = 24
#: Bits of the marks that pairs are compared by where they meet, and before they are verified.
MARKS, WIDE_MARKS = 512, 4096
#: Pairs of one set that are verified under one key.
PARTNERS = 256
#: So many tokens before a token that is a key by itself are compared to leave a pair to an earlier key.
NEAR = 8


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted within it, and the n + 1 offsets."""
    w = Words(data, offsets, lower=True)
    h, text = w.windows(k)
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):  # the whole sequence is the one shingle
        whole = _sequences(w, short, k)
        h, text = np.concatenate([h, whole]), np.concatenate([text, short])
    order = by_text(np.argsort(h), text)
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(w.counts) + 1))


def _sequences(w: Words, texts: np.ndarray, k: int) -> np.ndarray:
    """A hash of all words of each of ``texts``, which have fewer than k."""
    h = w.counts[texts].astype(U)
    for j in range(k - 1):
        more = np.flatnonzero(w.counts[texts] > j)
        h[more] = mix(h[more] * U(0x9FB21C651E98DF25) + w.hashes[w.first[texts[more]] + j])
    return h


def _common(k: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(kept), return_counts=True)
            often = n >= 3
            return pa.RecordBatch.from_arrays([pa.array(token[often].view(np.int64)), pa.array(n[often])], ["token", "n"])

        for _, data, offsets in chunks(batches):
            kept.append(shingle_sets(data, offsets, k)[0])
            size += len(data)
            if size >= BLOCK:
                yield out()
                kept, size = [], 0
        if kept:
            yield out()

    return count


def common_tokens(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that several sets of one block share, sorted, and the logarithm of their counts.

    They only decide the order of tokens, so their number may be bounded: of the powers of two
    of the counts, the highest ones with ``COMMON`` tokens at most are kept.
    """
    counts = stored(docs.select("text").mapInArrow(_common(k), "token long, n long").groupBy("token").agg(F.floor(F.log2(F.sum("n"))).cast("int").alias("level")), "common")
    total, least = 0, 64
    for r in counts.groupBy("level").count().orderBy(F.desc("level")).collect():  # one row for each power of two
        if total + r["count"] > COMMON:
            break
        total, least = total + r["count"], r["level"]
    table = counts.where(F.col("level") >= least).toArrow()
    token = table.column("token").to_numpy().view(U)
    order = np.argsort(token)
    return token[order], table.column("level").to_numpy()[order].astype(np.uint8)


def _parity(h: np.ndarray, text: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A bit for each of ``bits`` classes of tokens, for each of n texts: whether it has an odd number of them."""
    bit = text * bits + (mix(h ^ U(0x3C79AC492BA7B653)) % U(bits)).astype(np.int64)
    out = np.zeros(n * bits // 8, np.uint8)
    np.bitwise_xor.at(out, bit >> 3, np.uint8(1) << (bit & 7).astype(np.uint8))
    return out.view(np.int64).reshape(n, bits // 64)


def _fixed(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.int64()))


def _sets(k: int, percent: int, common) -> Callable:
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, level = common.value
        for batch, data, offsets in chunks(batches):
            h, at = shingle_sets(data, offsets, k)
            n = np.diff(at)
            text = np.repeat(np.arange(len(n)), n)
            rank = np.zeros(len(h), U)
            if len(known):
                place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                rank = np.where(known[place] == h, level[place], 0).astype(U)
            order = np.argsort(h)
            order = by_text(order[np.argsort(rank[order].astype(np.uint8), kind="stable")], text)
            rare = n - np.bincount(text[rank > 0], minlength=len(n))
            # one token more than the prefix, for combinations of two
            size = np.where(n > 0, np.minimum(n - (-(-percent * n // 100)) + 2, n), 0)
            nth = np.arange(len(h)) - np.repeat(at[:-1], n)
            prefix = h[order][nth < np.repeat(size, n)].view(np.int64)
            sums = [np.concatenate([[U(0)], np.cumsum(mix(h ^ U(c)))]) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
            marks, wide = (_parity(h, text, len(n), bits) for bits in (MARKS, WIDE_MARKS))
            digest = [(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums]
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(prefix)), _fixed(marks), _fixed(wide)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), pa.array(n), pa.array(rare), *map(pa.array, digest), *lists], ["doc_id", "version", "n", "rare", "d1", "d2", "prefix", "marks", "wide"])

    return describe


def _similar(k: int, percent: int) -> Callable:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, da, oa in chunks(batches, "ta"):
            for part, db, ob in chunks(iter([batch]), "tb"):
                ha, aa = shingle_sets(*_slice(da, oa, batch, part), k)
                hb, ab = shingle_sets(db, ob, k)
                m = part.num_rows
                key = lambda h, at: mix(h + np.repeat(np.arange(m), np.diff(at)).astype(U) * U(0x9E3779B97F4A7C15))
                ka, kb = key(ha, aa), np.sort(key(hb, ab))
                place = np.minimum(np.searchsorted(kb, ka), max(0, len(kb) - 1))
                same = (kb[place] == ka) if len(kb) else np.zeros(len(ka), bool)
                both = np.diff(np.concatenate([[0], np.cumsum(same)])[aa])
                union = np.diff(aa) + np.diff(ab) - both
                keep = pa.array((both > 0) & (100 * both >= percent * union))
                yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], ["a", "b"])

    return verify


def _slice(data: np.ndarray, offsets: np.ndarray, batch: pa.RecordBatch, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    at = part.column("a").offset - batch.column("a").offset
    o = offsets[at : at + part.num_rows + 1]
    return data[o[0] : o[-1]], o - o[0]


def _version() -> Column:
    return F.xxhash64("text").alias("version")  # tells texts of one doc_id apart


def verified(docs: DataFrame, who: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of sets whose whole texts are similar; ``who`` says where a set's text is
    (id, doc_id, version). b may be in very many pairs, so these are dealt by b and a part of it."""
    who = few(who)
    texts = docs.select("doc_id", _version(), "text")
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))

    def with_text(ids: DataFrame, name: str) -> DataFrame:
        asked = few(ids.join(who, "id").withColumnsRenamed({"doc_id": "own", "version": "own_version"}), width=8)
        return texts.join(asked, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("version") == F.col("own_version"))).drop("doc_id", "version", "own", "own_version").withColumnRenamed("text", name)

    many = with_text(pairs.join(parts, "b").select(F.col("a").alias("id"), "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part")), "ta").withColumnRenamed("id", "a")
    one = with_text(parts.withColumnRenamed("b", "id"), "tb").dropDuplicates(["id"])
    one = stored(one.select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "tb"), "texts")
    links = stored(many.join(one, ["b", "part"]).select("a", "b", "ta", "tb").mapInArrow(_similar(k, percent), "a long, b long").distinct(), "links")
    forget(one)
    return links


def _twos(tokens: Column) -> Column:
    """All combinations of two elements of a sorted array: their key, and the other elements
    before the second of them."""

    def with_(x: Column, i: Column) -> Column:
        def two(y: Column, j: Column) -> Column:
            before = F.array_remove(F.slice(tokens, F.lit(1), i + j + 1), x)
            return F.struct(F.concat_ws(",", x.cast("string"), y.cast("string")).alias("key"), before.alias("before"))

        return F.transform(F.slice(tokens, i + 2, F.size(tokens)), two)

    return F.flatten(F.transform(tokens, with_))


def _may(x: str, y: str, percent: int) -> Column:
    """Whether two sets can be similar, from sizes and marks: similar sets differ in at most
    (1 - t) / (1 + t) of their tokens, and marks in no more bits than sets in tokens."""
    nx, ny, mx, my = F.col(f"n{x}"), F.col(f"n{y}"), F.col(f"m{x}"), F.col(f"m{y}")
    bits = sum((F.bit_count(mx[i].bitwiseXOR(my[i])) for i in range(MARKS // 64)), F.lit(0))
    return (F.lit(100) * F.least(nx, ny) >= F.lit(percent) * F.greatest(nx, ny)) & (F.lit(100 + percent) * bits <= F.lit(100 - percent) * (nx + ny))


def _by_wide_marks(pairs: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may be similar by their wide marks."""
    ids = few(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    wide = stored(first.select("id", "n", "wide").join(ids, "id", "left_semi"), "wide")
    x, y = wide.toDF("a", "na", "wa"), wide.toDF("b", "nb", "wb")
    bits = F.aggregate(F.zip_with("wa", "wb", lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, v: s + v)
    out = stored(pairs.join(x, "a").join(y, "b").where(F.lit(100 + percent) * bits <= F.lit(100 - percent) * (F.col("na") + F.col("nb"))).select("a", "b"), "pairs")
    forget(wide, ids)
    return out


def _needed(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` (token, pos, n, ...) whose place is among those where the first two tokens that
    the set shares with a similar one of the same group can be.

    Sizes are put into classes a little wider than similarity spans, so that a similar set which
    is smaller is in the class of a set or the one below; the smallest size there is the bound.
    """
    classed = rows.withColumn("b", F.floor(F.log("n") / F.log(F.lit(100.1 / percent))))
    least = classed.groupBy("token", "b").agg(F.min("n").alias("least"))
    least = least.union(least.withColumn("b", F.col("b") + 1)).groupBy("token", "b").agg(F.min("least").alias("least"))
    smallest = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100))
    common = F.ceil((F.col("n") + smallest) * percent / (100 + percent))
    return classed.join(least, ["token", "b"]).where(F.col("pos") < F.col("n") - common + 2).drop("b", "least")


def _rest(members: DataFrame, labels: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs that meet under a key, are in different components so far, and may be similar."""
    lab = members.join(labels, "id", "left").withColumn("c", F.coalesce("component", F.col("id"))).select("token", "pos", "id", "n", "c")
    mixed_ = lab.groupBy("token").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count("*").alias("size")).where("c1 <> c2")
    rows = _needed(lab.join(mixed_.select("token", "size"), "token"), percent)
    rows = stored(rows.join(sketches.select("id", "m"), "id"), "mixed")
    own = ["id", "n", "m", "c"]
    single = rows.where(F.col("size") <= FREQUENT).select(F.col("token").cast("string").alias("key"), *own, F.lit(False).alias("wide"), F.array().cast("array<long>").alias("before"))
    often = rows.where(F.col("size") > FREQUENT).groupBy(*own).agg(F.sort_array(F.collect_set("token")).alias("tokens"))
    wide = often.withColumn("wide", F.size("tokens") > WIDE)
    alone = wide.select("tokens", F.posexplode("tokens").alias("at", "token"), *own, "wide")
    before = F.slice("tokens", F.greatest(F.lit(1), F.col("at") + 1 - NEAR), F.least(F.col("at"), F.lit(NEAR)))
    alone = alone.select(F.col("token").cast("string").alias("key"), *own, "wide", before.alias("before"))
    twos = wide.where("NOT wide").select(F.explode(_twos(F.col("tokens"))).alias("two"), *own, "wide").select("two.key", *own, "wide", "two.before")
    return _meet(single, percent).union(_meet(twos, percent)).union(_meet(alone, percent, wide=True)).distinct()


def _meet(keyed: DataFrame, percent: int, *, wide: bool = False) -> DataFrame:
    """Pairs of different components under one key. One of the two is outside the key's smallest
    component, so that a group that is nearly one component makes few pairs.

    Two sets that also share a token ``before`` those of the key meet under a key with it as well,
    so they are left to that one: a pair comes from its first common key, not from each of them.
    """
    first = keyed.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2")
    rows = keyed.join(first.select("key", "c1"), "key")
    own = ("id", "n", "m", "c", "wide", "before")
    x = rows.where("c <> c1").select("key", *(F.col(c).alias(f"{c}x") for c in own))
    y = rows.select("key", "c1", *(F.col(c).alias(f"{c}y") for c in own))
    # of two outside that component the one with the smaller id is x
    once = (F.col("cy") == F.col("c1")) | (F.col("idx") < F.col("idy"))
    met = x.join(y, "key").where((F.col("cx") != F.col("cy")) & once & _may("x", "y", percent) & ~F.arrays_overlap("beforex", "beforey"))
    if wide:
        met = met.where("widex OR widey")
    return met.select(F.least("idx", "idy").alias("a"), F.greatest("idx", "idy").alias("b")).distinct()


def join(docs: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a set is the distinct k-word shingles, or
    the whole sequence if it has fewer words. Sets link if 100 * common >= percent * all.
    component_id is the smallest doc_id reachable by links. Null and wordless texts have no
    shingle and link with nothing. Rows that share a doc_id are one node, linked by any of their
    texts; a row with a null doc_id links by its text, and its component_id is null if nothing that it
    reaches has a doc_id. Other columns are ignored; an empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    common = spark.sparkContext.broadcast(common_tokens(rows, k))
    found = rows.select("doc_id", "text", _version()).mapInArrow(_sets(k, percent, common), "doc_id long, version long, n long, rare long, d1 long, d2 long, prefix array<long>, marks array<long>, wide array<long>")
    sets = stored(found.withColumn("id", F.monotonically_increasing_id()), "sets")
    worded = sets.where("n > 0")
    # copies are combined before the shuffle; one of them keeps its prefix
    classes = stored(worded.groupBy("d1", "d2", "n").agg(F.min("id").alias("id"), F.min("doc_id").alias("least")), "classes")
    first = worded.join(few(classes.select("id")), "id", "left_semi")
    sketches = few(first.select("id", "doc_id", "version", "n", "rare", F.col("marks").alias("m")), width=88)
    who = sketches.select("id", "doc_id", "version")
    # a token is dealt once for both of its uses; places where only a larger set needs it are negative
    own = F.col("pos") < F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent)) + 2
    extended = first.select(F.posexplode("prefix").alias("pos", "token"), "id", "n").select("token", F.when(own, F.col("pos")).otherwise(-1 - F.col("pos")).alias("place"), "id").repartition("token")
    groups = extended.groupBy("token").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.max("place").alias("place")).where("a <> z AND place >= 0").select("token")
    met = extended.join(groups.hint("shuffle_hash"), "token").join(sketches.select("id", "n", "rare"), "id")
    members = stored(met.select("token", F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("pos"), "id", "n", "rare"), "members")
    # the member with the fewest rare tokens is the one that copies differ from least
    leads = members.groupBy("token").agg(F.min(F.struct((F.col("rare") / F.col("n")).alias("share"), "id")).alias("lead")).select("token", F.col("lead.id").alias("idy"))
    stars = members.select("token", F.col("id").alias("idx")).join(leads, "token").where("idx <> idy").select("idx", "idy").distinct()
    side = lambda s: sketches.select(F.col("id").alias(f"id{s}"), F.col("n").alias(f"n{s}"), F.col("m").alias(f"m{s}"))
    stars = stars.join(side("x"), "idx").join(side("y"), "idy").where(_may("x", "y", percent)).select(F.col("idx").alias("a"), F.col("idy").alias("b"))
    stars = stored(stars.distinct(), "stars")
    links = verified(rows, who, stars, k, percent).union(_same_document(sets, classes))
    labels = stored(components(links).toDF("id", "component"), "labels")
    rest = _rest(members.select("token", "pos", "id", "n"), labels, sketches.select("id", "m"), percent)
    both = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = stored(rest.join(both, ["a", "b"], "left_anti"), "rest")
    forget(members, stars)
    if not rest.isEmpty():
        rest = _by_wide_marks(rest, first, percent)
        labels = stored(components(links.union(verified(rows, who, rest, k, percent))).toDF("id", "component"), "labels")
    least = labels.join(classes.select("id", "least"), "id").groupBy("component").agg(F.min("least").alias("reached"))
    by_set = classes.join(labels, "id", "left").join(least, "component", "left").select("d1", "d2", "n", F.coalesce("reached", "least").alias("component_id"))
    light = sets.select("doc_id", "n", "d1", "d2")
    return light.join(stored(by_set, "found"), ["d1", "d2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _same_document(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Links of the different sets of rows that share a doc_id."""
    worded = sets.where("n > 0 AND doc_id IS NOT NULL")
    several = worded.groupBy("doc_id").agg(F.min("d1").alias("a"), F.max("d1").alias("z")).where("a <> z").select("doc_id")
    of = stored(worded.join(several, "doc_id").select("doc_id", "d1", "d2", "n").join(classes, ["d1", "d2", "n"]).select("doc_id", "id"), "repeated")
    return of.join(of.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").where("a <> id").select("a", F.col("id").alias("b")).distinct()


def keep_first(docs: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose doc_id is its own component_id, with all their columns; of rows
    that share a doc_id one stays. Rows with a null doc_id stay."""
    found = stored(join(docs, k=k, percent=percent), "found")
    copies = few(found.where("component_id <> doc_id").select("doc_id").distinct())
    kept = docs.join(copies, "doc_id", "left_anti")
    if found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    return kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id IS NULL"))
