"""Prefix trie of conversations by fixed-length block hashing (operator 11).

A conversation is cut into blocks of a few turns, and each block is known by a 128-bit digest of all
turns up to its end. So

1. conversations are grouped by these digests for all blocks at once: conversations in a group agree up
   to the block's end, and one of them stands for all (a *kind* of block);
2. a block that all continuations of its parent share has one member set at every turn in it, so its
   turns become nodes as they are. Only where several kinds follow one parent, that is where siblings
   diverge, the turns of the kinds (not of the conversations) are grouped one by one.

Sums over a subtree need no walk up the tree. Along a path the smallest member only rises, so each node
belongs to one conversation, which owns the end of its path from some depth on. A sum over the nodes below
v is the sum over v's members of what they own, but for the smallest member, which counts from v on.

The digest of a prefix is the exclusive or of hashes of (depth, turn), so that a long conversation is put
together from slices and no task needs all of its turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.keys import part_of, place_in_part
from ..session import forget, stored
from .bounded import few

#: Turns of a block.
BLOCK = 4
#: Blocks of a conversation whose digests are summed in one group.
SLICE = 1024
#: Bytes of joined ids that are handed on at once.
IDS_BYTES = 1 << 16

_KEY = ["depth", "d1", "d2"]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, ...) as (conv_id, depth, t1, t2, chars): the place of each turn in its
    conversation from 1, a digest of its role and text, and the code points of its text.

    Turns are ordered by ``turn``, null first; turns with the same number are ordered by their digests, and
    repeated rows are turns of their own. A null role or text is empty. Rows with a null conv_id belong to no conversation and are
    left out. All rows are ordered at once by ranges, so a conversation may be as long as the table.
    """
    spark = conversations.sparkSession
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    rows = stored(rows.select("conv_id", "turn", F.xxhash64("digest").alias("t1"), F.xxhash64(F.lit(7), F.col("digest")).alias("t2"), "chars"), "turns")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "t1", "t2", "salt"]
    salted = rows.withColumn("salt", F.monotonically_increasing_id())  # equal rows may lie in several ranges
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(salted.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "t1", "t2", "chars", F.monotonically_increasing_id().alias("place")), "placed")
    placed = placed.withColumns({"part": part_of("place"), "place": place_in_part("place")})
    # a row for each conversation and range
    spans = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = spans.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("base"))
    out = stored(placed.join(bases, ["conv_id", "part"]).select("conv_id", (F.col("place") + F.col("base")).alias("depth"), "t1", "t2", "chars"), "numbered")
    forget(rows, placed)
    return out


def grafted(rows: DataFrame, *, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """``turns`` in which conversation c begins with the first h turns of conversation c - c % group and goes
    on with its own after its first h, h = crc32(c) % most; and the ids of all conversations.

    The head is shorter where that conversation has fewer turns, and missing where there is none.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    ids = rows.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id")
    turn = F.struct("depth", "t1", "t2", "chars")
    # of at most ``most`` - 1 turns each; a conversation's key is joined by ``group`` ids at most
    heads = rows.where((F.col("conv_id") % group == 0) & (F.col("depth") < most)).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("head")).withColumnRenamed("conv_id", "base")
    convs = ids.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % group}).join(heads, "base", "left")
    convs = stored(convs.select("conv_id", "h", F.when(F.col("h") > 0, F.slice("head", F.lit(1), F.col("h").cast("int"))).alias("head")), "heads")
    given = convs.select("conv_id", F.explode("head").alias("x")).select("conv_id", "x.*")
    shift = few(convs.select("conv_id", "h", (F.greatest(F.size("head"), F.lit(0)) - F.col("h")).alias("shift")))
    own = rows.where(F.col("depth") > h).join(shift, "conv_id").select("conv_id", (F.col("depth") + F.col("shift")).alias("depth"), "t1", "t2", "chars")
    return stored(own.union(given), "grafted"), convs.select("conv_id")


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """(conv_id, j, p1, p2, pre, q1, q2, turns): block j of a conversation, the digest and the code points of
    all turns before it, the digest at its end, and what its turns add."""
    hashed = rows.select("conv_id", F.expr(f"(depth - 1) DIV {block}").alias("j"), "depth", F.xxhash64("depth", "t1", "t2").alias("h1"), F.xxhash64(F.lit(7), F.col("depth"), F.col("t1"), F.col("t2")).alias("h2"), "chars")
    dealt = hashed.withColumn("slice", F.expr(f"j DIV {SLICE}")).repartition("conv_id", "slice")
    made = dealt.groupBy("conv_id", "slice", "j").agg(F.sort_array(F.collect_list(F.struct("depth", "h1", "h2", "chars"))).alias("turns"), F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"), F.sum("chars").alias("b3"))
    w = Window.partitionBy("conv_id", "slice").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"p1": F.bit_xor("b1"), "p2": F.bit_xor("b2"), "pre": F.sum("b3")}
    made = stored(made.withColumns({k: F.coalesce(v.over(w), F.lit(0).cast("long")) for k, v in sums.items()}), "blocks")
    # the few conversations of several slices start each from the sum of those before it
    long_ = few(made.where("slice > 0").select("conv_id").distinct())
    w = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = made.join(long_, "conv_id", "left_semi").groupBy("conv_id", "slice").agg(*(v.alias(f"s{k}") for k, v in sums.items()))
    carried = few(totals.select("conv_id", "slice", *(F.sum(f"s{k}").over(w).alias(f"s{k}") if k == "pre" else F.bit_xor(f"s{k}").over(w).alias(f"s{k}") for k in sums)).where("slice > 0"))
    at = lambda k: F.coalesce(f"s{k}", F.lit(0))
    whole = made.join(carried, ["conv_id", "slice"], "left").withColumns({"p1": _xor(F.col("p1"), at("p1")), "p2": _xor(F.col("p2"), at("p2")), "pre": F.col("pre") + at("pre")})
    return whole.select("conv_id", "j", "p1", "p2", "pre", _xor(F.col("p1"), F.col("b1")).alias("q1"), _xor(F.col("p2"), F.col("b2")).alias("q2"), "b3", "turns")


def _nodes(blocks: DataFrame, consts: DataFrame | None) -> DataFrame:
    """The nodes below the root: (depth, d1, d2), the same of the parent as e1 and e2, the smallest member with
    its constants as ``who``, the members ``n``, the code points of the last text and of those before it, and
    sums over the members of each constant (total, owned, leaf) of ``consts``, 0 without it."""
    names = ["total", "owned", "leaf"]
    rows = blocks.withColumns({c: F.lit(0).cast("long") for c in names}) if consts is None else blocks.join(consts, "conv_id")
    sums = [F.sum(c).alias(f"sum_{c}") for c in names]
    kinds = rows.groupBy("j", "p1", "p2", "q1", "q2").agg(F.count("*").alias("n"), F.min(F.struct("conv_id", "total", "owned", "pre", "turns")).alias("who"), *sums)
    kinds = stored(kinds, "kinds")
    parent = ["j", "p1", "p2"]
    forks = few(kinds.groupBy(*parent).agg(F.count("*").alias("k")).where("k > 1").select(*parent))

    def turns_of(df: DataFrame) -> DataFrame:
        start = F.struct(F.col("p1").alias("d1"), F.col("p2").alias("d2"), F.col("who.pre").alias("end"))
        zero = F.struct(start.alias("at"), F.expr("CAST(array() AS ARRAY<STRUCT<depth: BIGINT, d1: BIGINT, d2: BIGINT, e1: BIGINT, e2: BIGINT, chars: BIGINT, pre: BIGINT>>)").alias("out"))

        def step(s: Column, t: Column) -> Column:
            d1, d2, at = _xor(s["at"]["d1"], t["h1"]), _xor(s["at"]["d2"], t["h2"]), s["at"]
            one = F.struct(t["depth"].alias("depth"), d1.alias("d1"), d2.alias("d2"), at["d1"].alias("e1"), at["d2"].alias("e2"), t["chars"].alias("chars"), at["end"].alias("pre"))
            return F.struct(F.struct(d1.alias("d1"), d2.alias("d2"), (at["end"] + t["chars"]).alias("end")).alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

        path = F.aggregate("who.turns", zero, step, lambda s: s["out"])
        return df.select(F.explode(path).alias("x"), F.struct("who.conv_id", "who.total", "who.owned").alias("who"), "n", *(f"sum_{c}" for c in names)).select("x.*", "who", "n", *(f"sum_{c}" for c in names))

    alone = turns_of(kinds.join(forks, parent, "left_anti"))
    split = turns_of(kinds.join(forks, parent, "left_semi")).groupBy(*_KEY).agg(*(F.min(c).alias(c) for c in ("e1", "e2", "chars", "pre", "who")), *(F.sum(c).alias(c) for c in ("n", *(f"sum_{c}" for c in names))))
    return stored(alone.unionByName(split), "nodes")


def _root(convs: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    made = convs.agg(F.min(F.struct("conv_id", "total", "owned")).alias("who"), F.count("*").alias("n"), *(F.sum(c).alias(f"sum_{c}") for c in ("total", "owned", "leaf"))).where("n > 0")
    none = F.lit(None).cast("long")
    return made.select(zero.alias("depth"), zero.alias("d1"), zero.alias("d2"), none.alias("e1"), none.alias("e2"), zero.alias("chars"), zero.alias("pre"), "who", "n", "sum_total", "sum_owned", "sum_leaf")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (depth, d1, d2, conv_id) in order as (depth, d1, d2, nth, ids): runs of a node's ids, comma-joined."""
    node, ids, size, nth = None, [], 0, 0
    out: list[tuple] = []

    def flush() -> None:
        nonlocal ids, size, nth
        if ids:
            out.append((*node, nth, ",".join(ids)))
            ids, size, nth = [], 0, nth + 1

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [pa.string()])], ["depth", "d1", "d2", "nth", "ids"])
        out.clear()
        return made

    for b in batches:
        for *key, c in zip(*(x.to_pylist() for x in b.columns)):
            if key != node or size > IDS_BYTES:
                flush()
                node = key
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if len(out) >= 4096:
            yield batch()
    flush()
    if out:
        yield batch()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids in order as a SHA-256 of each node; one run at a time is held."""
    node, sha = None, None
    for b in batches:
        out = []
        for *key, ids in zip(*(b.column(c).to_pylist() for c in (*_KEY, "ids"))):
            if key != node:
                if node is not None:
                    out.append((*node, sha.hexdigest()))
                node, sha = key, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if out:
            yield _digests(out)
    if node is not None:
        yield _digests([(*node, sha.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 3 + [pa.string()])], [*_KEY, "ends_sha256"])


def _ends(last: DataFrame) -> DataFrame:
    """(depth, d1, d2, ends_sha256) of the nodes where the conversations (conv_id, depth, d1, d2) end.

    Ids are dealt by ranges and joined to runs there, so a node where very many end gets few rows."""
    parts = int(last.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = last.select(*_KEY, "conv_id").repartitionByRange(parts, "conv_id").sortWithinPartitions(*_KEY, "conv_id")
    runs = ranged.mapInArrow(_runs, "depth long, d1 long, d2 long, nth long, ids string").withColumn("part", F.spark_partition_id())
    runs = stored(runs, "runs")
    return runs.repartition(*_KEY).sortWithinPartitions(*_KEY, "part", "nth").select(*_KEY, "ids").mapInArrow(_hashed, "depth long, d1 long, d2 long, ends_sha256 string")


def trie(rows: DataFrame, conversations: DataFrame | None = None, *, block: int = BLOCK) -> DataFrame:
    """The nodes of the prefix trie of ``rows`` (conv_id, depth, t1, t2, chars; see ``turns``).

    A node is a sequence of first turns; the root, which has none, is the one of depth 0. ``conversations``
    has every conv_id, also those without turns; by default they are those of ``rows``. Returned for each node: its smallest member
    ``conv_id`` (with ``depth`` it names the node, and the turn that is its last), ``parent_conv_id`` (null for
    the root), ``n_convs`` members, ``n_children``, ``n_leaves`` (nodes without children in its subtree, itself
    included), ``saved_tokens`` (over its subtree, (n_convs - 1) times the code points of the last text)
    and ``ends_sha256`` (of the decimal ids of the conversations that end here, ascending and comma-joined).
    No conversation gives no rows. Depths of a conversation must run from 1 without gaps.
    """
    ids = (rows.select("conv_id").distinct() if conversations is None else conversations).select(F.col("conv_id").cast("long"))
    zero = F.lit(0).cast("long")
    blocks = stored(_blocks(rows, block), "blocks")
    first = _nodes(blocks, None)
    # constants of each conversation: the code points of all its turns, of the nodes it owns, and whether its end is a leaf
    tip = F.struct(F.element_at("turns", -1)["depth"].alias("depth"), F.col("q1").alias("d1"), F.col("q2").alias("d2"))
    none = F.struct(*(zero.alias(c) for c in _KEY))
    ends = blocks.groupBy("conv_id").agg(F.sum("b3").alias("total"), F.max(tip).alias("tip"))
    ends = stored(ids.join(ends, "conv_id", "left").select("conv_id", F.coalesce("total", zero).alias("total"), F.coalesce("tip", none).alias("tip")), "ends")
    start = _root(ends.select("conv_id", "total", zero.alias("owned"), zero.alias("leaf")))
    named = stored(start.unionByName(first).select(*_KEY, "e1", "e2", F.col("who.conv_id").alias("conv_id"), "chars"), "named")
    kids = stored(named.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("e1").alias("d1"), F.col("e2").alias("d2")).agg(F.count("*").alias("n_children")), "kids")
    leaves = named.join(kids, _KEY, "left_anti").groupBy("conv_id").agg(F.count("*").alias("leaf"))
    owned = named.groupBy("conv_id").agg(F.sum("chars").alias("owned"))
    consts = stored(ends.select("conv_id", "total").join(owned, "conv_id", "left").join(leaves, "conv_id", "left").na.fill(0, ["owned", "leaf"]), "consts")
    # the same nodes again, with sums of these constants over their members
    nodes = _root(consts).unionByName(_nodes(blocks, consts))
    parents = named.select((F.col("depth") + 1).alias("depth"), F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.col("conv_id").alias("parent_conv_id"))
    shas = _ends(ends.select("conv_id", "tip.*"))
    full = nodes.join(kids, _KEY, "left").join(shas, _KEY, "left").join(parents, ["depth", "e1", "e2"], "left")
    saved = F.col("sum_total") - F.col("n") * F.col("pre") - (F.col("who.total") - F.col("pre")) - F.col("sum_owned") + F.col("who.owned")
    return full.select(
        F.col("who.conv_id").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.coalesce("n_children", zero).alias("n_children"), F.col("sum_leaf").alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )
