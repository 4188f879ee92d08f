"""Embedding near-dedup by sharded small-world graphs (operator 7).

Equal vectors become one class. The classes are dealt to shards by hash and every shard gets a
hierarchical graph, whose beam is widened until an audit against brute force passes; a shard whose audit
fails at the widest beam is searched by brute force. A shard is a few array files in the shared folder.
A task takes two shards by their paths and searches the vectors of each in the graph of the other, after an audit
of both searches by a sample of queries, which makes it compare all vectors of the two where it fails;
what is found is verified by cosine in double precision. It returns no pairs but, for each vector, how many
it found and one vector of its component, so that its result grows with vectors and not with links.
Where a link was found from one side only, the links of its component are counted by brute force.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import forget, scratch, stored
from .graph import components
from .hnsw import BLOCK, SLACK, Graph
from .token_files import fs, place
from .words import U, mix

#: Shards are this many at least, and more if a shard would have more vectors or bytes of components than this.
SHARDS, SHARD_ROWS, SHARD_BYTES = 4, 100_000, 128 << 20
#: Vectors with neighbours that are audited of a shard at least, and the share of their neighbours to be found.
AUDITED, RECALL = 512, 0.99
#: Queries by which a search between two shards is audited, and how many of them are drawn among vectors with links.
CROSS_AUDITED, CROSS_LINKED = 256, 192
#: Bytes of components that are gathered at once to compare vectors.
GATHERED = 32 << 20


def usable(v: Column) -> Column:
    """Whether a vector has a direction: not null, no null or non-finite component, not all zero."""
    big = F.lit(float("inf"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == big))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    m = m / np.abs(m).max(1, keepdims=True)  # squares neither overflow nor vanish
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _put(folder: str) -> Callable[[str, np.ndarray], None]:
    where, path = place(folder)
    where.create_dir(path, recursive=True)

    def put(name: str, values: np.ndarray) -> None:
        blob = BytesIO()
        np.save(blob, np.ascontiguousarray(values))
        with where.open_output_stream(f"{path}/{name}.npy") as f:
            f.write(blob.getbuffer())

    return put


def _get(folder: str) -> Callable[[str], np.ndarray]:
    """Arrays of a folder: memory-mapped where it is on a mounted file system."""
    where, path = place(folder)

    def get(name: str) -> np.ndarray:
        if isinstance(where, fs.LocalFileSystem):
            return np.load(f"{path}/{name}.npy", mmap_mode="r")
        with where.open_input_file(f"{path}/{name}.npy") as f:
            return np.load(BytesIO(f.read()))

    return get


def _build(least: float, folder: str):
    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        dim, shard = table.column("dim")[0].as_py(), table.column("shard")[0].as_py()
        unit = _unit(table.column("embedding").combine_chunks().flatten().to_numpy().reshape(-1, dim))
        graph = Graph(unit.astype(np.float32))
        found = graph.audit(least, RECALL, AUDITED)
        # a retried or speculative task writes other files; only the row counts
        path = f"{folder}/{dim}-{shard}-{TaskContext.get().taskAttemptId()}"
        put = _put(path)
        put("ids", table.column("id").to_numpy())
        put("weights", table.column("size").to_numpy())
        put("unit", unit)
        graph.save(put)
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "beam": pa.array([graph.beam]), "recall": pa.array([found]), "path": pa.array([path])})

    return build


class _Shard:
    def __init__(self, path: str):
        get = _get(path)
        self.ids, self.weights, self.unit, self.graph = get("ids"), get("weights"), get("unit"), Graph.load(get)


def _join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the components of the nodes a[i] and b[i]; every label is the smallest node of its component."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(labels, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up


def linked(p: _Shard, q: _Shard, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For the vectors of p and then of q (once if they are one shard): the weight of the vectors of the
    other that each is linked with, and the first vector of its component."""
    same = p is q
    n, m = len(p.ids), 0 if same else len(q.ids)
    labels, weight = np.arange(n + m), np.zeros(n + m, np.int64)
    marks = np.zeros((2, n + m), U)  # sums over the pairs found from each side

    block = max(1, GATHERED // (8 * p.unit.shape[1]))

    def verified(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(a), bool)
        for i in range(0, len(a), block):
            s = slice(i, i + block)
            keep[s] = np.einsum("id,id->i", x[a[s]], y[b[s]]) >= least
        return keep

    for x, y, at_x, at_y in [(p, q, 0, 0)] if same else [(p, q, 0, n), (q, p, n, 0)]:
        for i, a, b in y.graph.hits(x.graph.x, least - SLACK):
            a = a + i
            ok = verified(x.unit, y.unit, a, b) & ((a != b) | (not same))
            a, b = a[ok], b[ok]
            np.add.at(weight, a + at_x, y.weights[b])
            u, v = a + at_x, b + at_y
            pair = mix(np.minimum(u, v).astype(U) * U(0x9E3779B97F4A7C15) + np.maximum(u, v).astype(U))
            np.add.at(marks, ((u > v).astype(np.int64), u), pair)
            _join(labels, u, v)
    sums = np.zeros((2, n + m), U)
    for side in (0, 1):
        np.add.at(sums[side], labels, marks[side])
    uneven = sums[0] != sums[1]
    if uneven.any():  # some link of these components was found from one side only
        mine = np.flatnonzero(uneven[labels])
        weight[mine] = 0
        left, right = (mine, mine) if same else (mine[mine < n], mine[mine >= n])
        x, heavy, less = (p.unit, p.weights, 0) if same else (q.unit, q.weights, n)  # of what the right holds
        for c in np.unique(labels[mine]):
            l, r = left[labels[left] == c], right[labels[right] == c]
            for i in range(0, len(l), BLOCK):
                for j in range(0, len(r), block):
                    a, b = l[i : i + BLOCK], r[j : j + block]
                    near = p.unit[a] @ x[b - less].T >= least
                    if same:
                        near &= a[:, None] != b[None, :]
                    weight[a] += near @ heavy[b - less]
                    if not same:
                        weight[b] += near.T @ p.weights[a]
    return weight, labels


def audited(p: _Shard, q: _Shard, least: float) -> float:
    """The recall of searches between two shards, by a sample of the queries of both; where it is too low, both are
    searched by brute force from then on. Most queries are drawn among the vectors that the other shard has neighbours of, found by
    a quick search, as others show nothing."""
    true, found = 0, 0
    for x, y in ((p, q), (q, p)):
        order = np.random.default_rng(len(x.ids)).permutation(len(x.ids))
        linked_, looked = np.zeros(0, np.int64), 0
        while looked < len(order) and looked < 64 * BLOCK and len(linked_) < CROSS_LINKED:
            part = order[looked : looked + BLOCK]
            linked_ = np.append(linked_, part[np.unique(y.graph.near(x.graph.x[part], least, y.graph.beam)[0])])
            looked += BLOCK
        pick = np.unique(np.append(linked_[:CROSS_LINKED], order[: CROSS_AUDITED - CROSS_LINKED]))
        one = y.graph.recall_of(x.graph.x[pick], least)
        true, found = true + one[0], found + one[1]
    if found < RECALL * true:
        p.graph.exact = q.graph.exact = True
        return 1.0
    return found / true if true else 1.0


def _search(least: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                p = _Shard(row["a"])
                q = p if row["a"] == row["b"] else _Shard(row["b"])
                recall = None if p is q else audited(p, q, least)
                weight, labels = linked(p, q, least)
                ids = p.ids if p is q else np.concatenate([p.ids, q.ids])
                told = np.flatnonzero((weight > 0) | (labels != np.arange(len(labels))))
                # beside the vectors' rows, one without id for the recall of two different shards
                rows = [np.append(c, v) for c, v in ((ids[told], 0), (weight[told], 0), (ids[labels[told]], 0))]
                none = np.append(np.zeros(len(told), bool), True)
                measured = pa.array([None] * len(told) + [recall], pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], mask=none), pa.array(rows[1], mask=none), pa.array(rows[2], mask=none), measured], ["id", "others", "first", "recall"])

    return search


def index(classes: DataFrame, least: float) -> DataFrame:
    """A row for each shard: the folder of its files, the beam and the recall that the audit measured (1 if it
    compares all). ``classes``: id, embedding, dim, size."""
    folder = scratch(classes.sparkSession, "shards")
    n, dims = classes.agg(F.count("*"), F.sum(F.col("dim").cast("long"))).first()
    shards = max(SHARDS, -(-n // SHARD_ROWS), -(-8 * (dims or 0) // SHARD_BYTES))
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    # one graph a task; a shard is bounded by SHARD_ROWS and SHARD_BYTES
    return stored(dealt.repartition(shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(_build(least, folder), "dim int, shard int, beam long, recall double, path string"), "graphs")


def dedup(vectors: DataFrame, *, least: float = 0.9) -> DataFrame:
    """For each row of ``vectors`` (vec_id, embedding): vec_id, n_links (other vectors with cosine
    ``least`` or more), component_id (smallest vec_id reachable by links), kept, and recall (one value: the least share of
    links that the audits of shards and of searches between them have found; a search of which less than ``RECALL`` was found is
    made by brute force and counts as 1).

    Vectors that are null, zero, or hold null or non-finite components link with nothing and are
    kept, and so do vectors of different lengths. Links are found with the audited recall;
    none below ``least`` is reported. Rows with equal vectors always link; rows that share a vec_id count as
    other vectors each, and are one node. A row with a null vec_id links with nothing and is kept. Other columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding"))
    good = rows.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    # equal vectors are combined before the shuffle
    classes = good.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("size")).withColumn("dim", F.size("embedding"))
    classes = stored(classes.withColumns(_digest(F.col("embedding"))), "classes")
    shards = index(classes, least)
    # every shard meets every shard once, by path: a narrow row for each two of them
    a, b = shards.select("dim", F.col("shard").alias("i"), F.col("path").alias("a")), shards.select("dim", F.col("shard").alias("j"), F.col("path").alias("b"))
    two = stored(a.join(b, "dim").where("i <= j").select("a", "b"), "tasks")
    n = max(1, two.count())
    searched = stored(two.repartition(n, F.xxhash64("a", "b")).mapInArrow(_search(least), "id long, others long, first long, recall double"), "links")
    found = searched.where("id IS NOT NULL")
    degrees = found.groupBy("id").agg(F.sum("others").alias("others"))
    labels = components(found.where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))).toDF("id", "component")
    known = classes.join(degrees, "id", "left").join(labels, "id", "left").select("e1", "e2", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("c"))
    known = stored(known, "known")
    # vectors are looked up by their digests, and those that link with nothing aren't
    linkable = good.select("vec_id", *(v.alias(k) for k, v in _digest(F.col("embedding")).items())).join(known, ["e1", "e2"]).select("vec_id", "n", "c")
    alone = rows.where(~usable(F.col("embedding")) | F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("c"))
    recall = shards.select("recall").union(searched.select("recall")).agg(F.min("recall")).first()[0]
    forget(two, searched)
    return linkable.union(alone).select("vec_id", F.col("n").alias("n_links"), F.col("c").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("c"), F.lit(True)).alias("kept"), F.lit(1.0 if recall is None else recall).alias("recall"))


def _digest(v: Column) -> dict[str, Column]:
    """128 bits that know a vector."""
    return {"e1": F.xxhash64(v), "e2": F.xxhash64(F.lit(7), v)}
