"""The prefix trie, whitening and benchmark search against brute-force versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from loomspark.llm import decontaminate, prefix_trie, whitening
from loomspark.session import scratch

TURNS = "conv_id long, turn long, role string, text string, depth string, n string"


def conversations(seed, n=60, longest=9):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-250, 950), n):
        for t in range(r.choice([1, 2, 3, 5, longest])):
            number = None if r.random() < 0.1 and t == 0 else t
            rows.append((c, number, r.choice(["user", "user", "bot", None]), r.choice(["a", "b", "é1", "", None]) if r.random() < 0.7 else "same", "x", "y"))
    rows += [(100, t, "user", "hot", "x", "y") for t in range(200)] + [(101, 7, "user", "twin", "x", "y")] * 3 + [(None, 0, "user", "lost", "x", "y")]
    return rows


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, text))
    # only repeated rows tie on turn here, so any order of ties will do
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    paths = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        paths[c] = own.get(base, [])[:h] + mine[h:]
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    out = set()
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)

    def below(k):
        todo, all_ = [k], []
        while todo:
            all_.append(todo.pop())
            todo += kids[all_[-1]]
        return all_

    for k, m in members.items():
        sub = below(k)
        ends = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(k))
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in sub if x)
        out.add((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), sum(not kids[x] for x in sub), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SLICE", 2)  # slices of 2 blocks, so that the long conversation has many
    rows = conversations(seed)
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    got = [tuple(r) for r in prefix_trie.trie(*prefix_trie.grafted(prefix_trie.turns(df)), block=2 + seed).collect()]
    want = brute_trie(rows)
    assert len(got) == len(want) and set(got) == want


def test_trie_alone(spark):
    """Without grafting, with turnless conversations, and of nothing."""
    df = spark.createDataFrame([(1, 1, "u", "ab"), (2, 1, "u", "ab"), (2, 2, "b", "c")], "conv_id int, turn int, role string, text string")
    rows = prefix_trie.turns(df)
    ids = spark.createDataFrame([(1,), (2,), (9,)], "conv_id int")
    got = {(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in prefix_trie.trie(rows, ids).collect()}
    assert got == {(1, 0, None, 3, 1, 1, 2), (1, 1, 1, 2, 1, 1, 2), (2, 2, 1, 1, 0, 1, 0)}
    only = prefix_trie.trie(rows.limit(0), ids).collect()
    assert [(r.conv_id, r.depth, r.n_convs, r.n_leaves, r.ends_sha256) for r in only] == [(1, 0, 3, 1, hashlib.sha256(b"1,2,9").hexdigest())]
    empty = prefix_trie.turns(df.limit(0))
    assert prefix_trie.trie(*prefix_trie.grafted(empty)).count() == 0


def test_runs_of_ids():
    """Runs are cut by bytes and at nodes, and give the hash of all ids of a node."""
    ids = {(1, 5, 5): range(30_000), (2, 0, -3): [7], (2, 0, 4): [8, 9]}
    rows = [(*k, c) for k in sorted(ids) for c in ids[k]]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[i : i + 999])], ["depth", "d1", "d2", "conv_id"]) for i in range(0, len(rows), 999)]
    runs = list(prefix_trie._runs(iter(batches)))
    assert sum(b.num_rows for b in runs) >= 4 and max(len(x) for b in runs for x in b.column("ids").to_pylist()) <= prefix_trie.IDS_BYTES + 20
    got = {tuple(r[:3]): r[3] for b in prefix_trie._hashed(iter(runs)) for r in zip(*(c.to_pylist() for c in b.columns))}
    assert got == {k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in ids.items()}


VECTORS = "vec_id long, embedding array<float>, n string, x string"


def brute_whitening(vectors, k):
    usable = [(i, v) for i, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([np.floor(256 * np.array(v, np.float32).astype(float)) for _, v in usable]).astype(np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    y = u - s / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1], axes[:, ::-1]
    w = (x - s / n) @ axes[:, :k] / np.sqrt(values[:k])
    return [i for i, _ in usable], n, ((n * x - s) ** 2).sum(1), w, values[:k] / values.sum()


@pytest.mark.parametrize("k", [3, 20])
def test_whitening(spark, k):
    r = np.random.default_rng(k)
    base = r.standard_normal((300, 24)) * np.linspace(3, 0.2, 24)
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    vectors += [(1000, vectors[0][1]), (1001, vectors[0][1]), (1000, vectors[5][1]), (None, vectors[7][1])]
    bad = [(2000, None), (2001, [None] + [1.0] * 23), (2002, [float("nan")] * 24), (2003, [float("inf")] + [0.0] * 23), (2004, [1.0, 2.0]), (2005, [])]
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in vectors + bad], VECTORS).repartition(4)
    got = whitening.whitened(df, k=k).toPandas()
    ids, n, deviation, w, explained = brute_whitening(vectors, k)
    assert (got.n == n).all() and got.identity_error.max() < 1e-9 and len(got) == k * len(vectors)
    key = lambda i, d: (i is None or i != i, i or 0, d)
    for c in range(k):
        mine = got[got.component == c + 1]
        assert abs(mine.explained.iloc[0] / explained[c] - 1) < 1e-9
        a = sorted(zip([None if i != i else int(i) for i in mine.vec_id], mine.deviation, mine.whitened), key=lambda x: key(*x[:2]))
        b = sorted(zip(ids, deviation.tolist(), w[:, c]), key=lambda x: key(*x[:2]))
        assert [x[:2] for x in a] == [x[:2] for x in b]
        a, b = np.array([x[2] for x in a]), np.array([x[2] for x in b])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8


def test_whitening_of_little(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 2.0], "a", "b")] * 3, VECTORS)
    assert whitening.whitened(df).count() == 0 == whitening.whitened(df.limit(0)).count()
    flat = spark.createDataFrame([(i, [i * 1.0, 0.5, 0.0], "a", "b") for i in range(5)], VECTORS)
    rows = whitening.whitened(flat).collect()  # one dimension varies, so there is one component
    assert {(r.component, round(r.explained, 12)) for r in rows} == {(1, 1.0)} and len(rows) == 5
    assert max(abs(abs(r.whitened) - abs(r.vec_id - 2) / 2**0.5) for r in rows) < 1e-9
    square = spark.createDataFrame([(i, [a, b], "a", "b") for i, (a, b) in enumerate([(1.0, 1.0), (1.0, -1.0), (-1.0, 1.0), (-1.0, -1.0)])], VECTORS)
    rows = whitening.whitened(square).collect()  # equal eigenvalues
    assert {r.component for r in rows} == {1, 2} and max(r.identity_error for r in rows) < 1e-12 and {round(r.explained, 9) for r in rows} == {0.5}
    with pytest.raises(Exception, match="too large"):
        whitening.whitened(spark.createDataFrame([(1, [1e30, 0.0], "a", "b"), (2, [0.0, 0.0], "a", "b")], VECTORS)).count()


def test_inertia():
    r = np.random.default_rng(3)
    a = r.standard_normal((40, 40))
    v = a @ a.T
    form = whitening.tridiagonal(v)
    values = np.linalg.eigvalsh(v)[::-1]
    cuts = np.append((values[:-1] + values[1:]) / 2, values[0] + 1)
    assert whitening.above(form, cuts).tolist() == [int((values > c).sum()) for c in cuts]
    parts = whitening.intervals(form, 20, float(np.trace(v)))
    assert sum(m for *_, m in parts) == 20 and all(((values > low) & (values < high)).sum() == m for low, high, m in parts)
    big = whitening._deviation(np.array([[1 << 20, 3]]), 1 << 10, [5, -7])
    assert big.tolist() == [((1 << 30) - 5) ** 2 + ((3 << 10) + 7) ** 2]
    with pytest.raises(OverflowError):
        whitening._deviation(np.array([[1 << 39]]), 1 << 20, [0])


BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return BENCH_WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, window=10):
    strings = defaultdict(set)
    for item, text in items:
        w = lowered(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            strings[tuple(w[i : i + m])].add("" if item is None else str(item))
    lengths = {len(s) for s in strings}
    out = []
    for doc_id, text in docs:
        w, hit, found = lowered(text), set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                if (s := tuple(w[i : i + m])) in strings:
                    hit |= set(range(i, i + m))
                    found |= strings[s]
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return out


def search_case(seed):
    r = random.Random(seed)
    vocabulary = ["A", "b", "É", "é", "x1", "don't", "q_q", "Zz", "zz", "日本", "1", "\x01c"]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n", "--", "\x00"]) for _ in range(n))
    items = [(i, text(r.choice([1, 2, 4, 9, 10, 11, 30]))) for i in range(12)] + [(3, text(20)), (None, text(14)), (50, None), (51, ""), (52, "?!"), (53, "Bb"), (54, "bB")]
    items += [(55, items[11][1] + " tail"), (56, items[11][1].upper())]
    docs = [(i, text(r.choice([0, 1, 5, 40, 200]))) for i in range(30)]
    docs += [(i + 100, text(15) + (r.choice(items)[1] or "") + " " + text(15)) for i in range(12)]
    docs += [(200, None), (201, ""), (202, items[11][1]), (202, items[11][1]), (None, items[4][1]), (203, items[5][1].upper() * 3)]
    return [(d, t if t is None else t.replace("\x00", "\x02")) for d, t in docs], [(i, t if t is None else t.replace("\x00", "\x02")) for i, t in items]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_search(spark, seed, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE_WORDS", 60)  # several slices
    monkeypatch.setattr(decontaminate, "PIECE", 16)  # items in several pieces
    docs, items = search_case(seed)
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], "doc_id long, text string, n_words string, items string").repartition(3)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id int, text string, doc_id string")
    got = [(r.doc_id, r.n_words, sum(h.length for h in r.hits), r["items"]) for r in decontaminate.search(df, bench).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_search(docs, items)))
    assert {r.n_words for r in decontaminate.search(df, bench.limit(0)).collect()} == {n for _, n, *_ in brute_search(docs, [])}
    assert decontaminate.search(df.limit(0), bench).count() == 0


@pytest.mark.parametrize("chunk", [1, 7, 64, 300])
def test_search_in_parts(spark, chunk, monkeypatch):
    """Texts that are longer than what is searched at once."""
    docs, items = search_case(9)
    folder = scratch(spark, "strings")
    bench = spark.createDataFrame(items, "item_id int, text string")
    pieces = decontaminate.pieces(bench).toArrow()
    decontaminate._build(folder, 10)(pieces.append_column("slice", pa.array([0] * pieces.num_rows)))
    monkeypatch.setattr(decontaminate, "CHUNK", chunk)
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([t for _, t in docs])], ["doc_id", "text"])
    out = [r for b in decontaminate._search(folder, [0], 10)(iter([batch.slice(0, 20), batch.slice(20)])) for r in b.to_pylist()]
    got = [(r["doc_id"], r["n_words"], sum(h["length"] for h in r["hits"]), r["items"]) for r in out]
    assert got == brute_search(docs, items)
    for r in out:  # spans are apart and in order
        ends = [(h["start"], h["start"] + h["length"]) for h in r["hits"]]
        assert all(b < c for (_, b), (c, _) in zip(ends, ends[1:]))


def test_hash_collisions(spark, monkeypatch):
    """With hashes that all collide, the comparison of words alone decides."""
    monkeypatch.setattr(decontaminate, "spans_hash", lambda data, start, end: np.zeros(len(start), np.uint64))
    docs, items = search_case(4)
    docs = docs[:20] + docs[30:]
    folder = scratch(spark, "strings")
    pieces = decontaminate.pieces(spark.createDataFrame(items, "item_id int, text string")).toArrow()
    decontaminate._build(folder, 10)(pieces.append_column("slice", pa.array([0] * pieces.num_rows)))
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([t for _, t in docs])], ["doc_id", "text"])
    got = [(r["doc_id"], r["n_words"], sum(h["length"] for h in r["hits"]), r["items"]) for b in decontaminate._search(folder, [0], 10)(iter([batch])) for r in b.to_pylist()]
    assert got == brute_search(docs, items)
