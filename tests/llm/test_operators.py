"""Each operator against a brute-force version or an exact round trip, on rows with nulls, empty and
long texts, ties, repeated rows and columns of clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

import corpus_pipeline
from loomspark.llm import embedding_dedup, graph, hnsw, jaccard, licenses, line_dedup, mixing, nbsvm, packing, quality_rules, queries, substrings, token_files, words
from loomspark.llm.tokens import Encoder, default_tokenizer
from loomspark.session import scratch

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n_words string, source string, lang string, n_chars long"


def made(seed=5, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(400)]
    passage = " ".join(r.choice(vocabulary) for _ in range(30))
    out, texts = [], []
    for i in range(n):
        kind = r.random()
        if kind < 0.3 and texts:
            words = r.choice(texts).split(" ")
            for _ in range(r.choice([0, 0, 1, 2])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            text = " ".join(words)
        else:
            text = " ".join(r.choice(vocabulary) + r.choice(["", "", ".\n", "!!"]) for _ in range(r.randint(1, 150)))
            if kind > 0.8:
                text += "\n" + passage + "\n" + text[:40]
        texts.append(text)
        out.append((i, text, "x", r.choice(["a", "a", "b", None]), "en", len(text)))
    out += [(n, None, None, "a", None, None), (n + 1, "", "", "b", "en", 0), (n + 2, " \n\t ", "", "b", "en", 3), (n + 3, "To " * 3000, "", "a", "en", 9000), (n + 4, texts[3], "", "a", "en", 1), (n + 5, "tiny text", "", "a", "en", 1), (n + 6, "Tiny TEXT", "", "a", "en", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "conversations", "benchmark"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = db.sql(queries.ORACLE[name])
    names, rows = want.columns, want.fetchall()
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(rows)


def twins(n):
    """Two words of n characters that a polynomial modulo a power of two doesn't tell apart."""
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return ["".join(letters[b] for b in bits) for letters in ("ab", "ba")]


@pytest.mark.parametrize("n", [1024, 4096])
def test_twin_words(spark, n):
    x, y = twins(n)
    rest = " ".join(f"w{i}" for i in range(19))
    df = spark.createDataFrame([(1, f"{x}\n{y}"), (2, x), (3, y), (4, f"{x} {rest}"), (5, f"{y} {rest}")], "doc_id int, text string")
    assert {r.n_dup_lines for r in quality_rules.ledger(df).collect()} == {0}
    assert all(r.component_id == r.doc_id for r in jaccard.join(df).collect() if r.doc_id < 4)
    assert all(r.n_removed == 0 for r in substrings.dedup(df).collect())
    assert {r.n_removed for r in line_dedup.dedup(df).collect()} == {0, 1}


def test_rules(spark, docs, empty):
    got = {r.doc_id: r for r in quality_rules.ledger(docs).collect()}
    for d, text, *_ in made():
        text = text or ""
        w = WORD.findall(text)
        c = Counter(zip(w, w[1:], w[2:]))
        cover = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words, r.n_lines) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(cover), len(lines))
    kept = {r.doc_id for r in quality_rules.keep(docs).collect()}
    assert kept == {d for d, r in got.items() if not r.failed_bits & quality_rules.mask(("web", 2))}
    lone = quality_rules.decisive(("web", 2))
    alone = Counter(r.rule for r in quality_rules.ledger(docs).select(lone.alias("rule")).collect() if r.rule)
    for rule, n in alone.items():
        assert n == sum(r.failed_bits & quality_rules.mask(("web", 2)) == quality_rules.BITS[rule] for r in got.values())
    rows = {r.rule: r for r in quality_rules.ablation(quality_rules.ledger(docs), ("web", 2)).collect()}
    assert rows["few_words"].n_failed == sum(r.n_words < 50 for r in got.values())
    assert rows["few_words"].n_kept_without == len(kept) + rows["few_words"].n_only
    assert {k: r.n_only for k, r in rows.items() if r.n_only} == dict(alone)
    assert quality_rules.ledger(empty).count() == 0 == quality_rules.keep(empty).count()


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def edited(r, s):
    b = list(s)
    for _ in range(r.randint(0, 4)):
        i = r.randint(0, len(b))
        kind = r.random()
        if kind < 0.4:
            b.insert(i, r.choice("abcd"))
        elif b:
            b.pop(min(i, len(b) - 1)) if kind < 0.7 else b.__setitem__(min(i, len(b) - 1), "é")
    return "".join(b)


def test_edit_distance(spark):
    r = random.Random(3)
    pairs = [(i, i, a := "".join(r.choice("abcé") for _ in range(r.randint(0, 20))), edited(r, a)) for i in range(500)]
    got = {x.a for x in line_dedup._close(spark.createDataFrame(pairs, "a long, b long, ta string, tb string"), 2).collect()}
    assert got == {p[0] for p in pairs if distance(p[2], p[3]) <= 2}


class Sets:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def test_line_marks(spark):
    r = random.Random(3)
    rows = []
    for _ in range(400):
        a = b = "".join(r.choice("abcé 😀") for _ in range(r.randint(0, 60)))
        for _ in range(2):
            i = r.randint(0, len(b))
            b = b[:i] + r.choice(["", "x", "a"]) + b[i + r.choice([0, 1]) :]
        rows.append((a, b))
    m = spark.createDataFrame(rows, "a string, b string").select(line_dedup._marks(F.col("a")).alias("a"), line_dedup._marks(F.col("b")).alias("b")).collect()
    bits = [sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(row.a, row.b, strict=True)) for row in m]
    assert max(bits) <= 8
    assert any(bits)


def test_line_dedup(spark, empty):
    r = random.Random(9)
    base = ["".join(r.choice("abcde ") for _ in range(r.randint(20, 60))) for _ in range(8)]
    rows = [(d, "\n".join(edited(r, r.choice(base)) for _ in range(r.randint(1, 5)))) for d in range(60)] + [(60, None), (61, ""), (62, " \n\n")]
    refs = defaultdict(list)
    for d, t in rows:
        for i, x in enumerate((t or "").split("\n")):
            if WORD.search(x):
                refs[x].append((d, i))
    lines = sorted(refs)
    sets = Sets(lines)
    for i, a in enumerate(lines):
        for b in lines[:i]:
            if min(len(a), len(b)) >= line_dedup.SHORTEST and abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2:
                sets.join(a, b)
    classes = defaultdict(list)
    for x in lines:
        classes[sets.root(x)] += refs[x]
    gone = {ref for c in classes.values() for ref in sorted(c)[1:]}
    got = {x.doc_id: x for x in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("own"))).collect()}
    for d, t in rows:
        want = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)
        assert (got[d].text, got[d].n_removed) == (want, sum(g[0] == d for g in gone))
    assert line_dedup.dedup(empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_of_shared_ids(spark, seed):
    """Rows that share a doc_id, or have none, lose no line with all of its copies: of each class of lines one stays."""
    r = random.Random(seed)
    base = ["".join(r.choice("abcde ") for _ in range(r.randint(20, 40))) for _ in range(25)] + ["aaa unique one", "unique two bbb", "foo line here"]
    rows = [(None, "aaa unique one\nfoo line here"), (None, "foo line here\nunique two bbb"), (7, "one more of seven\nfoo line here"), (7, "foo line here\nthe other of seven")]
    rows += [(r.choice([None, None, 7, 8]), "\n".join(edited(r, r.choice(base)) if r.random() < 0.5 else r.choice(base) for _ in range(r.randint(1, 5)))) for _ in range(40)]
    rows = list(dict.fromkeys(rows))
    lines = sorted({x for _, t in rows for x in t.split("\n") if WORD.search(x)})
    sets = Sets(lines)
    for i, a in enumerate(lines):
        for b in lines[:i]:
            if abs(len(a) - len(b)) <= 2 and distance(a, b) <= min(2, min(len(a), len(b)) // 10):
                sets.join(a, b)
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    left = Counter(sets.root(x) for row in got for x in row.text.split("\n") if WORD.search(x))
    assert left == Counter({sets.root(x) for x in lines})
    # rows that share both are one document, and each keeps its lines
    twice = line_dedup.dedup(spark.createDataFrame([(1, "once only here\nonce only here"), (1, "once only here\nonce only here"), (2, "once only here")], "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.text) for x in twice) == [(1, "once only here"), (1, "once only here"), (2, "")]


def test_short_lines(spark):
    """Lines of 6 to 26 characters against brute force: one edit for each ten characters of the shorter, two at most."""
    r = random.Random(6)
    base = ["".join(r.choice("abcde fgh") for _ in range(n)) for n in range(6, 27) for _ in range(3)]
    lines = sorted({x for s in base for x in [s, *(edited(r, s) for _ in range(4))] if x.strip(" ")} | {"Subscribe to our list!", "Subscribe to our list", "Read it all!", "Read it all"})
    sets = Sets(lines)
    for i, a in enumerate(lines):
        for b in lines[:i]:
            most = min(2, min(len(a), len(b)) // 10)
            if abs(len(a) - len(b)) <= most and distance(a, b) <= most:
                sets.join(a, b)
    got = line_dedup.dedup(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).where("n_removed = 0").collect()
    assert {x.text for x in got} == {x for x in lines if sets.root(x) == x}
    assert sets.root("Read it all!") == "Read it all"


def test_jaccard(spark, docs, empty):
    sets = {}
    for d, text, *_ in made():
        w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    u = Sets(sets)
    for a in sets:
        for b in sets:
            if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                u.join(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()}
    assert got == {d: (len(s), u.root(d)) for d, s in sets.items()}
    assert {r.doc_id for r in jaccard.keep_first(docs.union(docs.where("doc_id = 2"))).collect()} == {d for d in sets if u.root(d) == d}
    assert jaccard.join(empty).count() == 0


def test_jaccard_repeated_ids(spark):
    """A document of two texts is linked by either, whatever the order of its rows; so is one without a doc_id."""
    a, b = ([f"{c}{i}" for i in range(200)] for c in "ab")
    near = [*b[:199], "x"]
    rows = [(1, a), (1, b), (2, near), (None, a[:-1]), (3, ["alone"]), (None, ["other"])]
    for _ in range(2):
        rows.reverse()
        got = jaccard.join(spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")).collect()
        assert sorted((x.doc_id or 0, x.n_shingles, x.component_id) for x in got) == [(0, 1, None), (0, 195, 1), (1, 196, 1), (1, 196, 1), (2, 196, 1), (3, 1, 3)]


def test_jaccard_frequent_groups(spark):
    """Chains of near copies whose groups are frequent, with sets of few and of many such tokens."""
    r = random.Random(2)
    rows = []
    for g in range(2):
        words = [f"w{g}_{i}" for i in range(120)]
        for i in range(70):
            words[r.randrange(120)] = f"x{g}_{i}"
            rows.append((g * 100 + i, " ".join(words)))
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in rows for w in [t.split(" ")]}
    u = Sets(sets)
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                u.join(a, b)
    got = {x.doc_id: x.component_id for x in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: u.root(d) for d in sets}


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 7), (50, 51), (51, 52), (9, 9)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 0, 50: 50, 51: 50, 52: 50}


def without_repeats(rows):
    """What op6 leaves of (doc_id, text) rows in rising doc_id order: words, removed words, kept text."""
    first, want = set(), {}
    for d, text in rows:
        w = WORD.findall(text or "")
        gone = set()
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            gone |= set(range(i, i + 20)) if key in first else set()
            first.add(key)
        want[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return want


def test_substrings(spark, docs, empty):
    want = without_repeats([(d, text) for d, text, *_ in made()])
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substrings.dedup(docs).collect()} == want
    assert any(v[1] for v in want.values())
    assert substrings.dedup(empty).count() == 0


def test_substring_branches(spark):
    """Passages that end, begin, fork, join, swap and circle at every place of each other."""
    r = random.Random(11)
    fresh = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    a, b, c, circle = fresh(400), fresh(90), fresh(25), fresh(7)
    texts = [a, a[100:300], [*a[:150], *b, *a[150:]], [*b, *c, *b], [*c, *a[390:], *a[:40]], circle * 30, [*circle * 9, *b[:50]], ["x"] * 70, ["x"] * 45 + c, a + a]
    for _ in range(40):
        copy = list(r.choice(texts[:8]))
        for _ in range(r.randrange(3)):
            copy[r.randrange(len(copy))] = "edit"
        lo = r.randrange(len(copy))
        texts.append([*fresh(r.randrange(5)), *copy[lo : lo + r.randrange(10, 300)], *fresh(r.randrange(3))])
    rows = [(i, r.choice([" ", "\n", " \t "]).join(t)) for i, t in enumerate(texts)]
    got = {x.doc_id: (x.n_words, x.n_removed, x.text) for x in substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == without_repeats(rows)


def test_stretches(spark):
    """Paths 1 to 6 are one stretch, 7 is forked, 8 is of one document only, 9 goes into 1 without being its only way in."""
    chain = [(i, 0, 5, i + 1 if i < 6 else 0, i - 1) for i in range(1, 7)]
    rows = [*chain, (7, 0, 5, 0, 0), (8, 3, 3, 9, 0), (9, 3, 5, 1, 0)]
    units = spark.createDataFrame(rows, "path long, first long, last long, after long, before long")
    assert {(x.path, x.first, x.size) for x in substrings._stretches(units).collect()} == {(1, 0, 6), (7, 0, 1), (9, 3, 1)}


def test_substring_digests():
    """A place whose words are not those of the source stays, whatever its path keys say."""
    text = " ".join(f"w{i}" for i in range(60))
    batch = lambda heads, sizes, digest: pa.RecordBatch.from_pylist([{"doc_id": 2, "text": text, "heads": heads, "sizes": sizes, "d1": [digest[0]], "d2": [digest[1]], "windows": [0]}])
    source = next(substrings._paths(20)(iter([pa.RecordBatch.from_pylist([{"doc_id": 1, "text": text}])])))
    before, keys = source.column("before").to_pylist(), source.column("path").to_pylist()
    head = [keys[before.index(0)]]
    right = next(substrings._digests(20)(iter([batch(head, [len(keys)], (0, 0))]))).to_pylist()[0]
    removed = lambda d: next(substrings._cleaned(20)(iter([batch(head, [len(keys)], d)]))).column("n_removed").to_pylist()
    assert removed((right["d1"], right["d2"])) == [60]
    assert removed((right["d1"], right["d2"] ^ 1)) == [0]


def test_classifier(spark):
    r = random.Random(4)
    good = lambda: " ".join(r.choice(["abc", "def", "ghi", "jkl"]) for _ in range(40))
    rows = [(i, good() if i % 3 else good().upper().replace(" ", "!! "), int(i % 3 > 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = nbsvm.train(df, df)
    got = nbsvm.score(df.drop("quality").union(spark.createDataFrame([(900, None), (901, "")], "doc_id long, text string")), model).collect()
    label = {d: q for d, _, q in rows}
    assert all(x.predicted == label[x.doc_id] for x in got if x.doc_id < 900)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) and 0 <= x.score <= 1 for x in got)
    none = nbsvm.train(df, df.where("false"))
    assert {x.score for x in nbsvm.score(df, none).collect()} == {0.5}


def test_mixing(spark, docs, empty):
    got = mixing.mixed(docs, {"a": 0.25, "b": 0.75}, epochs=40.0).groupBy(F.coalesce("source", F.lit("")).alias("s")).agg(F.sum(F.length("text") + 1).alias("n")).collect()
    n = {r.s: r.n for r in got}
    assert "" not in n and 2 < n["b"] / n["a"] < 4.5
    assert mixing.mixed(empty).count() == 0
    c = spark.createDataFrame([(3.0,)], "m double").select(mixing.poisson_table(F.col("m")).alias("t")).first().t
    assert np.allclose(c[:5], np.cumsum([math.exp(-3) * 3**k / math.factorial(k) for k in range(5)]))


def test_mixing_partitions(spark, monkeypatch):
    """The partitions of the result follow its characters."""
    monkeypatch.setattr(mixing, "PARTITION_CHARS", 1000)
    df = spark.createDataFrame([(i, "x" * 99, "a") for i in range(300)], "doc_id long, text string, source string")
    assert mixing.mixed(df).rdd.getNumPartitions() == 30


def test_mixing_many_large_means(spark):
    """Many small sources beside a large one: their means are in the thousands, and no table of them is made."""
    rows = [(i, "x", f"s{i}") for i in range(2000)]
    df = spark.createDataFrame(rows + [(9999, "y" * 50_000_000, "big")], "doc_id long, text string, source string")
    rates = mixing.source_rates(df, None, 0.5, 1.0)
    assert rates.where("__cdf IS NOT NULL").count() <= 1 and rates.where("__rate > 500").count() == 2000
    got = mixing.mixed(df.where("source <> 'big'"), {f"s{i}": 0.9 if i == 0 else 0.0001 for i in range(0, 2000, 500)}, epochs=3.0)
    n = {r.source: r.n for r in got.groupBy("source").agg(F.max("n_copies").alias("n")).collect()}
    assert 0.9 * 6000 * 0.9 < n["s0"] < 0.9 * 6000 * 1.1


def test_mixing_large_mean(spark):
    """A source of little text in a large table: its mean is above what a table of the distribution holds."""
    rows = [(1, "x" * 60_000, "a"), (2, None, None), (3, "", "b")]
    got = {(r.doc_id, r.n_copies): r for r in mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), {"": 0.4, "b": 0.05}).groupBy("doc_id", "n_copies").agg(F.count("*").alias("n"), F.countDistinct("copy").alias("d"), F.min("copy").alias("low"), F.max("copy").alias("high")).collect()}
    for d, w in ((2, 0.4), (3, 0.05)):
        mean = w * 60_003
        u = (int(hashlib.md5(f"17:{d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, lp, c = 0, -mean, math.exp(-mean)
        while c < u:
            k += 1
            lp += math.log(mean / k)
            c += math.exp(lp)
        r = got[d, k]
        assert (r.n, r.d, r.low, r.high) == (k, k, 1, k)
    assert mixing.MOST < 0.4 * 60_003


def ids_of(text):
    return [*Encoder.of(default_tokenizer()).tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_encoder():
    e = Encoder.of(default_tokenizer())
    for text in ["a  b\n\n c's 're 12,3!!  x　y\t\tz <|endoftext|> q<|endoftext|>r ᠎ a", " ", "\n", "a ", "  a  ", " 's it's", "Über\nÉté, naïve... \r\n x", "\n a", "a.b ,c"] + [t for _, t, *_ in made() if t]:
        assert e.encode(*words.utf8(pa.array([text, None])))[0].tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_cuts():
    """Strings of characters at which the pattern may or may not cut, against whole texts."""
    e, r = Encoder.of(default_tokenizer()), random.Random(8)
    parts = ["a", "The", " ", "  ", "\n", "\t", "\r\n", "'", "'s", "'re", "7", "٣", ".", "!?", "é", "×", "ÿ", "ж", "中", "ア", "😀", "\xa0", "\u2003", "\u200b", "\u2028", "\u3000", "’", "—", "…", "\ufeff", "\x00", "\x1c", "\x85", "\u180e", "ˀ", "\u0301", "<|endoftext|>", "<|endof", "text|>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(6000)]
    ids, sizes = e.encode(*words.utf8(pa.array(texts)))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert e.by_piece and e.keys.n


def test_encoder_without_cuts():
    """A tokenizer with another pattern gets whole texts."""
    import public_tokenizers

    e = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Some Words,  and more", "", "x"]
    ids, sizes = e.encode(*words.utf8(pa.array(texts)))
    assert not e.by_piece and [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_of_one_id(spark, tmp_path, monkeypatch):
    """Rows without an id, or with one, fill as many ranges as they need, and places follow the ranges."""
    rows = [(None, f"text {i % 40} " * 5) for i in range(400)] + [(3, f"more {i}") for i in range(200)] + [(4, None), (5, "last")]
    folder = scratch(spark, "tokens")
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), folder, default_tokenizer())
    files = token_files.manifest(spark, folder).orderBy("name").collect()
    assert max(f.n_docs for f in files) < 400 and sum(f.n_nulls for f in files) == 400
    got = sorted(token_files.read(spark, folder, slice_docs=37).collect(), key=lambda x: x.start)
    assert [x.start for x in got] == [0, *np.cumsum([x.n_tokens for x in got])[:-1].tolist()]
    assert [x.doc_id for x in got] == [None] * 400 + [3] * 200 + [4, 5]
    want = Counter((d, np.array(ids_of(t), "<u4").tobytes()) for d, t in rows)
    assert Counter((x.doc_id, bytes(x.ids)) for x in got) == want


def test_packing_of_one_id(spark, monkeypatch):
    """Repeated rows and rows without an id spread over shards, and each is packed."""
    monkeypatch.setattr(packing, "SHARD_DOCS", 100)
    rows = [(None, "a b c")] * 300 + [(1, "d e")] * 300
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), default_tokenizer(), tokens=64).collect()
    assert Counter(x.doc_id for x in got) == Counter({None: 300, 1: 300})
    shards = Counter(x.sequence_id >> 32 for x in got)
    assert len(shards) == 6 and max(shards.values()) < 250


def test_token_files(spark, docs, empty):
    folder = scratch(spark, "t")
    token_files.write(docs.union(spark.createDataFrame([(None, "no id", "", "", "", 1)], SCHEMA)), folder, default_tokenizer())
    got = sorted(token_files.read(spark, folder).collect(), key=lambda r: r.start)
    start = 0
    for r, (d, text, *_) in zip(got, [(None, "no id"), *made()], strict=True):
        ids = np.array(ids_of(text), "<u4")
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (d, start, len(ids), ids.tobytes())
        start += len(ids)
    folder = scratch(spark, "t")
    token_files.write(empty, folder, default_tokenizer())
    assert token_files.read(spark, folder).count() == 0


def test_token_file_slices(spark):
    """Small ranges, files read by few documents at a time, repeated rows, and the smallest doc_id beside null ones."""
    rows = [(None, "a"), (None, "b"), (-(1 << 63), "c d"), *((i // 2, f"text number {i // 4} " * (i % 7)) for i in range(200))]
    folder = scratch(spark, "t")
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), folder, default_tokenizer(), range_bytes=400)
    assert token_files.manifest(spark, folder).count() > 12
    got = sorted(token_files.read(spark, folder, slice_docs=3).collect(), key=lambda r: r.start)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start = 0
    for r, (d, text) in zip(got, want, strict=True):
        ids = np.array(ids_of(text), "<u4")
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (d, start, len(ids), ids.tobytes())
        start += len(ids)


def test_token_numbers(tmp_path, monkeypatch):
    """Places of a file are read alike by memory map and from a store."""
    np.arange(50, dtype="<u2").tofile(tmp_path / "x.bin")
    assert token_files.Numbers(str(tmp_path), "x", "bin", "<u2")[7:12].tolist() == [7, 8, 9, 10, 11]
    store = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    monkeypatch.setattr(token_files, "place", lambda uri: (store, "x.bin"))
    assert token_files.Numbers("", "x", "bin", "<u2")[7:12].tolist() == [7, 8, 9, 10, 11]


def test_packing(spark, docs, empty):
    for rule, more in (("norm", {}), ("dot", {"documents": 3, "attention": 40_000})):
        got = packing.packed(docs.union(docs.where("doc_id = 1")), default_tokenizer(), tokens=256, rule=rule, **more).collect()
        most = min(256, math.isqrt(more.get("attention", 256 * 256)))
        by, sequences = defaultdict(list), defaultdict(list)
        for x in got:
            by[x.doc_id].append(x)
            sequences[x.sequence_id].append((x.offset, x.length))
        for d, text, *_ in made():
            ids = np.array(ids_of(text), "<u4")
            copies = 2 if d == 1 else 1
            pieces = sorted(by[d], key=lambda x: x.start)[::copies]
            assert len(by[d]) == copies * len(pieces)
            assert b"".join(bytes(x.ids) for x in pieces) == ids.tobytes() and all(x.length == most for x in pieces[1:])
            assert [x.piece for x in pieces] == list(range(len(pieces))) and (len(ids) > most or len(pieces) == 1)
        for s in sequences.values():
            s.sort()
            assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(n for _, n in s) <= 256
            assert len(s) <= more.get("documents", 256) and sum(n * n for _, n in s) <= more.get("attention", 256 * 256)
    assert packing.packed(empty, default_tokenizer()).count() == 0


def test_licenses(spark, empty):
    mit = licenses.KNOWN["MIT"][0]
    rows = [(1, "Copyright (c) 2020 A. Person\n\n" + mit.upper().replace(" ", "  ")), (2, "words\nReleased under the MIT Licence.\nmore\nLicensed under CC BY-NC 4.0"), (3, mit + " but not"), (4, None), (5, ""), (2, "words\nReleased under the MIT Licence.\nmore\nLicensed under CC BY-NC 4.0"), (None, "MIT")]
    got = sorted((x.doc_id or 0, x.license_id, x.line_licenses, x.n_license_lines) for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, None, "", 0), (1, "MIT", "", 0), (2, None, "CC-BY-NC-4.0,MIT", 2), (2, None, "CC-BY-NC-4.0,MIT", 2), (3, None, "", 0), (4, None, "", 0), (5, None, "", 0)]
    assert licenses.scan(empty).count() == 0


def test_whole_licenses(spark):
    """The whole text of each id that has one, with other line breaks and a named copyright line."""
    files = sorted(Path(licenses.__file__).parent.glob("licenses_full/*.txt"))
    rows = [(i, "# Copyright Jane Q. Doe and others, 2019-2021.\n" + re.sub(r"(?<=[a-z,]) +(?=[a-z])", "   ", f.read_text("utf-8")).replace("\n", " \n  ")) for i, f in enumerate(files)]
    rows.append((len(files), "Copyright The Foo Authors (2014)\n\n" + licenses.KNOWN["MIT"][0]))
    got = {x.doc_id: x.license_id for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(files) >= 15 and got == dict(enumerate([*(f.stem for f in files), "MIT"]))


def test_embeddings(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 16))
    x[100:180] = x[5] + 0.15 * r.normal(size=(80, 16))
    x[200:220] = x[200]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x.astype(np.float32))] + [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [None] * 16), (304, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n_links", F.lit(1))
    got = {v.vec_id: v for v in embedding_dedup.dedup(df).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    true = u @ u.T >= 0.9
    np.fill_diagonal(true, False)
    sets = Sets(range(305))
    for a, b in zip(*np.nonzero(true)):
        sets.join(int(a), int(b))
    assert sum(v.n_links for v in got.values()) >= 0.95 * true.sum() and all(got[i].n_links <= true[i].sum() for i in range(300))
    assert all(got[i].component_id == sets.root(i) and got[i].kept == (sets.root(i) == i) for i in range(305))
    assert embedding_dedup.dedup(df.where("false")).count() == 0


def shard_of(groups):
    r = np.random.default_rng(4)
    x = np.concatenate([c + 0.02 * r.normal(size=(n, 16)) for n in groups for c in [r.normal(size=16)]])
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("groups", [[1] * 1500 + [2] * 60, [800] + [1] * 500 + [2] * 60])
def test_embedding_audit(groups):
    """Lost links of pairs fail the audit, be they few beside single vectors or beside one large group."""
    x = shard_of(groups)
    g = hnsw.Graph(x)
    alone = np.arange(len(x) - 120, len(x))
    g.near = lambda q, least, beam, near=g.near: near(q, least, beam) if getattr(g, "exact", False) else lossy(near(q, least, beam), q)

    def lossy(found, q):  # every fifth link of a pair is not found
        a, b = found
        own = np.argmax(q @ x.T, 1)[a]
        keep = (own == b) | ~np.isin(b, alone) | (b % 5 > 0)
        return a[keep], b[keep]

    g.audit(0.95, 0.99, 512)
    a, b = g.near(x, 0.95, g.beam)
    assert set(zip(a.tolist(), b.tolist())) == set(zip(*(v.tolist() for v in np.nonzero(x @ x.T >= 0.95))))


class Shard:
    def __init__(self, x, first):
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        self.ids, self.weights, self.unit, self.graph = np.arange(first, first + len(x)), np.ones(len(x), np.int64), x, hnsw.Graph(x.astype(np.float32))


def two_shards(dim, n=500):
    r = np.random.default_rng(dim)
    centres = r.normal(size=(60, dim))
    make = lambda: np.concatenate([r.normal(size=(n, dim)), centres + 0.05 * r.normal(size=(60, dim))])
    return Shard(make(), 0), Shard(make(), 1000)


@pytest.mark.parametrize("dim, gathered", [(16, 1 << 25), (768, 1 << 16)])
def test_links_between_shards(monkeypatch, dim, gathered):
    """Blocks are bounded by bytes, whatever the dimension, and an audit that fails makes the search whole."""
    monkeypatch.setattr(embedding_dedup, "GATHERED", gathered)
    p, q = two_shards(dim)
    true = (p.unit @ q.unit.T >= 0.9).astype(int)
    assert embedding_dedup.audited(p, q, 0.9) >= 0.99 and not q.graph.exact
    for _ in range(2):
        weight, labels = embedding_dedup.linked(p, q, 0.9)
        assert np.array_equal(weight, np.append(true.sum(1), true.sum(0))) and true.sum() >= 60
        assert (labels[560:][true.any(0)] < 560).all() and (labels[560:][~true.any(0)] >= 560).all()
        # a graph that loses every third link
        whole = q.graph.near
        q.graph.near = lambda v, least, beam, whole=whole: whole(v, least, beam) if q.graph.exact else tuple(x[np.arange(len(x)) % 3 > 0] for x in whole(v, least, beam))
        assert embedding_dedup.audited(p, q, 0.9) == 1.0 and q.graph.exact and p.graph.exact


def test_audit_cost(monkeypatch):
    """Where hardly any vector has neighbours, brute force stops at its bound."""
    monkeypatch.setattr(hnsw, "BRUTE_FORCED", 512)
    x = shard_of([1] * 3000 + [2] * 20)
    g, compared = hnsw.Graph(x), []
    g._all = lambda q, least, all_=g._all: compared.append(len(q)) or all_(q, least)
    assert g.audit(0.95, 0.99, 512) >= 0.99 and sum(compared) == 512
    a, b = g.near(x, 0.95, g.beam)
    true = x @ x.T >= 0.95
    assert true[a, b].sum() >= 0.99 * true.sum()


def test_embedding_ids(spark):
    """Rows without an id link with nothing, and repeated rows count each."""
    near = [[1.0, 0.0, 0.1], [1.0, 0.02, 0.1], [0.0, 1.0, 0.0]]
    rows = [(5, near[0]), (5, near[0]), (3, near[1]), (None, near[0]), (None, near[0]), (None, None), (7, near[2]), (8, [-0.0, 1.0, 0.0]), (9, []), (10, [0.0] * 3)]
    got = Counter((x.vec_id, x.n_links, x.component_id, x.kept) for x in embedding_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    want = Counter({(5, 2, 3, False): 2, (3, 2, 3, True): 1, (None, 0, None, True): 3, (7, 1, 7, True): 1, (8, 1, 7, False): 1, (9, 0, 9, True): 1, (10, 0, 10, True): 1})
    assert got == want


def test_dual_descent():
    """The hinge-loss fit against projected gradient steps on the whole dual: the same objective."""
    r = np.random.default_rng(5)
    n, size = 60, 25
    rows = [np.flatnonzero(r.random(size) < 0.3).astype(np.int32) for _ in range(n)]
    scale, y, cost = r.normal(size=size), np.where(r.random(n) < 0.5, 1.0, -1.0), r.uniform(0.05, 0.5, n)
    w, bias = nbsvm.dual_descent(rows, scale, y, cost, epochs=2000)
    x = np.zeros((n, size + 1))
    x[:, -1] = 1
    for i, f in enumerate(rows):
        x[i, f] = scale[f]
    v = np.append(w, bias)
    q = (y[:, None] * x) @ (y[:, None] * x).T
    alpha, step = np.zeros(n), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(20_000):
        alpha = np.clip(alpha + step * (1 - q @ alpha), 0, cost)
    assert v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum() == pytest.approx(alpha.sum() - alpha @ q @ alpha / 2, rel=1e-3)


def test_log_ratios():
    """Two features, each in both texts of one class: shares 3 and 1 of one sum, weights at their bound."""
    model = nbsvm.fit([np.array([f], np.int32) for f in (0, 0, 1, 1)], np.array([1, 1, 0, 0]))
    assert model.weight[0] == pytest.approx(0.2 * math.log(3) ** 2, rel=1e-5) and model.weight[1] == pytest.approx(-model.weight[0], rel=1e-5)
    assert not model.weight[2:].any()


def test_features():
    """Features are the distinct runs of one to three words and word shapes: as many, and the same where those are the same."""
    texts = [t or "" for _, t, *_ in made(n=40)] + ["A1 a1 B2!", "é1 ab ab ab", "A-B a-b", "x" * 5000]

    def shape(word, again):
        if again:
            return "again"
        kinds = ["0" if c in "0123456789" else "A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" or ord(c) > 127 else c for c in word]
        return "".join(k for i, k in enumerate(kinds) if i == 0 or k != kinds[i - 1] or k not in "0Aa")

    def grams(text):
        words = WORD.findall(text)
        lower = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
        shapes = [shape(w, i > 0 and lower[i] == lower[i - 1]) for i, w in enumerate(words)]
        return {(kind, *x[i : i + n]) for kind, x in (("word", lower), ("shape", shapes)) for n in (1, 2, 3) for i in range(len(x) - n + 1)}

    blob = [t.encode() for t in texts]
    f, at = nbsvm.features(np.frombuffer(b"".join(blob), np.uint8), np.append(0, np.cumsum([len(b) for b in blob])))
    mine = [set(f[a:b].tolist()) for a, b in zip(at[:-1], at[1:])]
    want = [grams(t) for t in texts]
    assert f.max() < 1 << nbsvm.BITS and all(len(m) <= len(w) for m, w in zip(mine, want))
    assert sum(map(len, mine)) > 0.99 * sum(map(len, want))  # a few share a bucket
    where = defaultdict(set)
    for i, m in enumerate(mine):
        for x in m:
            where[x].add(i)
    texts_of = defaultdict(set)
    for i, w in enumerate(want):
        for x in w:
            texts_of[x].add(i)
    sets = Counter(map(frozenset, texts_of.values()))
    assert sum((Counter(map(frozenset, where.values())) - sets).values()) < 0.01 * len(texts_of)


def test_fit_bytes(spark):
    """Texts beyond the bound of bytes are left out of the fit, and scored all the same."""
    rows = [(i, ("good " if i % 2 else "BAD! ") * 30, i % 2) for i in range(300)] + [(1000, "BAD! " * 100_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = nbsvm.train(df, df, fit_bytes=20_000)
    got = {x.doc_id: x.predicted for x in nbsvm.score(df, model).collect()}
    assert all(got[i] == i % 2 for i in range(300)) and got[1000] == 0


def test_classifier_edges(spark, docs, empty):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    model = nbsvm.train(docs, labels)
    rows = docs.union(docs.where("doc_id < 3")).withColumns({"score": F.lit("own"), "label": F.lit(1)})
    got = Counter(x.doc_id for x in nbsvm.score(rows, model).collect())
    assert got == Counter({d: 2 if d < 3 else 1 for d, *_ in made()})
    assert nbsvm.score(empty, model).count() == 0


def test_clashing_columns(spark):
    names = ["gone", "own", "__source", "__rate", "__cdf", "__block", "copies", "lines"]
    df = spark.createDataFrame([(1, "one line here\none line here", "a"), (1, "one line here\none line here", "a")], "doc_id int, text string, source string").withColumns({n: F.lit(n) for n in names})
    got = line_dedup.dedup(df).collect()
    assert len(got) == 2 and all(r.text == "one line here" and r.n_removed == 1 and all(r[n] == n for n in names) for r in got)
    assert all(r[n] == n for r in mixing.mixed(df, epochs=9.0).collect() for n in names)


def test_many_lines(spark):
    """Time in proportion to the lines of a text, of which all but one repeat."""
    text = "the same line again\n" * 60_000 + "and another one"
    row = line_dedup.dedup(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.text, row.n_lines, row.n_removed) == ("the same line again\nand another one", 60_001, 59_999)


def test_embedding_layers():
    """A shard of three layers, saved and loaded: links within it and with another one, by brute force."""
    r = np.random.default_rng(9)
    centres = r.normal(size=(900, 12))
    x = np.concatenate([centres + 0.05 * r.normal(size=centres.shape) for _ in range(22)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    files = {}

    def shard(rows, name):
        g = hnsw.Graph(unit[rows].astype(np.float32))
        g.audit(0.97, 0.99, 256)
        g.save(lambda k, v: files.__setitem__((name, k), v))
        s = embedding_dedup._Shard.__new__(embedding_dedup._Shard)
        s.ids, s.weights, s.unit, s.graph = rows, np.full(len(rows), 2), unit[rows], hnsw.Graph.load(lambda k: files[name, k])
        return s

    p, q = shard(np.arange(0, 18_000), "p"), shard(np.arange(18_000, len(x)), "q")
    assert len(p.graph.sizes) == 3 or len(p.graph.sizes) == 2
    for one, two in ((q, q), (p, q)):
        weight, labels = embedding_dedup.linked(one, two, 0.97)
        a, b = one.unit, two.unit
        true = a @ b.T >= 0.97
        if one is two:
            np.fill_diagonal(true, False)
        want = 2 * (true.sum(1) if one is two else np.concatenate([true.sum(1), true.sum(0)]))
        assert weight.sum() >= 0.97 * want.sum() and (weight <= want).all()


def within(a, b, k):
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    if not a or not b:
        return len(a) + len(b) <= k
    return k > 0 and (within(a[1:], b, k - 1) or within(a, b[1:], k - 1) or within(a[1:], b[1:], k - 1))


def test_pipeline(spark, tmp_path):
    """All five stages in plain Python."""
    rows = [(d, t, lang, s, n) for d, t, _, s, lang, n in made(seed=11, n=90)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    texts, source = {}, {}
    for d, t, _, s, _ in rows:  # quality rules
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        c = Counter(zip(w, w[1:], w[2:]))
        cover = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        m = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(ch in "#*$%&|<>" for ch in t), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(cover), "n_lines": len(lines), "n_upper": sum("A" <= ch <= "Z" for ch in t), "n_letters": len(re.findall("[A-Za-z]", t))}
        if not any(eval(fails.replace("AND", "and"), m) for _, fails in quality_rules.RULES):
            texts[d], source[d] = t, s or ""
    refs = defaultdict(list)
    for d, t in texts.items():  # lines
        for i, x in enumerate(t.split("\n")):
            if WORD.search(x):
                refs[x].append((d, i))
    lines, u = sorted(refs), Sets(refs)
    for i, a in enumerate(lines):
        for b in lines[:i]:
            k = min(2, min(len(a), len(b)) // 10)
            if abs(len(a) - len(b)) <= k and within(a, b, k):
                u.join(a, b)
    classes = defaultdict(list)
    for x in lines:
        classes[u.root(x)] += refs[x]
    gone = {ref for c in classes.values() for ref in sorted(c)[1:]}
    texts = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in texts.items()}
    texts = {d: t for d, t in texts.items() if WORD.search(t)}
    sets, u = {}, Sets(texts)  # near duplicates
    for d, t in texts.items():
        w = WORD.findall(t.translate({i: i + 32 for i in range(65, 91)}))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                u.join(a, b)
    texts = {d: t for d, t in texts.items() if u.root(d) == d}
    mass = Counter()  # mixing
    for d, t in texts.items():
        mass[source[d]] += len(t) + 1
    root = sum(math.sqrt(m) for m in mass.values())
    want = {}
    for d, t in texts.items():
        mean = math.sqrt(mass[source[d]]) / root * sum(mass.values()) / mass[source[d]]
        p = (int(hashlib.md5(f"17:{d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        n, term, c = 0, math.exp(-mean), math.exp(-mean)
        while c < p:
            n += 1
            term *= mean / n
            c += term
        if n:
            want[d] = n * len(ids_of(t))
    sizes, places = Counter(), defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        sizes[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert sizes == want and 10 < len(want) < 90
    for s in places.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(n for _, n in s) <= 2048


def test_pipeline_edges(spark, tmp_path):
    """No row, and rows of which none is kept."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for i, rows in enumerate([[], [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0)]]):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{i}/documents.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{i}").count() == 0
