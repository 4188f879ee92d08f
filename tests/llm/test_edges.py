"""Repeated rows, rows without an id, and texts longer than a task takes at once, for operators of earlier rounds."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomspark.llm import jaccard, licenses, mixing, nbsvm, packing, quality_rules, substrings, token_files, words
from loomspark.llm.tokens import default_tokenizer
from loomspark.session import BATCH_BYTES, scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DDL = "doc_id long, text string"


def long_text(seed, n):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéZ#") for _ in range(r.randint(1, 9))) for _ in range(3000)]
    out = [r.choice(vocabulary) + r.choice(["", "", "", "\n", "."]) for _ in range(n)]
    at = r.randrange(n // 2)
    return " ".join(out + out[at : at + 60])


def test_rules_of_long_and_repeated_rows(spark):
    text = long_text(1, 260_000)
    assert len(text.encode()) > words.CHUNK
    rows = [(1, text), (2, "a b c\na b c"), (2, "a b c\na b c"), (2, "other"), (None, "x")]
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.ledger(spark.createDataFrame(rows, DDL)).collect())
    want = Counter()
    for d, t in rows:
        w = WORD.findall(t)
        c = Counter(zip(w, w[1:], w[2:]))
        cover = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[(d, len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(cover))] += 1
    assert got == want


def test_substrings_of_long_and_repeated_rows(spark):
    """Rows of one doc_id are judged against smaller ids and themselves, rows without one against themselves."""
    base = long_text(2, 200_000)
    assert len(base.encode()) > words.CHUNK
    w = base.split()
    part = lambda a, b: " ".join(w[a:b])
    rows = [(1, base), (2, part(500, 560)), (2, part(530, 600) + " end"), (2, part(500, 560)), (3, "new " + part(700, 800)), (None, part(10, 60)), (None, part(10, 60) + " " + part(10, 60)), (4, part(10, 60)), (9, None), (9, "")]
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in substrings.dedup(spark.createDataFrame(rows, DDL).repartition(3)).collect())
    starts: dict[tuple, int] = {}
    for d, t in sorted((x for x in rows if x[0] is not None and x[1]), key=lambda x: x[0]):
        x = t.split()
        for i in range(len(x) - 19):
            starts.setdefault(tuple(x[i : i + 20]), d)
    want = Counter()
    for d, t in rows:
        x, gone, own = (t or "").split(), set(), set()
        for i in range(len(x) - 19):
            k = tuple(x[i : i + 20])
            if k in own or (d is not None and starts[k] < d):
                gone |= set(range(i, i + 20))
            own.add(k)
        want[(d, len(x), len(gone), " ".join(v for i, v in enumerate(x) if i not in gone))] += 1
    assert got == want
    assert substrings.dedup(spark.createDataFrame([], DDL)).count() == 0


def test_mixing_of_repeated_rows(spark):
    """Rows with the same doc_id and source get the same number of copies each."""
    rows = [(i, "text " * (i % 5 + 1), s) for i in range(60) for s in ("a", "b") for _ in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(df, {"a": 0.8, "b": 0.2}, epochs=2.0).groupBy("doc_id", "source", "copy", "n_copies").count().collect()
    assert got and all(r["count"] == 2 for r in got)
    assert all(len({r.n_copies for r in got if (r.doc_id, r.source) == k}) == 1 for k in {(r.doc_id, r.source) for r in got})
    by = Counter((r.doc_id, r.source) for r in got)
    assert all(by[r.doc_id, r.source] == r.n_copies for r in got)


def test_tokens_of_long_texts(spark):
    rows = [(1, long_text(3, 120_000)), (2, "short"), (3, long_text(4, 300))]
    assert len(rows[0][1]) > max(token_files.CHUNK, packing.CHUNK)
    df, tokenizer = spark.createDataFrame(rows, DDL), Tokenizer.from_file(default_tokenizer())
    ids = {d: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4") for d, t in rows}
    folder = scratch(spark, "tokens")
    token_files.write(df, folder, default_tokenizer())
    assert {r.doc_id: bytes(r.ids) for r in token_files.read(spark, folder).collect()} == {d: x.tobytes() for d, x in ids.items()}
    pieces = sorted(packing.packed(df, default_tokenizer()).collect(), key=lambda r: (r.doc_id, r.piece))
    for d, x in ids.items():
        mine = [r for r in pieces if r.doc_id == d]
        assert b"".join(bytes(r.ids) for r in mine) == x.tobytes() and max(r.length for r in mine) <= 2048
        assert [r.start for r in mine] == [0, *np.cumsum([r.length for r in mine])[:-1].tolist()]
    small = packing.packed(df, default_tokenizer(), tokens=2048, documents=2, attention=1_000_000, rule="dot").collect()
    by = Counter(r.sequence_id for r in small)
    assert max(by.values()) <= 2 and sum(r.length for r in small) == sum(map(len, ids.values()))


def test_licenses_in_long_texts(spark):
    """A notice behind two million characters, and columns named like those of the result."""
    line = "Licensed under CC BY-NC 4.0"
    rows = [(1, long_text(5, 300_000) + "\n" + line, "x", 7), (2, "w " * 1_000_000, "x", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, license_id string, n int").withColumns({"digest": F.lit("own"), "lines": F.lit(1), "copies": F.lit(2)})
    got = {r.doc_id: (r.license_id, r.line_licenses, r.n_license_lines) for r in licenses.scan(df).collect()}
    assert got == {1: (None, "CC-BY-NC-4.0", 1), 2: (None, "", 0)}


def test_scores_of_long_texts(spark):
    """A text of more than a task takes at once is scored as a whole, like its twice repeated half."""
    rows = [(i, ("good words here " if i % 2 else "BAD! WORDS! ") * 20, i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = nbsvm.train(df, df)
    half = "good words here " * 70_000
    assert len(half) > words.CHUNK
    got = {r.doc_id: r.score for r in nbsvm.score(spark.createDataFrame([(1, half), (2, half + half), (3, "good words here good")], DDL), model).collect()}
    assert got[1] == pytest.approx(got[2]) and got[1] > 0.5 and all(0 <= s <= 1 for s in got.values())


@pytest.mark.parametrize("operator", [quality_rules.keep, quality_rules.ledger, jaccard.join, lambda docs: packing.packed(docs, default_tokenizer())])
def test_batches_of_texts_are_small(spark, operator):
    session = spark.newSession()  # the setting is the session's
    docs = session.range(3_000, numPartitions=1).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 1000) AS text")
    operator(docs.limit(20))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"size": [b.nbytes], "n": [b.num_rows]})

    got = docs.mapInArrow(sizes, "size long, n long").collect()
    assert sum(r.n for r in got) == 3_000 and max(r.size for r in got) < 2 * BATCH_BYTES


def test_a_bound_on_batches_stays(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    packing.packed(session.createDataFrame([(1, "a b")], "doc_id long, text string"), default_tokenizer())
    assert session.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"
