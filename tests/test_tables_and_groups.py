"""Versioned tables, grouping sets, frames, sketches and variants against brute-force versions."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomspark.functions.variants import document, field, shape
from loomspark.operators import groups
from loomspark.operators.groups import cube_sets, grouping_sets, merged, rollup_sets, sketches, top_rows, trailing
from loomspark.sources.versioned import Conflict, VersionedTables


def counted(df):
    return Counter(map(tuple, df.collect()))


ACCOUNT = "k BIGINT, v BIGINT, note STRING"


def accounts(spark, rows):
    return spark.createDataFrame(rows, ACCOUNT)


def test_merge(spark):
    """Random merges, updates and deletes against a dictionary; each is one version, and old ones stay readable."""
    r = random.Random(3)
    tables, mine, history = VersionedTables(spark), {}, []
    with tables.transaction() as t:
        t.create("a", accounts(spark, []), ["k"], buckets=3)
    for step in range(6):
        new = {k: r.randint(0, 9) for k in r.sample(range(12), r.choice([0, 1, 5]))}
        with tables.transaction() as t:
            t.merge("a", spark.createDataFrame(list(new.items()), "k INT, v INT"), matched={"v": F.col("t.v") + F.col("s.v"), "note": F.lit(f"m{step}")}, delete=F.col("s.v") == 9)
            if step % 2:
                t.update("a", F.col("v") > 8, {"v": F.lit(0), "note": F.concat(F.lit("was "), F.col("v").cast("string"))})
                t.delete("a", F.col("v") == 1)
        for k, v in new.items():
            if k not in mine:
                mine[k] = (v, None)
            elif v == 9:
                del mine[k]
            else:
                mine[k] = (mine[k][0] + v, f"m{step}")
        if step % 2:
            mine = {k: (0, f"was {v}") if v > 8 else (v, n) for k, (v, n) in mine.items()}
            mine = {k: x for k, x in mine.items() if x[0] != 1}
        history.append((tables.version(), dict(mine)))
        assert counted(tables.read("a")) == Counter((k, *x) for k, x in mine.items())
    assert len({v for v, _ in history}) == 6
    for version, then in history:
        assert counted(tables.read("a", version)) == Counter((k, *x) for k, x in then.items())
    tables.vacuum()
    assert counted(VersionedTables(spark, tables.path).read("a")) == Counter((k, *x) for k, x in mine.items())


def test_merge_of_nulls_and_repeats(spark):
    tables = VersionedTables(spark)
    with tables.transaction() as t:
        t.create("a", accounts(spark, [(None, 1, "x"), (None, 1, "x"), (1, 1, None), (1, 2, None), (2, None, "z")]), ["k"])
    with tables.transaction() as t:
        t.merge("a", accounts(spark, [(None, 5, "n"), (1, 7, "s"), (3, 3, "new")]), matched={"v": F.col("s.v")})
        t.delete("a", F.col("v") > 100)  # nothing
        t.update("a", F.col("v") == 5, {"note": F.col("v")})
    # null keys match nothing, repeated keys of the table all match, and a null condition leaves a row
    assert counted(tables.read("a")) == Counter({(None, 1, "x"): 2, (None, 5, "5"): 1, (1, 7, None): 2, (2, None, "z"): 1, (3, 3, "new"): 1})
    before = tables.version()
    with pytest.raises(ValueError), tables.transaction() as t:
        t.insert("a", accounts(spark, [(8, 8, "lost")]))
        t.merge("a", accounts(spark, [(1, 0, "a"), (1, 1, "b")]), matched={"v": F.col("s.v")})
    assert tables.version() == before and tables.read("a").where("k = 8").count() == 0
    with pytest.raises(ValueError), tables.transaction() as t:
        t.update("a", F.lit(True), {"k": F.lit(1)})
    with pytest.raises(ValueError), tables.transaction() as t:
        t.create("a", accounts(spark, []), ["k"])


def test_only_touched_buckets_are_written(spark):
    tables = VersionedTables(spark)
    with tables.transaction() as t:
        t.create("a", accounts(spark, [(i, i, None) for i in range(100)]), ["k"], buckets=10)
    before = tables.manifest()["a"]["buckets"]
    with tables.transaction() as t:
        t.merge("a", accounts(spark, [(5, 0, None)]), matched={"v": F.lit(-1)})
    after = tables.manifest()["a"]["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1 and len(before) == len(after) == 10
    assert tables.read("a").where("v = -1").count() == 1 and tables.read("a").count() == 100


def test_transaction_over_tables(spark):
    """Both tables change or neither does, and of two writers the second one to commit fails."""
    tables = VersionedTables(spark)
    with tables.transaction() as t:
        t.create("a", accounts(spark, [(1, 1, None)]), ["k"])
        t.create("b", accounts(spark, []), ["k"])
    with pytest.raises(ZeroDivisionError), tables.transaction() as t:
        t.insert("b", t.read("a"))
        t.delete("a", F.lit(True))
        assert t.read("a").count() == 0 and t.read("b").count() == 1 and tables.read("a").count() == 1
        1 / 0
    assert tables.version() == 1 and tables.read("b").count() == 0
    with pytest.raises(Conflict), tables.transaction() as late:
        late.delete("a", F.lit(True))
        with tables.transaction() as t:
            t.insert("b", t.read("a"))
    assert tables.version() == 2 and tables.read("a").count() == 1 == tables.read("b").count()
    assert len(tables._names("data")) == 3  # of two tables made and one insert; those of what failed are gone
    with tables.transaction() as t:
        t.drop("b")
    assert set(tables.manifest()) == {"a"}


@pytest.mark.parametrize("sets", [rollup_sets(["a", "b"]), cube_sets(["a", "b"]), [["a"], ["b"]]])
def test_grouping_sets(spark, sets):
    r = random.Random(1)
    rows = [(r.choice(["x", "y", None]), r.choice([1, 2, None]), r.choice([None, 1, 2, 3]), r.choice([None, "p", "q"])) for _ in range(60)]
    df = spark.createDataFrame(rows, "a STRING, b INT, v INT, d STRING")
    got = grouping_sets(df, sets, sums={"v": F.col("v"), "n": F.lit(1)}, distinct={"ds": "d"}).select("a", "b", "grouping_id", "v", "n", "ds")
    want = Counter()
    for s in sets:
        parts = defaultdict(list)
        for row in rows:
            parts[(row[0] if "a" in s else None, row[1] if "b" in s else None)].append(row)
        for k, part in parts.items():
            v = [x[2] for x in part if x[2] is not None]
            want[(*k, 2 * ("a" not in s) + ("b" not in s), sum(v) if v else None, len(part), len({x[3] for x in part} - {None}))] += 1
    assert counted(got) == want
    assert grouping_sets(df.limit(0), sets, sums={"n": F.lit(1)}).count() == 0


@pytest.mark.parametrize("slice_", [3, 10, None])
def test_trailing(spark, slice_):
    r = random.Random(2)
    rows = [(i, r.choice([None, 1, 1, 1, 2]), r.choice([None, *range(-20, 60)]), r.choice([None, 1, 5])) for i in range(150)]
    df = spark.createDataFrame(rows, "id INT, u INT, t INT, v INT").repartition(4)
    got = trailing(df, by=["u"], time="t", before=7, slice_=slice_, aggregates={"n": F.count("*"), "s": F.sum("v")})
    want = Counter()
    for i, u, t, v in rows:
        seen = [x for x in rows if x[1] == u and ((t is None and x[2] is None) or (None not in (t, x[2]) and t - 7 <= x[2] <= t))]
        vs = [x[3] for x in seen if x[3] is not None]
        want[(i, u, t, v, len(seen), sum(vs) if vs else None)] += 1
    assert counted(got) == want


def test_top_rows(spark):
    rows = [(i, i % 3 if i % 5 else None, i // 4) for i in range(90)]
    got = top_rows(spark.createDataFrame(rows, "id INT, u INT, v INT"), by=["u"], order=[F.desc("v"), F.col("id")], k=4)
    parts = defaultdict(list)
    for i, u, v in rows:
        parts[u].append((-v, i))
    assert counted(got.select("u", "id", "rank")) == Counter((u, i, n) for u, p in parts.items() for n, (_, i) in enumerate(sorted(p)[:4], 1))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # tasks pass on few rows of a key


def test_sketches(spark):
    """Merged sketches are within their bounds of the exact values, of nulls and of one key with most rows too."""
    df = spark.range(60_000).select((F.col("id") % 30).alias("day"), F.when(F.col("id") % 7 > 0, F.col("id") % 9_000).alias("u"), F.when(F.col("id") % 3 > 0, F.col("id").cast("double")).alias("v"))
    df = df.withColumn("day", F.when(F.col("day") < 20, 0).otherwise(F.col("day")))
    days = sketches(df, by=[F.col("day")], distinct="u", value="v")
    got = merged(days, by=[(F.col("day") > 25).alias("late")]).select("late", "n", F.hll_sketch_estimate("distinct_sketch").alias("u"), F.expr("kll_sketch_get_quantile_double(value_sketch, 0.25D)").alias("v"))
    for r in got.collect():
        mine = df.where((F.col("day") > 25) == r.late)
        exact = mine.agg(F.count_distinct("u"), F.count("*"), F.avg((F.col("v") <= r.v).cast("int"))).first()
        assert abs(r.u - exact[0]) <= 3 * groups.HLL_ERROR * exact[0] and r.n == exact[1]
        assert abs(exact[2] - 0.25) <= groups.KLL_ERROR + 1e-3


def test_variants(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": [1, {"c": "x"}]}'), (2, '{"a": "one", "b": null}'), (3, None), (4, "[1.5, true]"), (5, '"text"')], "id INT, s STRING").select("id", document(F.col("s")).alias("d"))
    got = {r.id: r[1:] for r in df.select("id", field(F.col("d"), "$.a", "int"), field(F.col("d"), "$.a", "string"), field(F.col("d"), "$.b[1].c", "string"), field(F.col("d"), "$[0]", "double")).collect()}
    assert got == {1: (1, "1", "x", None), 2: (None, "one", None, None), 3: (None,) * 4, 4: (None, None, None, 1.5), 5: (None,) * 4}
    assert df.where("id < 3").select(shape(F.col("d"))).first()[0] == "OBJECT<a: VARIANT, b: ARRAY<VARIANT>>"
    with pytest.raises(Exception):
        df.where("id = 2").select(field(F.col("d"), "$.a", "int", strict=True)).collect()
    bad = spark.createDataFrame([("{oops",)], "s STRING")
    assert bad.select(document(F.col("s"), strict=False).cast("string")).first()[0] is None
    with pytest.raises(Exception):
        bad.select(document(F.col("s"))).collect()
