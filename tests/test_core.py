import sys

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.testing import assertDataFrameEqual

from loomspark.functions import canonical_json, decode, encode, health, same_document, unique_name
from loomspark.operators import assert_key, insert_returning, key_violations, with_serial
from loomspark.plans.queries import ORACLE, QUERIES, flagship
from loomspark.session import scratch
from loomspark.sources import SessionTable, jdbc_reader, kafka_reader_options, kafka_writer_options, point_lookup, scalar
from loomspark.streaming import Log, await_or_fail

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def rows(df):
    return sorted(map(repr, ([dict(sorted(r.asDict().items())) for r in df.collect()])))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES.split():
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(ORACLE[name])
    names = want.columns
    got = QUERIES[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert rows(got) == sorted(repr(dict(sorted(zip(names, r)))) for r in want.fetchall())


def test_toolchain(spark):
    assert sys.version_info[:2] == (3, 13) and spark.version.startswith("4.")
    assert health(spark).collect()[0].status == "ok"
    assert spark.range(1).select(unique_name().alias("n")).first().n.startswith("smoke-")


def test_flagship(spark):
    assert {r.event_type for r in flagship(spark, SF).collect()} == {"error"}


def test_relational_round_trip(spark):
    table = SessionTable(spark, "smoke", "id INT, value STRING")
    keyed = insert_returning(table, spark.createDataFrame([("ok",)], "value STRING"), ["value"])
    key = scalar(keyed.select("id"))
    assert scalar(point_lookup(table.df(), "id", key, ["value"])) == "ok"
    again = insert_returning(table, spark.createDataFrame([("b",), (None,), ("b",)], "value STRING"), ["value"])
    assert sorted(r.id for r in again.collect()) == [2, 3, 4]
    table.insert(["id"], [9])
    assert table.df().where("id = 9 AND value IS NULL").count() == 1
    assert scalar(point_lookup(table.df(), "id", 77, ["value"])) is None
    assert insert_returning(table, spark.createDataFrame([], "value STRING"), ["value"]).count() == 0
    with pytest.raises(ValueError):
        table.append(spark.createDataFrame([(1,)], "other INT"))
    assert "smoke" not in [t.name for t in spark.newSession().catalog.listTables()]
    table.drop()


def test_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d")], "k INT, v STRING")
    assert {(r.k, r.n_rows) for r in key_violations(df, ["k"]).collect()} == {(1, 2), (None, 1)}
    with pytest.raises(ValueError):
        assert_key(df, ["k"])
    assert assert_key(df.where("k = 2"), ["k"]).count() == 1
    ids = with_serial(spark.range(1000).selectExpr("id AS x"), ["x"], start=5).collect()
    assert sorted((r.x, r.id) for r in ids) == [(i, i + 5) for i in range(1000)]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet=st.characters(exclude_categories=["Cs"])), st.integers(-(2**31), 2**31 - 1)), min_size=1, max_size=5))
def test_json_round_trip(spark, values):
    df = spark.createDataFrame(values, "a STRING, b INT")
    back = df.select(decode(encode("a", "b"), "a STRING, b INT").alias("v")).select("v.*")
    assertDataFrameEqual(back, df)


def test_json_strictness(spark):
    one = lambda b: spark.createDataFrame([(b,)], "v BINARY")
    for bad in (b"{oops", b"", b'{"a":"x"} trailing', b'{"a":"\xff"}'):
        with pytest.raises(Exception):
            one(bad).select(canonical_json(F.col("v"))).collect()
        with pytest.raises(Exception):
            one(bad).select(decode(F.col("v"), "a STRING", "strict")).collect()
    assert one(b'{"a":"x"} trailing').select(decode(F.col("v"), "a STRING")["a"].alias("a")).first().a == "x"
    with pytest.raises(Exception):
        one(b"{'a':'x'}").select(decode(F.col("v"), "a STRING")).collect()
    assert one(b"{oops").select(decode(F.col("v"), "a STRING", "permissive")["a"].alias("a")).first().a is None
    pair = spark.createDataFrame([(b'{"a":1,"b":2}', b'{ "b":2, "a":1}', b'{"a":1,"b":2,"c":3}')], "x BINARY, y BINARY, z BINARY")
    assert tuple(pair.select(same_document(F.col("x"), F.col("y")), same_document(F.col("x"), F.col("z"))).first()) == (True, False)


def test_log_round_trip(spark):
    log = Log(spark, "smoke", 2)
    sink, group = scratch(spark, "sink"), scratch(spark, "group")
    send = lambda *v: log.produce(spark.createDataFrame([(i, x.encode(), i % 2) for i, x in enumerate(v)], "i INT, value BINARY, p INT"), "value", ["i"], partition="p")
    send("a", "b", "c")
    assert {(r.partition, r.offset, bytes(r.value)) for r in log.consume(sink, group).collect()} == {(0, 0, b"a"), (1, 0, b"b"), (0, 1, b"c")}
    send("d")
    other = log.consume(scratch(spark, "sink"), scratch(spark, "group"))
    assert log.consume(sink, group).count() == 4 == other.count()
    assert {(r.partition, r.offset) for r in log.read().where("value = X'64'").collect()} == {(0, 2)}
    log.delete()


def test_deadline(spark):
    log = Log(spark, "empty")
    query = log.stream().writeStream.format("noop").option("checkpointLocation", scratch(spark, "group")).start()
    with pytest.raises(TimeoutError):
        await_or_fail(query, 2)
    assert not query.isActive


def test_connectors(spark):
    url = "jdbc:derby:memory:smoke;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(5).selectExpr("id", "CAST(id AS STRING) AS v").write.format("jdbc").options(url=url, dbtable="t", **driver).save()
    assert jdbc_reader(spark, "t", url, partition_column="id", bounds=(0, 5), partitions=2, **driver).where("id = 3").first().v == "3"
    assert kafka_reader_options(["a", "b"])["subscribe"] == "a,b"
    assert kafka_writer_options("a")["kafka.acks"] == "all" and "subscribe" not in kafka_writer_options("a")
