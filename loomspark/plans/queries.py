"""The registered queries of the table and log jobs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical_json, decode, encode
from ..operators import insert_returning as insert_keyed
from ..operators import key_violations, with_serial
from ..session import scratch
from ..sources import SessionTable, load
from ..sources import point_lookup as lookup
from ..streaming import Log
from ..streaming import first_message as first_record
from . import extensions


def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return lookup(load(spark, sf, "customer"), "c_custkey", 42, ["c_name"])


def serial_assign(spark: SparkSession, sf: str) -> DataFrame:
    return with_serial(load(spark, sf, "events").select("event_id"), ["event_id"])


def pk_violations(spark: SparkSession, sf: str) -> DataFrame:
    return key_violations(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def json_encode(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select("event_id", encode("event_id", "event_type").cast("string").alias("value"))


def json_encode_text(spark: SparkSession, sf: str) -> DataFrame:
    df = load(spark, sf, "conversations")
    value = encode("role", "text")
    return df.select("conv_id", "turn", decode(value, "role STRING, text STRING").alias("v")).select("conv_id", "turn", "v.role", "v.text")


def json_decode(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select("event_id", decode(F.col("props"), "k INT")["k"].alias("k"))


def json_roundtrip_equal(spark: SparkSession, sf: str) -> DataFrame:
    df = load(spark, sf, "events")
    sent = F.struct("event_id", "event_type")
    back = decode(encode("event_id", "event_type"), "event_id BIGINT, event_type STRING")
    return df.select("event_id", (sent == back).alias("equal"))


def json_strict(spark: SparkSession, sf: str) -> DataFrame:
    """Documents parsed in full, and whether they equal what is encoded of their decoded form."""
    df = load(spark, sf, "events").select("event_id", canonical_json(F.col("props")).alias("document"))
    back = encode(decode(F.col("document"), "k INT")["k"].alias("k"))
    return df.select("event_id", "document", (F.col("document") == canonical_json(back)).alias("equal"))


def _produced(spark: SparkSession, sf: str, partitions: int = 1) -> Log:
    df = load(spark, sf, "events").select("event_id", (F.col("user_id") % partitions).alias("p"), encode("event_id", "event_type").alias("value"))
    log = Log(spark, "events", partitions)
    log.produce(df, "value", ["event_id"], partition="p")
    return log


SENT = "event_id BIGINT, event_type STRING"


def log_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return _produced(spark, sf).read().select("partition", "offset", decode(F.col("value"), SENT)["event_id"].alias("event_id"))


def log_offsets_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    log = _produced(spark, sf, 3)
    took = log.consume(scratch(spark, "sink"), scratch(spark, "group"))
    return took.select("partition", "offset", decode(F.col("value"), SENT)["event_id"].alias("event_id"))


def log_roundtrip_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _produced(spark, sf).consume(scratch(spark, "sink"), scratch(spark, "group"), lambda df: df.select(decode(F.col("value"), SENT).alias("v")).select("v.*"))


def first_message(spark: SparkSession, sf: str) -> DataFrame:
    df = load(spark, sf, "events").where("event_type = 'error'").select("event_id", "event_type", "value")
    return first_record(df, "event_id")


def insert_returning(spark: SparkSession, sf: str) -> DataFrame:
    return _inserted(spark, sf)[1].select("id", "event_id")


def insert_select_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return _inserted(spark, sf)[0].df().select("id", "value")


def _inserted(spark: SparkSession, sf: str) -> tuple[SessionTable, DataFrame]:
    events = load(spark, sf, "events").select("event_id", F.col("props").alias("value"))
    table = SessionTable(spark, "inserted", "id INT, value STRING")
    return table, insert_keyed(table, events, ["event_id"])


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Events are encoded, logged, consumed, decoded and filtered."""
    return log_roundtrip_stream(spark, sf).where("event_type = 'error'")


QUERIES = {f.__name__: f for f in (point_lookup, serial_assign, pk_violations, json_encode, json_encode_text, json_decode, json_roundtrip_equal, json_strict, log_offsets, log_offsets_partitioned, log_roundtrip_stream, first_message, insert_returning, insert_select_roundtrip)} | extensions.QUERIES

_SENT_JSON = "'{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}'"

ORACLE = {
    "point_lookup": "SELECT c_name FROM customer WHERE c_custkey = 42",
    "serial_assign": "SELECT event_id, CAST(row_number() OVER (ORDER BY event_id) AS INTEGER) AS id FROM events",
    "pk_violations": "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "json_encode": f"SELECT event_id, {_SENT_JSON} AS value FROM events",
    "json_encode_text": "SELECT conv_id, turn, role, text FROM conversations",
    "json_decode": "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
    "json_roundtrip_equal": "SELECT event_id, true AS equal FROM events",
    "json_strict": "SELECT event_id, '{\"k\": ' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS document, true AS equal FROM events",
    "log_offsets": "SELECT CAST(0 AS INTEGER) AS partition, row_number() OVER (ORDER BY event_id) - 1 AS \"offset\", event_id FROM events",
    "log_offsets_partitioned": "SELECT CAST(user_id % 3 AS INTEGER) AS partition, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) - 1 AS \"offset\", event_id FROM events",
    "log_roundtrip_stream": "SELECT event_id, event_type FROM events",
    "first_message": "SELECT event_id, event_type, value FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 1",
    "insert_returning": "SELECT CAST(row_number() OVER (ORDER BY event_id) AS INTEGER) AS id, event_id FROM events",
    "insert_select_roundtrip": "SELECT CAST(row_number() OVER (ORDER BY event_id) AS INTEGER) AS id, props AS value FROM events",
} | extensions.ORACLE
