"""Registered queries of the extensions, with their SQL. None of them has a counterpart in the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.variants import document, field, shape
from ..operators.groups import HLL_ERROR, KLL_ERROR, cube_sets, grouping_sets, merged, sketches, top_rows, trailing
from ..operators.timejoins import asof_join, interval_join, ticks
from ..sources import load
from ..sources.versioned import VersionedTables
from ..streaming.eventtime import SESSION, joined_within, late_rows, running_sessions, sessions, tumbling
from ..streaming.incremental import Incremental, replay

HOUR_US = 3_600_000_000


def ext_asof_join(spark: SparkSession, sf: str) -> DataFrame:
    """The last click of a user before each purchase, and how long before it was."""
    events = load(spark, sf, "events").withColumn("us", ticks(load(spark, sf, "events"), "ts"))
    found = asof_join(events.where("event_type = 'purchase'").select("event_id", "user_id", "us"), events.where("event_type = 'click'"), by=["user_id"], left_on="us", right_on="us", columns={"event_id": "click_id", "us": "click_us"}, ties=["event_id"])
    return found.select("event_id", "user_id", "click_id", (F.col("us") - F.col("click_us")).alias("gap_us"))


def ext_interval_join(spark: SparkSession, sf: str) -> DataFrame:
    """For each order, the orders that its customer placed from its first to its last shipment."""
    shipped = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    left = orders.join(shipped.hint("merge"), "o_orderkey").select("o_orderkey", "o_custkey", "first_ship", "last_ship")
    pairs = interval_join(left, orders, left_span=("first_ship", "last_ship"), right_span=("o_orderdate", "o_orderdate"), by=["o_custkey"], columns={"o_orderkey": "placed_key"}, width=7 * 24 * HOUR_US, how="left")
    return pairs.select("o_orderkey", "placed_key")


ARRIVAL = "event_id BIGINT, user_id BIGINT, event_type STRING, cents BIGINT, k INT, time TIMESTAMP"


def arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their time as a timestamp, whatever the session's zone, and their value in whole cents."""
    events = load(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select("event_id", "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"), k.alias("k"), F.timestamp_micros(ticks(events, "ts")).alias("time"))


def _batch(batches: int):
    """The run an event arrives in, k hours after its time: each takes as many days of January 2024, and the last all that follow."""
    day = F.floor((F.unix_micros("time") + F.col("k") * HOUR_US - 1_704_067_200 * 1_000_000) / (24 * HOUR_US))
    return F.least(F.lit(batches - 1), F.floor(day / (30 // batches)))


def _closing(rows: DataFrame, user: int = -1) -> DataFrame:
    """A row a year after all others, of a user that doesn't exist. A null user wouldn't do: joins and filters
    drop it before the watermark sees it."""
    last = rows.agg((F.max("time") + F.expr("INTERVAL 365 DAYS")).alias("time"))
    known = {"time": F.col("time"), "user_id": F.lit(user), "event_id": F.lit(-1)}
    return last.select(*(known.get(c, F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns))


def ext_late_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Events a day and type as a stream of three runs sees them, half a day after the last event, and how many came later."""
    rows = arrivals(spark, sf)
    job = Incremental(spark, {"events": ARRIVAL}, lambda events: tumbling(events, time="time", width="1 day", delay="12 hours", keys=["event_type"], aggregates=[F.count("*").alias("n"), F.sum("cents").alias("cents")]))
    late = replay(job, {"events": rows}, _batch(3), 3, close={"events": _closing(rows)}, late=lambda df, mark: late_rows(df, mark, time="time", width="1 day"))
    seen = job.result("window_start TIMESTAMP, window_end TIMESTAMP, event_type STRING, n BIGINT, cents BIGINT")
    zero = F.lit(0).cast("long")
    both = seen.select("window_start", "event_type", "n", "cents", zero.alias("n_late")).unionByName(late.select("window_start", "event_type", zero.alias("n"), zero.alias("cents"), F.lit(1).cast("long").alias("n_late")))
    return both.groupBy(F.unix_seconds("window_start").alias("window_start_s"), "event_type").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"), F.sum("n_late").alias("n_late"))


def ext_session_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of users with six hours of rest between them, from a stream of three runs out of order."""
    rows = arrivals(spark, sf)
    job = Incremental(spark, {"events": ARRIVAL}, lambda events: sessions(events, time="time", gap="6 hours", delay="100 hours", keys=["user_id"], aggregates=[F.count("*").alias("n"), F.sum("cents").alias("cents")]))
    replay(job, {"events": rows}, _batch(3), 3, close={"events": _closing(rows)})
    seen = job.result("session_start TIMESTAMP, session_end TIMESTAMP, user_id BIGINT, n BIGINT, cents BIGINT")
    return seen.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n", "cents")


def sessions_in(spark: SparkSession, sf: str, batches: int) -> DataFrame:
    rows = arrivals(spark, sf)
    job = Incremental(spark, {"events": ARRIVAL}, lambda events: running_sessions(events, time="time", key="user_id", id_="event_id", type_="event_type", amount="cents", gap_us=6 * HOUR_US, delay="100 hours"))
    replay(job, {"events": rows}, _batch(batches), batches, close={"events": _closing(rows)})
    return job.result(f"user_id BIGINT, {SESSION}")


def ext_running_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The same sessions as state of our own with timers, each with its first and last event, from three runs."""
    return sessions_in(spark, sf, 3)


def ext_stream_join(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks with the purchases of the same user within an hour, from two streams of three runs."""
    rows = arrivals(spark, sf)
    job = Incremental(spark, {"clicks": ARRIVAL, "purchases": ARRIVAL}, lambda clicks, purchases: joined_within(clicks, purchases, by=["user_id"], left_time="time", right_time="time", within="1 HOUR", delay="100 hours", columns={"event_id": "purchase_id"}).select("event_id", "user_id", "purchase_id"))
    sides = {"clicks": rows.where("event_type = 'click'"), "purchases": rows.where("event_type = 'purchase'")}
    replay(job, sides, _batch(3), 3, close={"clicks": _closing(rows, -1), "purchases": _closing(rows, -2)})
    return job.result("event_id BIGINT, user_id BIGINT, purchase_id BIGINT")


def ext_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of customers, kept up by a merge for each order status. A customer with eight or more orders in a later
    status is removed then. Each merge and its row in a second table are one commit."""
    orders = load(spark, sf, "orders").select("o_custkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    tables = VersionedTables(spark)
    with tables.transaction() as change:
        change.create("totals", spark.createDataFrame([], "o_custkey BIGINT, n BIGINT, cents BIGINT, last_status STRING"), ["o_custkey"])
        change.create("merges", spark.createDataFrame([], "status STRING, customers BIGINT, total_n BIGINT"), ["status"], buckets=1)
    for status in ("F", "O", "P"):
        new = orders.where(F.col("o_orderstatus") == status).groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"), F.min("o_orderstatus").alias("last_status"))
        with tables.transaction() as change:
            change.merge("totals", new, matched={"n": F.col("t.n") + F.col("s.n"), "cents": F.col("t.cents") + F.col("s.cents"), "last_status": F.col("s.last_status")}, delete=F.col("s.n") >= 8)
            change.insert("merges", change.read("totals").agg(F.lit(status).alias("status"), F.count("*").alias("customers"), F.sum("n").alias("total_n")))
    return tables.read("totals").join(tables.read("merges").select(F.col("status").alias("last_status"), "customers", "total_n"), "last_status", "left")


def ext_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Quantities and numbers of suppliers for the cube of flag, status and year of shipment."""
    items = load(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.year("l_shipdate").alias("ship_year"), F.col("l_quantity").cast("long").alias("q"), "l_suppkey")
    return grouping_sets(items, cube_sets(["l_returnflag", "l_linestatus", "ship_year"]), sums={"quantity": F.col("q"), "n_rows": F.lit(1)}, distinct={"n_suppliers": "l_suppkey"})


def ext_trailing(spark: SparkSession, sf: str) -> DataFrame:
    """For each event, the events of its user within the two days before it, and their value."""
    events = load(spark, sf, "events")
    rows = events.select("event_id", "user_id", ticks(events, "ts").alias("us"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    return trailing(rows, by=["user_id"], time="us", before=48 * HOUR_US, slice_=96 * HOUR_US, aggregates={"n": F.count("*"), "cents_before": F.sum("cents")}).select("event_id", "n", "cents_before")


def ext_top_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The three events of the highest value of each type, and of each user."""
    events = load(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    order = [F.desc("value"), F.col("event_id")]
    return top_rows(events, by=["event_type"], order=order, k=3).select(F.lit("type").alias("per"), "event_type", "event_id", "rank").unionByName(top_rows(events, by=["user_id"], order=order, k=3).select(F.lit("user").alias("per"), "event_type", "event_id", "rank"))


def ext_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and median price of the orders of each month, from sketches kept for each day: whether the exact values lie
    within three standard errors of the count and within the rank error of the median."""
    orders = load(spark, sf, "orders").select("o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("day"))
    days = sketches(orders, by=[F.col("day")], distinct="o_custkey", value="o_totalprice")
    month = F.date_format("day", "yyyy-MM").alias("month")
    months = merged(days, by=[month]).select("month", "n", F.hll_sketch_estimate("distinct_sketch").alias("customers"), F.expr("kll_sketch_get_quantile_double(value_sketch, 0.5D)").alias("median"))
    exact = orders.groupBy(month).agg(F.count_distinct("o_custkey").alias("exact"))
    # the rank of the estimate: the share of rows below it, and of those up to it
    below = orders.withColumn("month", month).join(F.broadcast(months.select("month", "median")), "month").groupBy("month").agg(F.avg((F.col("o_totalprice") < F.col("median")).cast("int")).alias("low"), F.avg((F.col("o_totalprice") <= F.col("median")).cast("int")).alias("high"))
    near = F.abs(F.col("customers") - F.col("exact")) <= F.greatest(F.lit(1.0), 3 * HLL_ERROR * F.col("exact"))
    ranked = (F.col("low") <= 0.5 + KLL_ERROR) & (F.col("high") >= 0.5 - KLL_ERROR)
    return months.join(exact, "month").join(below, "month").select("month", "n", F.col("exact").alias("n_customers"), near.alias("count_within"), ranked.alias("median_within"))


def ext_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Events as documents whose shape depends on their type, read by paths, with the merged schema of each type."""
    events = load(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    text = F.when(F.col("event_type") == "error", F.concat(F.lit('{"k": "'), k, F.lit('", "tags": ["e"]}'))).when(F.col("event_type") == "click", F.concat(F.lit('{"k": '), k, F.lit(', "at": {"x": '), k, F.lit(', "y": null}}'))).otherwise(F.col("props"))
    docs = events.select("event_type", document(text).alias("doc"))
    return docs.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(field(F.col("doc"), "$.k", "bigint")).alias("sum_k"), F.count(field(F.col("doc"), "$.at.x", "int")).alias("n_x"), F.count(field(F.col("doc"), "$.tags[0]", "string")).alias("n_tags"), shape(F.col("doc")).alias("shape"))


QUERIES = {
    f.__name__: f
    for f in (
        ext_asof_join, ext_interval_join, ext_late_windows, ext_session_windows, ext_running_sessions, ext_stream_join,
        ext_merge, ext_grouping_sets, ext_trailing, ext_top_rows, ext_sketches, ext_variants,
    )
}

_CENTS = "CAST(round(value * 100) AS BIGINT)"
_ISLANDS = f"""
WITH e AS (
  SELECT *, epoch_us(ts) AS us, {_CENTS} AS cents FROM events
), g AS (
  SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) <= {6 * HOUR_US} THEN 0 ELSE 1 END AS new FROM e
), s AS (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nth FROM g
)
"""

ORACLE = {
    "ext_asof_join": """
WITH w AS (
  SELECT event_id, user_id, ts, event_type,
    last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_type, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS click_id
  FROM events WHERE event_type IN ('click', 'purchase')
)
SELECT w.event_id, w.user_id, w.click_id, epoch_us(w.ts) - epoch_us(c.ts) AS gap_us FROM w LEFT JOIN events c ON c.event_id = w.click_id WHERE w.event_type = 'purchase'
""",
    "ext_interval_join": """
WITH s AS (
  SELECT l_orderkey AS o_orderkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1
), l AS (
  SELECT o_orderkey, o_custkey, first_ship, last_ship FROM orders JOIN s USING (o_orderkey)
)
SELECT l.o_orderkey, p.o_orderkey AS placed_key FROM l LEFT JOIN orders p ON p.o_custkey = l.o_custkey AND p.o_orderdate BETWEEN l.first_ship AND l.last_ship
""",
    "ext_late_windows": f"""
WITH e AS (
  SELECT event_type, {_CENTS} AS cents, epoch_us(ts) AS us, least(2, floor(floor((epoch_us(ts) + CAST(json_extract(props, '$.k') AS BIGINT) * {HOUR_US} - 1704067200000000) / {24 * HOUR_US}) / 10)) AS batch FROM events
), marks AS (
  SELECT b.batch, (SELECT max(us) // 1000 - 43200000 FROM e WHERE e.batch < b.batch) AS mark FROM (SELECT DISTINCT batch FROM e) b
), d AS (
  SELECT event_type, cents, us // {24 * HOUR_US} * 86400 AS window_start_s, coalesce((us // {24 * HOUR_US} + 1) * 86400000 <= mark, false) AS late FROM e JOIN marks USING (batch)
)
SELECT window_start_s, event_type, count(*) FILTER (NOT late) AS n, CAST(coalesce(sum(cents) FILTER (NOT late), 0) AS BIGINT) AS cents, count(*) FILTER (late) AS n_late FROM d GROUP BY ALL
""",
    "ext_session_windows": f"{_ISLANDS} SELECT user_id, min(us) AS start_us, max(us) + {6 * HOUR_US} AS end_us, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM s GROUP BY user_id, nth",
    "ext_running_sessions": f"""{_ISLANDS}
SELECT user_id, min(us) AS "start", max(us) AS "end", count(*) AS n_events, CAST(sum(cents) AS BIGINT) AS amount, arg_min(event_id, (us, event_id)) AS first_id, arg_min(event_type, (us, event_id)) AS first_type,
  arg_max(event_id, (us, event_id)) AS last_id, arg_max(event_type, (us, event_id)) AS last_type
FROM s GROUP BY user_id, nth
""",
    "ext_stream_join": """
SELECT c.event_id, c.user_id, p.event_id AS purchase_id
FROM events c LEFT JOIN events p ON p.event_type = 'purchase' AND p.user_id = c.user_id AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 1 HOUR WHERE c.event_type = 'click'
""",
    "ext_merge": """
WITH a AS (
  SELECT o_custkey, o_orderstatus AS st, count(*) AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY ALL
), f AS (
  SELECT o_custkey, n, cents, st FROM a WHERE st = 'F'
), o AS (
  SELECT o_custkey, coalesce(f.n, 0) + coalesce(s.n, 0) AS n, coalesce(f.cents, 0) + coalesce(s.cents, 0) AS cents, coalesce(s.st, f.st) AS st
  FROM f FULL JOIN (SELECT * FROM a WHERE st = 'O') s USING (o_custkey) WHERE f.n IS NULL OR coalesce(s.n, 0) < 8
), p AS (
  SELECT o_custkey, coalesce(o.n, 0) + coalesce(s.n, 0) AS n, coalesce(o.cents, 0) + coalesce(s.cents, 0) AS cents, coalesce(s.st, o.st) AS st
  FROM o FULL JOIN (SELECT * FROM a WHERE st = 'P') s USING (o_custkey) WHERE o.n IS NULL OR coalesce(s.n, 0) < 8
), m AS (
  SELECT 'F' AS st, count(*) AS customers, sum(n) AS total_n FROM f UNION ALL SELECT 'O', count(*), sum(n) FROM o UNION ALL SELECT 'P', count(*), sum(n) FROM p
)
SELECT o_custkey, CAST(n AS BIGINT) AS n, CAST(cents AS BIGINT) AS cents, st AS last_status, customers, CAST(total_n AS BIGINT) AS total_n FROM p LEFT JOIN m USING (st)
""",
    "ext_grouping_sets": """
SELECT l_returnflag, l_linestatus, CAST(ship_year AS INTEGER) AS ship_year, CAST(sum(q) AS BIGINT) AS quantity, count(*) AS n_rows, count(DISTINCT l_suppkey) AS n_suppliers, GROUPING(l_returnflag, l_linestatus, ship_year) AS grouping_id
FROM (SELECT *, year(l_shipdate) AS ship_year, CAST(trunc(l_quantity) AS BIGINT) AS q FROM lineitem) GROUP BY CUBE (l_returnflag, l_linestatus, ship_year)
""",
    "ext_trailing": f"""
SELECT event_id, count(*) OVER w AS n, CAST(sum({_CENTS}) OVER w AS BIGINT) AS cents_before
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {48 * HOUR_US} PRECEDING AND CURRENT ROW)
""",
    "ext_top_rows": """
SELECT 'type' AS per, event_type, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS INTEGER) AS rank FROM events QUALIFY rank <= 3
UNION ALL
SELECT 'user', event_type, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS rank FROM events QUALIFY rank <= 3
""",
    "ext_sketches": "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, count(DISTINCT o_custkey) AS n_customers, true AS count_within, true AS median_within FROM orders GROUP BY 1",
    "ext_variants": """
SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k, count(*) FILTER (event_type = 'click') AS n_x, count(*) FILTER (event_type = 'error') AS n_tags,
  CASE event_type WHEN 'click' THEN 'OBJECT<at: OBJECT<x: BIGINT, y: VOID>, k: BIGINT>' WHEN 'error' THEN 'OBJECT<k: STRING, tags: ARRAY<STRING>>' ELSE 'OBJECT<k: BIGINT>' END AS shape
FROM events GROUP BY event_type
""",
}
