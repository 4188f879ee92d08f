"""The extensions against brute-force versions: nulls, ties, repeated and empty rows, cut and restarted streams."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomspark.operators import timejoins
from loomspark.operators.timejoins import asof_join, interval_join
from loomspark.plans.extensions import sessions_in
from loomspark.streaming import eventtime
from loomspark.streaming.eventtime import SESSION, joined_within, late_rows, running_sessions, sessions, tumbling
from loomspark.streaming.incremental import Incremental, replay

SF = "/root/testdata/sf0.001"


def counted(df):
    return Counter(map(tuple, df.collect()))


def moments(seed, n, users=4, span=50):
    r = random.Random(seed)
    return [(i, r.choice([None, *range(users), 0, 0]), r.choice([None, *range(span)]), r.choice("abc")) for i in range(n)]


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("rows", [5, 1_000_000])
def test_asof(spark, monkeypatch, direction, exact, rows):
    monkeypatch.setattr(timejoins, "SLICE_ROWS", rows)
    left, right = moments(1, 120), moments(2, 90)
    a, b = spark.createDataFrame(left, "id int, u int, t int, r string"), spark.createDataFrame(right, "id int, u int, t int, r string").repartition(5)
    got = asof_join(a, b, by=["u"], left_on="t", right_on="t", columns={"id": "rid", "t": "rt"}, ties=["r", "id"], direction=direction, exact=exact, tolerance=9)
    want = Counter()
    for i, u, t, x in left:
        near = [m for m in right if None not in (u, t, m[2]) and m[1] == u and (m[2] - t) * (1 if direction == "forward" else -1) >= (0 if exact else 1)]
        best = max(near, key=lambda m: (-abs(m[2] - t), m[3], m[0]), default=None)
        want[(i, u, t, x, *((best[0], best[2]) if best and abs(best[2] - t) <= 9 else (None, None)))] += 1
    assert counted(got) == want
    assert asof_join(a.limit(0), b, by=["u"], left_on="t", right_on="t", columns={"id": "rid"}).count() == 0
    assert {x.rid for x in asof_join(a, b.limit(0), by=["u"], left_on="t", right_on="t", columns={"id": "rid"}).collect()} == {None}


def test_asof_times(spark):
    """Timestamps of both kinds, dates and several keys; names that clash are refused."""
    for kind in ("timestamp", "timestamp_ntz", "date"):
        a = spark.createDataFrame([("x", 1, "2024-03-31"), ("x", 1, "2024-04-02"), ("x", None, "2024-04-02")], "k string, l int, t string").withColumn("t", F.col("t").cast(kind))
        b = spark.createDataFrame([("x", 1, "2024-04-01", "v"), ("y", 1, "2024-03-01", "w")], "k string, l int, t string, v string").withColumn("t", F.col("t").cast(kind))
        got = asof_join(a, b, by=["k", "l"], left_on="t", right_on="t", columns={"v": "v"})
        assert Counter(x.v for x in got.collect()) == Counter([None, "v", None])
    with pytest.raises(ValueError):
        asof_join(a, b, by=["k"], left_on="t", right_on="t", columns={"v": "L"})


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("width", [1.0, 7.0])
def test_intervals(spark, how, width):
    r = random.Random(4)

    def spans(n):
        out = []
        for i in range(n):
            start = r.choice([None, *range(-40, 60)])
            size = r.choice([0, 0, 1, 3, 20, 700, -1])
            out.append((i, r.choice([None, 0, 0, 1]), start, None if start is None or r.random() < 0.05 else start + size))
        return out

    left, right = spans(70), spans(80)
    a, b = spark.createDataFrame(left, "id int, k int, s int, e int"), spark.createDataFrame(right, "id int, k int, s int, e int").repartition(4)
    got = interval_join(a, b, left_span=("s", "e"), right_span=("s", "e"), by=["k"], columns={"id": "rid"}, width=width, how=how)
    want = Counter()
    for i, k, s, e in left:
        hits = [j for j, l, s2, e2 in right if None not in (k, s, e, s2, e2) and k == l and s <= e and s2 <= e2 and s <= e2 and s2 <= e]
        for j in hits or ([None] if how == "left" else []):
            want[(i, k, s, e, j)] += 1
    assert counted(got) == want
    keyless = interval_join(a, b, left_span=("s", "e"), right_span=("s", "s"), columns={"id": "rid"}, width=width)
    assert keyless.count() == sum(None not in (s, e, p) and s <= p <= e for _, _, s, e in left for _, _, p, _ in right)
    assert interval_join(a.limit(0), b, left_span=("s", "e"), right_span=("s", "e"), columns={"id": "rid"}, width=width, how=how).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("plain, most", [(0, 100), (300, 100), (300, 0), (10_000, 100)])
def test_intervals_of_keys_with_many_rows(spark, monkeypatch, how, plain, most):
    """Keys joined as they are and keys dealt to bins, alone and together; no rows are broadcast, whatever Spark takes their sizes for."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    keep = timejoins.stored
    monkeypatch.setattr(timejoins, "stored", lambda df, kind: keep(seen(df), kind))
    monkeypatch.setattr(timejoins, "PLAIN_PAIRS", plain)
    monkeypatch.setattr(timejoins, "MOST_MANY", most)
    r = random.Random(5)

    def spans(n, keys):
        starts = [(i, r.choice(keys), r.choice([None, *range(90)])) for i in range(n)]
        return [(i, k, s, None if s is None else s + r.choice([0, 1, 9, 300, -1])) for i, k, s in starts]

    # key 0 has most rows, 5 has none on the right, 6 none on the left
    left, right = spans(150, [None, 0, 0, 0, 1, 2, 5]), spans(160, [None, 0, 0, 0, 1, 2, 6])
    a, b = spark.createDataFrame(left, "id int, k int, s int, e int"), spark.createDataFrame(right, "id int, k int, s int, e int").repartition(3)
    a, b = keep(a, "a"), keep(b, "b")
    got = seen(interval_join(a, b, left_span=("s", "e"), right_span=("s", "e"), by=["k"], columns={"id": "rid"}, width=4.0, how=how))
    want = Counter()
    for i, k, s, e in left:
        hits = [j for j, l, s2, e2 in right if None not in (k, s, s2) and k == l and s <= e and s2 <= e2 and s <= e2 and s2 <= e]
        for j in hits or ([None] if how == "left" else []):
            want[(i, k, s, e, j)] += 1
    assert counted(got) == want
    # only the keys with many rows may be, which are counted first
    assert not any("BroadcastHashJoin [__row" in p or "Inner, Build" in p or "LeftOuter, Build" in p for p in plans)
    assert (plain < 10_000 and most == 100) or not any("Broadcast" in p for p in plans)


def test_interval_query_broadcasts_no_rows(spark):
    from loomspark.plans.extensions import ext_interval_join

    assert "Broadcast" not in ext_interval_join(spark, SF)._jdf.queryExecution().executedPlan().toString()


T0 = dt.datetime(2024, 1, 1)
ROW = "id BIGINT, u BIGINT, type STRING, amount BIGINT, time TIMESTAMP"


def at(spark, rows):
    return spark.createDataFrame([(i, u, k, m, None if h is None else T0 + dt.timedelta(hours=h)) for i, u, k, m, h in rows], ROW)


def test_late_windows(spark):
    """A row is late if its window is closed by what earlier runs have seen; a job made anew goes on."""
    make = lambda s: tumbling(s, time="time", width="1 day", delay="6 hours", keys=["type"], aggregates=[F.count("*").alias("n"), F.sum("amount").alias("sum")])
    job = Incremental(spark, {"rows": ROW}, make)
    ddl = "window_start TIMESTAMP, window_end TIMESTAMP, type STRING, n BIGINT, sum BIGINT"
    assert job.watermark() == 0 and job.result(ddl).count() == 0
    runs = [[(1, 1, "a", 5, 1), (2, 1, "a", 7, 40), (3, 1, None, 1, 2), (4, 1, "a", 1, None)], [(5, 1, "a", 1, 3), (6, 1, "a", None, 25), (7, 1, "a", 2, 100)], [(8, 1, "a", 9, 50), (9, 1, "a", 9, 90)]]
    late = []
    for rows in runs:
        job = Incremental(spark, {"rows": ROW}, make, path=job.path)
        late += [r.id for r in late_rows(at(spark, rows), job.watermark(), time="time", width="1 day").collect()]
        job.feed("rows", at(spark, rows))
        job.run()
    assert late == [5, 8] and job.watermark() == 1000 * int((T0 + dt.timedelta(hours=94)).replace(tzinfo=dt.UTC).timestamp())
    day = lambda d: T0 + dt.timedelta(days=d)
    assert counted(job.result(ddl)) == Counter([(day(0), day(1), "a", 1, 5), (day(0), day(1), None, 1, 1), (day(1), day(2), "a", 2, 7)])
    job.drop()


def made_rows(seed, n=150):
    r = random.Random(seed)
    return [(i, r.choice([1, 1, 1, 2, 3]), r.choice("ab"), r.choice([None, 1, 2]), r.choice([None, *[x / 4 for x in range(400)]])) for i in range(n)]


def brute_sessions(rows, gap):
    out = []
    for u in {r[1] for r in rows}:
        mine = sorted((r[4], r[0], r[2], r[3] or 0) for r in rows if r[1] == u and r[4] is not None)
        for m in mine:
            if out and out[-1][0] == u and m[0] - out[-1][1][-1][0] <= gap:
                out[-1][1].append(m)
            else:
                out.append((u, [m]))
    us = lambda h: int((T0 + dt.timedelta(hours=h)).replace(tzinfo=dt.UTC).timestamp()) * 1_000_000
    return Counter((u, us(m[0][0]), us(m[-1][0]), len(m), sum(x[3] for x in m), m[0][1], m[0][2], m[-1][1], m[-1][2]) for u, m in out)


@pytest.mark.parametrize("cuts", [1, 3])
def test_running_sessions(spark, cuts):
    rows = made_rows(6)
    make = lambda s: running_sessions(s, time="time", key="u", id_="id", type_="type", amount="amount", gap_us=3_600_000_000, delay="200 hours")
    job = Incremental(spark, {"rows": ROW}, make)
    df = at(spark, rows).union(at(spark, [(None, 1, "a", 1, 3), (9, None, "a", 1, 3)]))
    replay(job, {"rows": df}, F.coalesce(F.col("id"), F.lit(0)) % cuts, cuts, close={"rows": at(spark, [(-1, -1, "z", 0, 9999)])})
    assert counted(job.result(f"u BIGINT, {SESSION}")) == brute_sessions(rows, 1)


def many_users(seed, n, users):
    r = random.Random(seed)
    return [(i, r.randrange(users), r.choice(["a", "b", None]), r.choice([None, 1, 2]), r.choice([x / 4 for x in range(200)])) for i in range(n)]


def test_running_sessions_of_many_keys(spark, monkeypatch, tmp_path):
    """A call of the processor is for a group of keys: their number follows neither the keys nor the rows."""

    class Seen(eventtime.RunningSessions):
        def handleInputRows(self, key, rows, timerValues):
            import uuid

            (folder / f"{key[0]}-{uuid.uuid4().hex}").touch()
            return super().handleInputRows(key, rows, timerValues)

    folder = tmp_path
    monkeypatch.setattr(eventtime, "RunningSessions", Seen)
    rows = many_users(7, 900, 300)
    job = Incremental(spark, {"rows": ROW}, lambda s: running_sessions(s, time="time", key="u", id_="id", type_="type", amount="amount", gap_us=3_600_000_000, delay="200 hours", groups=4))
    replay(job, {"rows": at(spark, rows)}, F.col("id") % 2, 2, close={"rows": at(spark, [(-1, -1, "z", 0, 9999)])})
    assert counted(job.result(f"u BIGINT, {SESSION}")) == brute_sessions(rows, 1)
    assert len(list(folder.iterdir())) == 4 + 4 + 1


@pytest.mark.parametrize("kind", ["string", "date", "timestamp", "decimal(20,2)", "double", "binary"])
def test_running_sessions_by_other_keys(spark, kind):
    """Keys come back from the state as they were."""
    ddl = f"id BIGINT, u {kind}, type STRING, amount BIGINT, time TIMESTAMP"
    rows = many_users(8, 120, 3)
    u = {"date": F.date_add(F.lit("1890-03-01").cast("date"), F.col("u").cast("int")), "timestamp": F.timestamp_micros(F.col("u") * 1_000_001)}.get(kind, F.col("u").cast("string").cast(kind))
    df = at(spark, rows).withColumn("u", u)
    job = Incremental(spark, {"rows": ddl}, lambda s: running_sessions(s, time="time", key="u", id_="id", type_="type", amount="amount", gap_us=3_600_000_000, delay="200 hours"))
    replay(job, {"rows": df}, F.col("id") % 2, 2, close={"rows": at(spark, [(-1, -1, "z", 0, 9999)]).withColumn("u", u)})
    names = {tuple(r) for r in at(spark, [(0, k, "a", 0, 0) for k in range(3)]).select(u.alias("v"), "u").collect()}
    back = {bytes(v) if kind == "binary" else v: k for v, k in names}
    assert Counter((back[bytes(r[0]) if kind == "binary" else r[0]], *r[1:]) for r in job.result(f"u {kind}, {SESSION}").collect()) == brute_sessions(rows, 1)


@pytest.mark.parametrize("block", [1, 7, 50_000])
def test_sessions_of_a_group_in_any_frames(monkeypatch, block):
    """Frames, calls and blocks of the state cut the rows of several keys anyhow."""
    import pandas as pd

    monkeypatch.setattr(eventtime, "BLOCK", block)

    class Handle:
        def __init__(self):
            self.rows, self.timers = [], set()

        def getListState(self, name, schema):
            return self

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = rows

        def clear(self):
            self.rows = []

        def listTimers(self):
            return iter(self.timers)

        def deleteTimer(self, t):
            self.timers.remove(t)

        def registerTimer(self, t):
            self.timers.add(t)

    class Clock:
        def getCurrentWatermarkInMs(self):
            return self.now

    rows, handle, clock, r = many_users(9, 500, 12), Handle(), Clock(), random.Random(1)
    job = eventtime.RunningSessions(3_600_000_000)
    job.init(handle)
    origin = int(T0.replace(tzinfo=dt.UTC).timestamp()) * 1_000_000
    all_ = pd.DataFrame([(u, origin + int(h * 3_600_000_000), i, k, m or 0) for i, u, k, m, h in rows], columns=["key", "t", "id", "type", "amount"])
    got = Counter()
    for call in range(4):
        mine = all_[all_.id % 4 == call]
        cuts = sorted({0, len(mine), *r.sample(range(len(mine)), 9)})
        list(job.handleInputRows((0,), iter([mine.iloc[a:b] for a, b in zip(cuts, cuts[1:])]), clock))
        assert len(handle.timers) == 1
    while handle.timers:
        clock.now = min(handle.timers) + 3_600_000 * r.randrange(4)
        for out in job.handleExpiredTimer((0,), clock, None):
            got.update(tuple(None if pd.isna(x) else x for x in t) for t in out.itertuples(index=False, name=None))
    assert got == brute_sessions(rows, 1) and not handle.rows


def test_sessions_need_a_plain_key(spark):
    with pytest.raises(TypeError):
        running_sessions(at(spark, []).withColumn("u", F.array("u")), time="time", key="u", id_="id", type_="type", amount="amount", gap_us=1, delay="1 hour")


def test_sessions_are_closed_once(spark):
    """State is dropped with its session: a later session of the same key starts anew."""
    make = lambda s: running_sessions(s, time="time", key="u", id_="id", type_="type", amount="amount", gap_us=3_600_000_000, delay="1 hour")
    job = Incremental(spark, {"rows": ROW}, make)
    for rows in ([(1, 1, "a", 1, 0), (2, 1, "b", 1, 0.5)], [(3, 2, "a", 1, 50)], [(4, 1, "a", 1, 51), (5, 1, "a", 1, 90)]):
        job = Incremental(spark, {"rows": ROW}, make, path=job.path)
        job.feed("rows", at(spark, rows))
        job.run()
    got = [(r.u, r.n_events, r.first_id, r.last_id) for r in job.result(f"u BIGINT, {SESSION}").collect()]
    assert sorted(got) == [(1, 1, 4, 4), (1, 2, 1, 2), (2, 1, 3, 3)]


def test_same_sessions_in_any_cut(spark):
    assert counted(sessions_in(spark, SF, 1)) == counted(sessions_in(spark, SF, 3))


def test_session_windows(spark):
    rows = made_rows(8)
    job = Incremental(spark, {"rows": ROW}, lambda s: sessions(s, time="time", gap="1 hours", delay="200 hours", keys=["u"], aggregates=[F.count("*").alias("n")]))
    replay(job, {"rows": at(spark, rows)}, F.col("id") % 2, 2, close={"rows": at(spark, [(-1, -1, "z", 0, 9999)])})
    got = Counter((r.u, r.n) for r in job.result("session_start TIMESTAMP, session_end TIMESTAMP, u BIGINT, n BIGINT").collect())
    assert sum(n * c for (_, n), c in got.items()) == sum(r[4] is not None for r in rows)
    # a session window of an hour ends where the next row is an hour later, or goes on: Spark merges windows that touch
    assert got == Counter((k[0], k[3]) for k in brute_sessions(rows, 1).elements())


@pytest.mark.parametrize("how", ["inner", "left_outer"])
def test_stream_join(spark, how):
    left, right = made_rows(10, 80), made_rows(11, 80)
    job = Incremental(spark, {"l": ROW, "r": ROW}, lambda a, b: joined_within(a, b, by=["u"], left_time="time", right_time="time", within="2 HOURS", delay="200 hours", columns={"id": "rid", "u": "ru"}, how=how).select("id", "u", "rid", "ru"))
    more = [(1000, None, "a", 1, 3)]
    sides = {"l": at(spark, left + more), "r": at(spark, right + more)}
    replay(job, sides, F.col("id") % 2, 2, close={"l": at(spark, [(-1, -1, "z", 0, 9999)]), "r": at(spark, [(-1, -2, "z", 0, 9999)])})
    want = Counter()
    for i, u, _, _, t in left + more:
        hits = [(j, v) for j, v, _, _, s in right if u == v and None not in (s, t) and t <= s <= t + 2]
        for hit in hits or ([(None, None)] if how == "left_outer" and t is not None else []):
            want[(i, u, *hit)] += 1
    assert counted(job.result("id BIGINT, u BIGINT, rid BIGINT, ru BIGINT")) == want
