"""As-of and interval joins (extensions), as unions, windows and equi-joins; no join has a range condition alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from ..session import stored

#: Rows of one key that an as-of join is to order in one task.
SLICE_ROWS = 1_000_000
#: Slices of a key at most, so that their carried rows stay few.
MOST_SLICES = 10_000
#: Pairs of rows of one key up to which an interval join compares them all.
PLAIN_PAIRS = 10_000
#: Keys with more pairs that are told from the others by a broadcast of them; beyond, all keys are dealt to bins.
MOST_MANY = 10_000


def ticks(df: DataFrame, column: str) -> Column:
    """A time column as a number: microseconds of a timestamp, days of a date, a number as it is."""
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{column}`)")
    if isinstance(kind, TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, NumericType):
        return c
    raise TypeError(f"{column} is no time: {kind.simpleString()}")


def _struct(df: DataFrame, names: list[str]) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in names))


def asof_join(
    left: DataFrame, right: DataFrame, *, by: list[str], left_on: str, right_on: str, columns: dict[str, str], ties: list[str] | None = None, direction: str = "backward", exact: bool = True, tolerance: float | None = None
) -> DataFrame:
    """Each row of ``left`` with the row of ``right`` of the same ``by`` columns that is nearest before it.

    ``columns`` names the columns of ``right`` to add and their names in the result. ``direction`` is ``backward``
    (the last row of ``right`` at or before the row's time) or ``forward`` (the first at or after it); without ``exact``
    equal times don't match. Of several rows of ``right`` at the nearest time, the one with the largest ``ties``
    columns is taken (by default the added columns; null is smallest). ``tolerance`` is the largest distance, in
    microseconds, days or units (see ``ticks``). Every row of ``left`` is in the result once; where nothing
    matches, its key or time is null, the added columns are null. Rows of ``right`` with a null key or time match nothing.

    Both sides become one ordered sequence by key, in which the last row of ``right`` is carried on by a window. A key
    with many rows is cut into slices of time, each starting with the row that is carried out of the slices before it, so no
    task has to order all rows of a key. Rows of one key and instant stay together.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"no such direction: {direction}")
    if taken := {c.lower() for c in columns.values()} & {c.lower() for c in left.columns}:
        raise ValueError(f"left has columns of these names: {sorted(taken)}")
    sign = 1 if direction == "backward" else -1
    keys = [f"k{i}" for i in range(len(by))]
    none = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys), F.col("t").isNull())
    ties = list(columns) if ties is None else ties

    def side(df: DataFrame, on: str, number: int, row: Column, other: Column, tie: Column) -> DataFrame:
        return df.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)), (ticks(df, on) * sign).alias("t"), F.lit(number).alias("side"), tie.alias("tie"), *((row.alias("l"), other.alias("r")) if number == here else (other.alias("l"), row.alias("r"))))

    # at one time, rows of the right come first if equal times match, and last if they don't
    here, there = (1, 0) if exact else (0, 1)
    found = F.struct((ticks(right, right_on) * sign).alias("t"), _struct(right, list(columns)).alias("row"))
    l_type, r_type = left.select(_struct(left, left.columns).alias("x")).schema["x"].dataType, right.select(found.alias("x")).schema["x"].dataType
    tie = _struct(right, ties) if ties else F.struct(F.lit(0).alias("none"))
    tie_type = right.select(tie.alias("x")).schema["x"].dataType
    a = side(left, left_on, here, _struct(left, left.columns), F.lit(None).cast(r_type), F.lit(None).cast(tie_type))
    b = side(right, right_on, there, found, F.lit(None).cast(l_type), tie).where(~none)
    matched, apart = a.where(~none).unionByName(b), a.where(none)

    # slices: as many as the key with most rows needs, over the time that there is
    extent = matched.groupBy(*keys).agg(F.count("*").alias("n"), F.min("t").alias("low"), F.max("t").alias("high")).agg(F.max("n"), F.min("low"), F.max("high")).first()
    slices = max(1, min(MOST_SLICES, -(-(extent[0] or 0) // SLICE_ROWS)))
    width = (float(extent[2]) - float(extent[1])) / slices if slices > 1 else 0.0
    place = F.least(F.lit(slices - 1), F.floor((F.col("t").cast("double") - float(extent[1])) / width)) if width else F.lit(0)
    sliced = matched.withColumn("slice", place.cast("int"))

    w = Window.partitionBy(*keys, "slice").orderBy("t", "side", "tie")
    ahead = sliced.withColumn("r", F.last("r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("l IS NOT NULL")
    if slices > 1:
        # a row for each key and slice, combined before the shuffle
        last = F.max_by("r", F.when(F.col("r").isNotNull(), F.struct("t", "tie")))
        ends = sliced.groupBy(*keys, "slice").agg(last.alias("out"))
        before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*keys, "slice", F.last("out", ignorenulls=True).over(before).alias("carried"))
        ahead = ahead.join(carried, [*keys, "slice"]).withColumn("r", F.coalesce("r", "carried"))
    near = F.col("r").isNotNull() if tolerance is None else F.col("r").isNotNull() & (F.col("t") - F.col("r.t") <= tolerance)
    both = ahead.select("l", F.when(near, F.col("r.row")).alias("r")).unionByName(apart.select("l", F.lit(None).cast(r_type["row"].dataType).alias("r")))
    return both.select(*(F.col(f"l.`{c}`").alias(c) for c in left.columns), *(F.col(f"r.`{c}`").alias(name) for c, name in columns.items()))


def interval_join(
    left: DataFrame, right: DataFrame, *, left_span: tuple[str, str], right_span: tuple[str, str], by: list[str] = (), columns: dict[str, str], width: float, how: str = "inner"
) -> DataFrame:
    """Each pair of a row of ``left`` and one of ``right`` with the same ``by`` columns whose spans overlap.

    A span is a pair of time columns, both ends included; a point has one column for both. A span with a null end, or
    whose start is after its end, overlaps nothing. ``columns`` names the columns of ``right`` to add and their names in
    the result; with ``how="left"`` the rows of ``left`` without a partner stay, with nulls.

    A key with few rows (up to ``PLAIN_PAIRS`` pairs of rows) is joined as it is, and its pairs are compared. The spans of the others are dealt to
    bins, which are joined as keys. Bins have levels: the bins of level n are ``width`` times
    2 to the n wide (in ``ticks``), and a span belongs to the first level at which it is no longer than a bin, so it
    covers two bins there at most, however long it is. A pair meets at the level of its longer span, where the shorter one is dealt
    too, and counts in the bin where its later start is. So each pair is found once, and a
    row is dealt to two bins for each level of spans that the other side has.

    No join here is a broadcast of rows: what Spark expects of a table's size is that of its files, of which dealt rows are many times as many.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"no such join: {how}")
    if taken := {c.lower() for c in columns.values()} & {c.lower() for c in left.columns}:
        raise ValueError(f"left has columns of these names: {sorted(taken)}")
    keys = [f"k{i}" for i in range(len(by))]

    def spans(df: DataFrame, span: tuple[str, str], names: list[str], tag: str) -> DataFrame:
        start, end = (ticks(df, c).cast("double") for c in span)
        out = df.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)), start.alias(f"{tag}0"), end.alias(f"{tag}1"), _struct(df, names).alias("l" if tag == "a" else "r"))
        sound = reduce(lambda x, y: x & y, (F.col(k).isNotNull() for k in keys), F.col(f"{tag}0") <= F.col(f"{tag}1"))
        return out.withColumn("sound", F.coalesce(sound, F.lit(False)))

    names = left.columns
    every = spans(left if how == "inner" else stored(left, "left"), left_span, names, "a")
    a, b = every.where("sound").drop("sound"), spans(right, right_span, list(columns), "b").where("sound").drop("sound")
    r_type = b.schema["r"].dataType
    overlap = (F.col("a0") <= F.col("b1")) & (F.col("b0") <= F.col("a1"))

    def plain(a: DataFrame, b: DataFrame) -> DataFrame:
        y = b.select(*(F.col(k).alias(f"r{k}") for k in keys), "b0", "b1", "r").hint("merge")
        same = reduce(lambda x, k: x & (F.col(k) == F.col(f"r{k}")), keys, overlap)
        return a.join(y, same, how).select("l", "r")

    def binned(a: DataFrame, b: DataFrame) -> DataFrame:
        if how == "left":
            a = stored(a.withColumn("__row", F.monotonically_increasing_id()), "left")
        row = ["__row"] if how == "left" else []
        # the length of a span in bins of level 0, rounded up to a power of two
        level = lambda t: F.greatest(F.lit(0), F.ceil(F.log2(F.greatest((F.col(f"{t}1") - F.col(f"{t}0")) / width, F.lit(1.0))))).cast("int")
        a, b = a.withColumn("la", level("a")), b.withColumn("lb", level("b"))
        a_levels, b_levels = ([r[0] for r in x.select(n).distinct().collect()] for x, n in ((a, "la"), (b, "lb")))  # some fifty at most

        def dealt(df: DataFrame, tag: str, levels: list[int]) -> DataFrame:
            own = F.col(f"l{tag}")
            met = F.filter(F.array_distinct(F.concat(F.array(own), F.array(*map(F.lit, levels)).cast("array<int>"))), lambda x: x >= own)
            size = F.pow(F.lit(2.0), F.col("at")) * width
            first, last = F.floor(F.col(f"{tag}0") / size), F.floor(F.col(f"{tag}1") / size)
            return df.withColumn("at", F.explode(met)).withColumn("bin", F.explode(F.sequence(first, last)))

        x, y = dealt(a, "a", b_levels), dealt(b, "b", a_levels)
        once = (F.col("at") == F.greatest("la", "lb")) & (F.col("bin") == F.floor(F.greatest("a0", "b0") / (F.pow(F.lit(2.0), F.col("at")) * width)))
        pairs = x.join(y.hint("merge"), [*keys, "at", "bin"]).where(overlap & once).select(*row, "l", "r")
        if how == "inner":
            return pairs
        pairs = stored(pairs, "pairs")
        alone = a.join(pairs.select("__row").hint("merge"), "__row", "left_anti")
        return pairs.select("l", "r").unionByName(alone.select("l", F.lit(None).cast(r_type).alias("r")))

    if not by:
        parts = [binned(a, b)]
    else:
        one, none = F.count("*"), F.lit(0).cast("long")
        sides = a.groupBy(*keys).agg(one.alias("n"), none.alias("m")).unionByName(b.groupBy(*keys).agg(none.alias("n"), one.alias("m")))
        # as decimals, since the product of two counts may pass a long
        n, m = (F.greatest(F.sum(c), F.lit(1)).cast("decimal(18,0)") for c in ("n", "m"))
        many = stored(sides.groupBy(*keys).agg((n * m).alias("pairs")).where(F.col("pairs") > PLAIN_PAIRS).select(*keys), "keys")
        n_many = many.count()
        if not n_many:
            parts = [plain(a, b)]
        elif n_many > MOST_MANY:
            parts = [binned(a, b)]
        else:
            few, lot = ([df.join(F.broadcast(many), keys, kind) for df in (a, b)] for kind in ("left_anti", "left_semi"))
            parts = [plain(*few), binned(*lot)]
    if how == "left":
        parts.append(every.where("NOT sound").select("l", F.lit(None).cast(r_type).alias("r")))
    both = reduce(DataFrame.unionByName, parts)
    return both.select(*(F.col(f"l.`{c}`").alias(c) for c in names), *(F.col(f"r.`{c}`").alias(name) for c, name in columns.items()))
