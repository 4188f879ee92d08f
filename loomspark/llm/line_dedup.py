"""Line dedup by a segment-partition edit join (operator 2, DataFrame functions only).

Equal lines are merged first. The edits that a pair may have depend on the length of its shorter line:
one for each ten characters, up to ``edits``. A line of n characters that may have k edits is split into
k + 1 segments; a line of that or more characters within k edits of it has one of them unchanged, at a
place that the two lengths bound. So each line is indexed by its segments, and probes the indexes of its
own length and of each length shorter by up to k with its substrings at those places. Lines that meet are verified by
banded bit-parallel edit distance, and linked lines form classes of which the first line stays.

A group of lines under one segment is first verified against one of them, which settles groups of
near copies by one pair a line; only groups that still hold several classes are paired further.
There, lines whose 256-bit marks of character pairs rule the distance out do not become a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import forget, stored
from .bounded import few, unused, with_lists
from .graph import components

#: So many characters allow one edit; lines with fewer are merged only if they are equal, as one edit in
#: them often makes another word or number.
AN_EDIT = 10
#: Lines of so many characters may have the two edits that are the default.
SHORTEST = 2 * AN_EDIT
_PLACE = ["doc_id", "version", "line_no"]


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def allowed(n: Column, edits: int) -> Column:
    """The edits between two lines of which the shorter has ``n`` characters."""
    return F.least(F.lit(edits), (n / AN_EDIT).cast("int"))


def _common_prefix(a: Column, b: Column) -> Column:
    """A length of common prefix, the full one below 128 K characters; found by halving steps."""
    steps = F.array(*(F.lit(1 << e) for e in range(16, -1, -1)))
    least = F.least(F.length(a), F.length(b))

    def step(p: Column, s: Column) -> Column:
        return F.when((p + s <= least) & (F.substr(a, p + 1, s) == F.substr(b, p + 1, s)), p + s).otherwise(p)

    return F.aggregate(steps, F.lit(0), step)


def edit_distance(long_: Column, short: Column, edits: int) -> Column:
    """Edit distance of two strings in code points, right where it is at most ``edits``.

    ``long_`` has as many characters as ``short`` or more. The 2 * edits + 1 cells of a column of
    the band are the bits of two longs (where the value rises and where it falls downwards), which
    move one cell along the diagonal with each character of ``short``. The result counts the steps
    on which the diagonal of the last cell rises.
    """
    k, band = edits, _long((1 << (2 * edits + 1)) - 1)
    rows = F.regexp_extract_all(long_, F.lit("(?s)."), F.lit(0))
    cols = F.regexp_extract_all(short, F.lit("(?s)."), F.lit(0))
    more = F.length(long_) - F.length(short)

    def equal(rows: Column):
        # bit t: the row t - k below the diagonal has the character of this column
        def mask(c: Column, j: Column) -> Column:
            bits = [F.when(F.get(rows, j + (t - k)) == c, _long(1 << t)).otherwise(_long(0)) for t in range(2 * k + 1)]
            out = bits[0]
            for b in bits[1:]:
                out = out.bitwiseOR(b)
            return out

        return mask

    def step(s: Column, eq: Column) -> Column:
        up, down = s["up"], s["down"]
        flat = (eq.bitwiseAND(up) + up).bitwiseXOR(up).bitwiseOR(eq).bitwiseOR(down).bitwiseAND(band)

        def after(d: Column) -> Column:
            right = down.bitwiseOR(F.bitwise_not(d.bitwiseOR(up)).bitwiseAND(band))
            half = F.shiftright(d, 1)
            return F.struct(
                d.bitwiseAND(up).bitwiseOR(F.bitwise_not(half.bitwiseOR(right)).bitwiseAND(band)).alias("up"),
                half.bitwiseAND(right).alias("down"),
                (s["d"] + 1 - F.getbit(d, s["bit"]).cast("int")).alias("d"),
                s["bit"].alias("bit"),
            )

        return _let(flat, after)

    start = F.struct(_long(((1 << (k + 1)) - 1) << k).alias("up"), _long(0).alias("down"), more.alias("d"), (more + k).alias("bit"))
    masks = _let(rows, lambda r: F.transform(cols, equal(r)))
    return F.when(more > k, F.lit(k + 1)).otherwise(F.aggregate(masks, start, step)["d"])


def _cut(x: Column, y: Column, body) -> Column:
    """body of two strings without their common prefix, each computed once."""
    rest = _let(_common_prefix(x, y), lambda p: F.struct(F.substr(x, p + 1).alias("x"), F.substr(y, p + 1).alias("y")))
    return _let(rest, lambda r: body(r["x"], r["y"]))


def _close(pairs: DataFrame, edits: int, most: Column | None = None) -> DataFrame:
    """Pairs (a, b) whose texts ta and tb are within ``most`` edits, a column of ``edits`` at most and
    ``edits`` by default; what they share at both ends is cut off first, which changes no distance."""
    most = F.lit(edits) if most is None else most
    a, b = F.col("ta"), F.col("tb")
    ordered = F.when(F.length(a) < F.length(b), F.struct(b.alias("x"), a.alias("y"))).otherwise(F.struct(a.alias("x"), b.alias("y")))

    def inner(x: Column, y: Column) -> Column:
        return _let(F.struct(F.reverse(x).alias("x"), F.reverse(y).alias("y")), lambda r: _cut(r["x"], r["y"], lambda u, v: edit_distance(u, v, edits)))

    distance = _let(ordered, lambda r: _cut(r["x"], r["y"], inner))
    return pairs.where((F.abs(F.length(a) - F.length(b)) <= most) & (distance <= most)).select("a", "b")


def _marks(line: Column) -> Column:
    """A bit for each of 256 classes of character pairs: whether the line has an odd number of
    them, as four longs. An edit changes four pairs at most, so at most four bits."""
    one = _long(1)

    def pairs(chars: Column) -> Column:
        return F.transform(chars, lambda c, i: F.pmod(F.xxhash64(c, F.get(chars, i + 1)), F.lit(256)).cast("int"))

    def word(grams: Column, w: int) -> Column:
        mine = F.filter(grams, lambda g: F.shiftright(g, 6) == w)
        return F.aggregate(mine, _long(0), lambda m, g: m.bitwiseXOR(F.call_function("shiftleft", one, g.bitwiseAND(63))))

    grams = _let(F.regexp_extract_all(line, F.lit("(?s)."), F.lit(0)), pairs)
    return _let(grams, lambda g: F.array(*(word(g, w) for w in range(4))))


def _keyed(lines: DataFrame, edits: int) -> DataFrame:
    """``lines`` (line, ...) with (key, own) of each: the segments of a line, and its substrings
    where a segment of a line of its length or a shorter one may be. ``own`` marks the segments."""
    others = [c for c in lines.columns if c != "line"]
    # the lengths are columns of their own, so that each is computed once for a line
    sized = lines.withColumn("n", F.length("line")).withColumn("plain", F.octet_length("line") == F.col("n"))
    cells = [(k, less) for k in range(1, max(1, edits) + 1) for less in range(k + 1)]  # edits of the indexed line, characters it has less
    sized = sized.withColumns({f"size{k}_{less}": ((F.col("n") - less) / (k + 1)).cast("int") for k, less in cells})
    sized = sized.withColumns({f"longer{k}_{less}": F.col("n") - less - F.col(f"size{k}_{less}") * (k + 1) for k, less in cells})
    segments, probes = {}, {}
    for k, less in cells:
        parts = k + 1
        of, size, longer = F.col("n") - less, F.col(f"size{k}_{less}"), F.col(f"longer{k}_{less}")  # of the indexed line; so many of its last segments have one character more
        here = (of >= k * AN_EDIT) & (F.lit(True) if k == edits else of < (k + 1) * AN_EDIT)
        for i in range(1, parts + 1):
            at = F.lit(1) + size * (i - 1) + F.greatest(F.lit(0), F.lit(i - 1 - parts) + longer)
            length = size + F.when(F.lit(parts - i) < longer, 1).otherwise(0)
            low = max(-(i - 1), less - (parts - i))
            high = min(i - 1, less + (parts - i))
            for move in range(low, high + 1):
                # where all characters are single bytes, a substring of bytes needs no walk from the line's start
                part = F.when(F.col("plain"), F.substr(F.col("line").cast("binary"), at + move, length)).otherwise(F.substr("line", at + move, length).cast("binary"))
                fits = here & (at + move >= 1) & (at + move + length - 1 <= F.col("n"))
                (segments if less == move == 0 else probes)[k, less, i, move] = F.when(fits, F.xxhash64(of, F.lit(i), part))
    # long lines have the keys of the most edits alone
    def long_(x: dict) -> list[Column]:
        return [v for (k, *_), v in x.items() if k == edits]

    long_line = F.col("n") >= edits * (AN_EDIT + 1)
    first, first_long = list(segments.values()), long_(segments)
    keys = F.when(long_line, F.array(*first_long, *long_(probes))).otherwise(F.array(*first, *probes.values()))
    out = sized.select(*others, F.when(long_line, len(first_long)).otherwise(len(first)).alias("firsts"), F.posexplode(keys).alias("at", "key"))
    return out.where("key IS NOT NULL").select("key", (F.col("at") < F.col("firsts")).alias("own"), *others)


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "version", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.btrim("line", F.lit(" \t\n\x0b\x0c\r")) != "")


def _kept(lines: Column, gone: Column, body) -> Column:
    """body(number, line) of each of ``lines`` whose number isn't in ``gone`` (null: none is)."""
    numbers = F.sequence(F.lit(0), F.size(lines) - 1)
    left = F.when(gone.isNull(), numbers).otherwise(F.array_except(numbers, gone))
    return F.transform(left, lambda i: body(i, F.get(lines, i)))


def dedup(docs: DataFrame, *, edits: int = 2) -> DataFrame:
    """``docs`` (doc_id, text, ...) with repeated lines taken out of ``text``.

    Lines are parted by line feeds; those of white space alone are kept. Two lines link if they are
    equal, or have at most as many edits (insert, delete, substitute a code point) between them as the
    shorter allows: one from 10 characters, two from 20, and so on up to ``edits``; of the lines that are linked, directly or over others,
    only the first by (doc_id, hash of the text, line number) stays. ``n_lines`` and ``n_removed`` are added (columns
    of these names are replaced); the other columns stay. A null text stays null with 0 lines. Rows
    that share a doc_id but not their text are documents of their own; rows that share both are one document, of which
    every row keeps the same lines, so no line is lost with all of its copies. A null doc_id comes before all
    others. An empty table gives no rows.
    """
    docs = docs.drop("n_lines", "n_removed")
    # a document is known by its doc_id and a hash of its text
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("version"))
    here = {"version": "version"}
    # equal lines; a hot line is combined before the shuffle
    hashed = _lines(rows).select("doc_id", "version", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), F.col("line")).alias("h2"))
    repeated = hashed.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("d"), F.max(F.col("doc_id").isNull()).alias("none")).where("n > 1").select("h1", "h2", F.when(~F.col("none"), F.col("d")).alias("d"))
    places_of = stored(hashed.join(few(repeated), ["h1", "h2"]), "repeated")
    in_first = F.col("doc_id").eqNullSafe(F.col("d"))
    firsts = few(places_of.where(in_first).groupBy("h1", "h2").agg(F.min(F.struct("version", "line_no")).alias("first")).select("h1", "h2", F.col("first.version").alias("v"), F.col("first.line_no").alias("l")))
    equal = places_of.join(firsts, ["h1", "h2"]).where(~(in_first & (F.col("version") == F.col("v")) & (F.col("line_no") == F.col("l"))))
    equal = stored(equal.groupBy("doc_id", "version").agg(F.collect_set("line_no").alias("gone")), "equal")
    forget(places_of)
    ref = F.struct(*_PLACE)

    # each different line once
    numbered = _let(F.split("text", "\n"), lambda lines: _kept(lines, F.col("gone"), lambda i, line: F.struct(i.alias("line_no"), line.alias("line"))))
    once = with_lists(rows, equal, also=here).select("doc_id", "version", F.explode(numbered).alias("x")).select("doc_id", "version", "x.line_no", "x.line")
    once = once.where((F.length("line") >= AN_EDIT) & (F.btrim("line", F.lit(" \t\n\x0b\x0c\r")) != ""))
    # a line is numbered by its place; lines are written, so that neither keys nor texts need their documents again
    lines = stored(once.withColumn("id", F.monotonically_increasing_id()), "lines")
    # keys are dealt once for both of their uses; most are in one line only
    keyed = _keyed(lines.select("id", "line"), edits).repartition("key")
    groups = keyed.groupBy("key").agg(F.max("own").alias("own"), F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z AND own").select("key").hint("shuffle_hash")
    members = stored(keyed.join(groups, "key"), "members")
    # the line that meets others under the most keys is the one that copies differ from least
    met = members.groupBy("id").agg((-F.count("*")).alias("rank"))
    leads = members.join(met, "id").groupBy("key").agg(F.min(F.struct("rank", "id")).alias("lead")).select("key", F.col("lead.id").alias("lead"))
    stars = stored(members.join(leads, "key").where("id <> lead").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct(), "stars")

    def texts_of(ids: DataFrame) -> DataFrame:
        return lines.select("id", "line").join(few(ids.distinct()), "id", "left_semi")

    def verified(pairs: DataFrame) -> DataFrame:
        texts = stored(texts_of(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))), "texts")
        both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
        return stored(_close(both, edits, allowed(F.least(F.length("ta"), F.length("tb")), edits)), "links")

    links = verified(stars)
    labels = stored(components(links).toDF("id", "component"), "labels")
    labelled = members.join(labels, "id", "left").select("key", "own", "id", F.coalesce("component", "id").alias("c"))
    mixed = labelled.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").select("key", "c1")
    open_ = stored(labelled.join(mixed, "key"), "open")
    marks = few(texts_of(open_.select("id")).select("id", F.length("line").alias("n"), _marks(F.col("line")).alias("m")), width=56)
    open_ = open_.join(marks, "id")
    x = open_.where("c <> c1").select("key", F.col("own").alias("ox"), F.col("id").alias("x"), F.col("c").alias("cx"), F.col("n").alias("nx"), F.col("m").alias("mx"))
    y = open_.select("key", F.col("own").alias("oy"), F.col("id").alias("y"), F.col("c").alias("cy"), F.col("n").alias("ny"), F.col("m").alias("my"))
    bits = sum((F.bit_count(F.col("mx")[i].bitwiseXOR(F.col("my")[i])) for i in range(4)), F.lit(0))
    most = allowed(F.least("nx", "ny"), edits)
    rest = x.join(y, "key").where(F.expr("cx <> cy AND (ox OR oy)") & (F.abs(F.col("nx") - F.col("ny")) <= most) & (bits <= 4 * most)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    rest = stored(rest.join(stars, ["a", "b"], "left_anti"), "rest")
    forget(members, stars)
    if not rest.isEmpty():
        labels = stored(components(links.union(verified(rest))).toDF("id", "component"), "labels")
    near = lines.select("id", *_PLACE).join(few(labels), "id")
    first = near.groupBy("component").agg(F.min(ref).alias("first"))
    near = near.join(first, "component").where(~ref.eqNullSafe(F.col("first"))).groupBy("doc_id", "version").agg(F.collect_set("line_no").alias("gone"))
    gone, parts, version = unused(docs, "gone"), F.split("text", "\n"), unused(docs, "version")
    lost = stored(equal.union(near).groupBy("doc_id", "version").agg(F.flatten(F.collect_list("gone")).alias(gone)), "gone")
    forget(lines, equal)
    cleaned = with_lists(docs.withColumn(version, F.xxhash64("text")), lost, also={version: "version"})
    left = _let(parts, lambda x: F.array_join(_kept(x, F.col(gone), lambda _, line: line), "\n"))
    worded = F.size(F.filter(parts, lambda s: F.btrim(s, F.lit(" \t\n\x0b\x0c\r")) != "")).cast("long")
    out = cleaned.withColumns({"n_lines": F.greatest(worded, F.lit(0)), "n_removed": F.greatest(F.size(gone), F.lit(0)).cast("long"), "text": F.when(F.col(gone).isNull(), F.col("text")).otherwise(left)})
    return out.select(*docs.columns, "n_lines", "n_removed")
