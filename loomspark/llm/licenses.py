"""Licence scan by canonical digests (operator 9, DataFrame functions only).

A text's canonical form has lower-case words joined by single spaces: copyright lines and "all
rights reserved" are removed, punctuation separates words, and equivalent spellings are one. Two
texts say the same if their canonical forms are equal. The whole of each document, and the whole
of each of its lines, is looked up by the digest of its canonical form in a table of known licence
texts and notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .license_texts import KNOWN

#: A line that opens with a copyright statement, after any comment marks; up to eight words may come before the year.
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9©\n]*(?:copyright[ \t]*(?:\(c\)|©|[0-9][0-9][0-9][0-9]|:|\[|<|[ \t](?:[^ \t\n]+[ \t]+){1,8}\(?[12][0-9][0-9][0-9])|\(c\)[ \t]*[0-9][0-9][0-9][0-9]|©)[^\n]*"
RIGHTS = r"all rights reserved"
NOT_WORD = r"[^\p{L}\p{N}\n]+"
#: Equivalent spellings, as whole words of the canonical form.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("sub licence", "sublicense"),
    ("sublicence", "sublicense"),
    ("non commercial", "noncommercial"),
    ("whilst", "while"),
    ("merchantibility", "merchantability"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("https", "http"),
    ("per cent", "percent"),
)


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line; lines are parted by line feeds, some may be empty."""
    t = F.lower(F.coalesce(text, F.lit("")))
    # the pass over what is rare runs only where its cheap test holds
    t = F.when(t.contains("copyright") | t.contains("(c)") | t.contains("©"), F.regexp_replace(t, COPYRIGHT_LINE, "$1")).otherwise(t)
    t = F.replace(t, F.lit(RIGHTS), F.lit(""))
    t = F.concat(F.lit(" "), F.replace(F.regexp_replace(t, NOT_WORD, " "), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.transform(F.split(t, "\n"), lambda line: F.btrim(line))


def known(spark, texts: dict[str, tuple[str, ...]] = KNOWN) -> DataFrame:
    """license_id, digest and length of the known texts, a fixed table of some dozens of rows."""
    rows = spark.createDataFrame([(k, t) for k, all_ in texts.items() for t in all_], "license_id string, text string")
    whole = F.array_join(F.filter(canonical_lines(F.col("text")), lambda x: x != ""), " ")
    named = rows.select("license_id", whole.alias("canonical"))
    return named.select("license_id", F.sha2(F.col("canonical"), 256).alias("digest"), F.length("canonical").alias("n")).where("n > 0").groupBy("digest", "n").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, texts: dict[str, tuple[str, ...]] = KNOWN) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, ``digest`` of its canonical form,
    ``license_id`` if its whole text is a known one, ``line_licenses`` (the distinct known ones
    whose text is a whole line, sorted, joined by ','; '' for none) and ``n_license_lines``.

    Only lines as long as a known text are hashed. The known table is broadcast: its size is that
    of the parameter. Found lines are few columns and are counted before the shuffle. A null or
    empty text has the digest of ''. Rows with the same doc_id and text each get the result;
    other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    table = known(spark, texts)
    sizes = sorted({r.n for r in table.select("n").distinct().collect()})  # of the fixed table
    lines = docs.select("doc_id", F.filter(canonical_lines(F.col("text")), lambda x: x != "").alias("lines"))
    whole = lines.select(
        "doc_id", F.sha2(F.array_join("lines", " "), 256).alias("digest"), F.filter("lines", lambda x: F.length(x).isin(sizes)).alias("lines")
    )
    lookup = F.broadcast(table.select("digest", "license_id"))
    # each text is brought to its canonical form once; a digest and a few lines are kept of it
    matched = stored(whole.join(lookup, "digest", "left"), "digests")
    by_line = F.broadcast(table.select(F.col("digest").alias("line_digest"), F.col("license_id").alias("line_license")))
    found = (
        matched.where(F.size("lines") > 0)
        .select("doc_id", "digest", F.explode("lines").alias("line"))
        .select("doc_id", "digest", F.sha2("line", 256).alias("line_digest"))
        .join(by_line, "line_digest")
        .groupBy("doc_id", "digest")
        .agg(F.array_join(F.sort_array(F.collect_set("line_license")), ",").alias("line_licenses"), F.count("*").alias("n"))
    )
    # repeated rows were counted together
    copies = matched.groupBy("doc_id", "digest", "license_id").agg(F.count("*").alias("copies"))
    a, b = copies.alias("a"), found.alias("b")
    joined = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.digest") == F.col("b.digest")), "left")
    return joined.select(
        "a.doc_id", "a.digest", "license_id", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"), (F.coalesce("n", F.lit(0)) / F.col("copies")).cast("long").alias("n_license_lines"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("i")
    ).drop("i")
