"""One query for each operator over its whole table, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from ..session import scratch, stored
from . import decontaminate, embedding_dedup, jaccard, licenses, line_dedup, mixing, nbsvm, packing, prefix_trie, quality_rules, substrings, token_files, whitening
from .tokens import default_tokenizer


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    policy = ("web", 2)
    rows = stored(quality_rules.ledger(_documents(spark, sf)), "ledger")  # texts are measured once, for policies and ablations
    judged = rows.withColumns({"base_failed": ~quality_rules.passes(("base", 1)), "kept": quality_rules.passes(policy), "decisive_rule": quality_rules.decisive(policy)})
    ablated = quality_rules.ablation(rows, policy).select(F.col("rule").alias("decisive_rule"), F.col("n_only").alias("n_decided"))
    return judged.join(F.broadcast(ablated), "decisive_rule", "left")  # a row for each rule


def op2_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = line_dedup.dedup(_documents(spark, sf))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    model = nbsvm.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    return nbsvm.score(docs, model)


def op4_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.join(_documents(spark, sf))


def op6_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = substrings.dedup(_documents(spark, sf))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_mixing(spark: SparkSession, sf: str) -> DataFrame:
    rows = mixing.mixed(_documents(spark, sf))
    return rows.select("doc_id", "source", "copy", "n_copies", "shuffle_key", F.md5("text").alias("text_md5"))


def op7_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_dedup.dedup(spark.read.parquet(f"{sf}/embeddings.parquet"))


def op8_token_files(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    token_files.write(_documents(spark, sf), folder, default_tokenizer())
    return token_files.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf))


def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.packed(_documents(spark, sf), default_tokenizer())
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    rows, conversations = prefix_trie.grafted(prefix_trie.turns(spark.read.parquet(f"{sf}/conversations.parquet")))
    return prefix_trie.trie(rows, conversations)


def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf}/embeddings.parquet"))


def op13_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.search(_documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, h: s + h["length"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_line_dedup,
        op3_quality_classifier,
        op4_jaccard_join,
        op5_mixing,
        op6_substring_dedup,
        op7_embedding_dedup,
        op8_token_files,
        op9_license_scan,
        op10_packing,
        op11_prefix_trie,
        op12_whitening,
        op13_decontamination,
    )
} | {"pipeline": corpus_pipeline.run}
_WORD = "[^\\x20\\x09-\\x0D]"
_BENCH_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]"
_RULES_SQL = [(1 << i, fails) for i, (_, fails) in enumerate(quality_rules.RULES)]

_OP1 = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '{_WORD}+') AS words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS lines FROM d
), places AS (
  SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3
), windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS n FROM places
), repeated AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper, CAST(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS BIGINT) AS n_letters
  FROM w LEFT JOIN repeated USING (r)
), b AS (
  SELECT *, CAST({" + ".join(f"CASE WHEN {fails} THEN {bit} ELSE 0 END" for bit, fails in _RULES_SQL)} AS BIGINT) AS failed_bits FROM m
)
SELECT *, (failed_bits & {quality_rules.mask(("base", 1))}) <> 0 AS base_failed, (failed_bits & {quality_rules.mask(("web", 2))}) = 0 AS kept,
  CASE failed_bits & {quality_rules.mask(("web", 2))} {" ".join(f"WHEN {quality_rules.BITS[r]} THEN '{r}'" for r in quality_rules.POLICIES[("web", 2)])} END AS decisive_rule,
  CASE WHEN decisive_rule IS NOT NULL THEN count(*) OVER (PARTITION BY decisive_rule) END AS n_decided
FROM b
"""

_OP5 = """
WITH RECURSIVE d AS (
  SELECT *, coalesce(source, '') AS s, CAST(coalesce(length(text), 0) + 1 AS BIGINT) AS mass FROM documents
), sizes AS (
  SELECT s, CAST(sum(mass) AS BIGINT) AS mass FROM d GROUP BY s
), rates AS (
  SELECT s, pow(CAST(mass AS DOUBLE), 0.5) / sum(pow(CAST(mass AS DOUBLE), 0.5)) OVER () * sum(mass) OVER () / mass AS rate FROM sizes
), cdf(s, rate, k, lp, c) AS (
  SELECT s, rate, 0, -rate, exp(-rate) FROM rates
  UNION ALL
  SELECT s, rate, k + 1, lp + ln(rate / (k + 1)), c + exp(lp + ln(rate / (k + 1))) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 30)
), u AS (
  SELECT doc_id, source, s, text, (CAST('0x' || substr(md5('17:' || doc_id), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM d
), n AS (
  SELECT doc_id, source, text, CAST((SELECT count(*) FROM cdf WHERE cdf.s = u.s AND cdf.c < u.u) AS INTEGER) AS n_copies FROM u
), copies AS (
  SELECT doc_id, source, text, n_copies, CAST(unnest(range(1, n_copies + 1)) AS INTEGER) AS copy FROM n WHERE n_copies > 0
)
SELECT doc_id, source, copy, n_copies, CAST('0x' || substr(md5('17:' || doc_id || ':' || copy), 1, 15) AS BIGINT) AS shuffle_key, md5(text) AS text_md5 FROM copies
"""

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_OP4 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '{_WORD}+') AS words FROM documents
), places AS (
  SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM w WHERE len(words) > 0
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(words[i:i + 4], ' ')) AS h FROM places
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach(doc_id, c) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT b, c FROM reach JOIN links ON a = reach.doc_id
), least AS (
  SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM w LEFT JOIN n USING (doc_id) JOIN least USING (doc_id)
"""

_OP6 = f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS words FROM documents
), places AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20
), windows AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 19], ' ')) AS h FROM places
), repeated AS (
  SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM repeated
), each_word AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j FROM w
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS text FROM each_word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    t = f"regexp_replace(lower(coalesce({text}, '')), {_quoted(licenses.COPYRIGHT_LINE)}, '\\1', 'g')"
    t = f"regexp_replace(replace({t}, {_quoted(licenses.RIGHTS)}, ''), {_quoted(licenses.NOT_WORD)}, ' ', 'g')"
    t = f"' ' || replace({t}, chr(10), ' ' || chr(10) || ' ') || ' '"
    for old, new in licenses.SPELLINGS:
        t = f"replace({t}, ' {old} ', ' {new} ')"
    return f"list_filter(list_transform(string_split({t}, chr(10)), lambda l: trim(l)), lambda l: l <> '')"


_OP9 = f"""
WITH texts(license_id, text) AS (
  VALUES {", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, all_ in licenses.KNOWN.items() for t in all_)}
), known AS (
  SELECT digest, min(license_id) AS license_id
  FROM (SELECT license_id, array_to_string({_canonical_sql("text")}, ' ') AS c, sha256(c) AS digest FROM texts) WHERE c <> '' GROUP BY digest
), d AS (
  SELECT doc_id, row_number() OVER () AS r, {_canonical_sql("text")} AS lines FROM documents
), found AS (
  SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS line_licenses, count(*) AS n
  FROM (SELECT r, sha256(line) AS digest FROM (SELECT r, unnest(lines) AS line FROM d)) JOIN known USING (digest) GROUP BY r
)
SELECT doc_id, sha256(array_to_string(lines, ' ')) AS digest, license_id, coalesce(line_licenses, '') AS line_licenses, CAST(coalesce(n, 0) AS BIGINT) AS n_license_lines
FROM d LEFT JOIN known ON known.digest = sha256(array_to_string(lines, ' ')) LEFT JOIN found USING (r)
"""

_OP11 = """
WITH raw AS (
  SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL
), rows_ AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, t) AS p FROM raw
), ops AS (
  SELECT DISTINCT conv_id, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])) AS o FROM raw
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_prepend(4294967295, o), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % 6 AS h FROM ops
), heads AS (
  SELECT c.conv_id, r.p AS depth, t, chars FROM convs c JOIN rows_ r ON r.conv_id = c.base AND r.p <= c.h
), shifted AS (
  SELECT conv_id, h, (SELECT count(*) FROM heads WHERE heads.conv_id = convs.conv_id) - h AS shift FROM convs
), turns AS (
  SELECT * FROM heads UNION ALL SELECT r.conv_id, r.p + shift, t, chars FROM rows_ r JOIN shifted USING (conv_id) WHERE r.p > h
), paths AS (
  SELECT conv_id, depth, string_agg(t, '') OVER (PARTITION BY conv_id ORDER BY depth) AS k, chars FROM turns
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs
), tips AS (
  SELECT conv_id, max(depth) AS depth, arg_max(k, depth) AS k FROM paths GROUP BY conv_id
), nodes AS (
  SELECT depth, md5(k) AS k, any_value(k[: (depth - 1) * 64]) AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars FROM paths GROUP BY depth, k
), kids AS (
  SELECT depth - 1 AS depth, md5(up) AS k, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), whole AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (depth, k)
), below AS (
  SELECT p.depth, md5(p.k) AS k, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((w.n - 1) * w.chars) AS saved
  FROM whole w JOIN paths p ON p.conv_id = w.conv_id AND p.depth <= w.depth GROUP BY ALL
), ends AS (
  SELECT depth, md5(k) AS k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM tips GROUP BY ALL
)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(w.n AS BIGINT) AS n_convs, CAST(w.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM whole w JOIN below b ON b.depth = w.depth AND b.k = w.k LEFT JOIN nodes p ON w.depth > 0 AND p.depth = w.depth - 1 AND p.k = md5(w.up) LEFT JOIN ends e ON e.depth = w.depth AND e.k = w.k
"""

_OP13 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '{_BENCH_WORD}+') AS words FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '{_BENCH_WORD}+') AS words FROM benchmark
), places AS (
  SELECT item, words, least(10, len(words)) AS m, unnest(range(1, greatest(2, len(words) - 8))) AS i FROM b WHERE len(words) > 0
), strings AS (
  SELECT DISTINCT item, m, md5(array_to_string(words[i:i + m - 1], ' ')) AS h FROM places
), lengths AS (
  SELECT DISTINCT m FROM strings
), spots AS (
  SELECT r, m, words, unnest(range(1, len(words) - m + 2)) AS i FROM d, lengths WHERE len(words) >= m
), found AS (
  SELECT a.r, a.i, a.m, item FROM (SELECT r, i, m, md5(array_to_string(words[i:i + m - 1], ' ')) AS h FROM spots) a JOIN strings USING (m, h)
), hit AS (
  SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS j FROM found) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

ORACLE: dict[str, str] = {"op11_prefix_trie": _OP11, "op13_decontamination": _OP13, "op1_quality_rules": _OP1, "op4_jaccard_join": _OP4, "op5_mixing": _OP5, "op6_substring_dedup": _OP6, "op9_license_scan": _OP9}
