"""From raw documents to packed token sequences, in five stages of the llm operators.

Each stage works on all rows that the one before has kept and is written as Parquet before the next
one reads it. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import jaccard, line_dedup, mixing, packing, quality_rules
from loomspark.llm.tokens import default_tokenizer
from loomspark.session import forget, stored, temporaries


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go, null, empty and wordless texts among them (they have
    too few words). Repeated rows are each judged alike; an empty table stays empty; all columns stay."""
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and with them documents of which no word is left (null and empty texts too).
    Of equal lines the first by (doc_id, line number) stays, so of a repeated row nothing is lost twice:
    rows that share a doc_id are one document. Any column names may occur; an empty table stays empty."""
    clean = line_dedup.dedup(docs).select(*docs.columns)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast("long"))
    return clean.where("text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id. Of rows that
    share a doc_id one stays; rows with a null doc_id or without words stay. All columns stay."""
    return jaccard.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights by repeating documents, or leaving them out where the drawn
    count is 0. A null source is a source of its own, an empty text counts one character; rows with the
    same doc_id and source get the same count. Any column names may occur; an empty table stays empty."""
    return mixing.mixed(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are tokenized and packed into sequences; a null or empty text is its end id alone, a text of
    more than 2048 ids is cut, and every repeated row is packed on its own. Other columns are dropped;
    an empty table gives no pieces."""
    pieces = packing.packed(docs, default_tokenizer())
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_jaccard_join", near_duplicates), ("mixing", mix), ("packing", pack)]

#: Edit distance, tokenization and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage has stored on its way goes when its result is written, and the result goes when
    that of the next stage is; only the tables that the last stage reads stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with temporaries(spark) as made:
            result = stored(stage(spark, docs, sf_dir), name)
            made.remove(result.stored_at)
        forget(docs)
        docs = result
    return STAGES[-1][1](spark, docs, sf_dir)
