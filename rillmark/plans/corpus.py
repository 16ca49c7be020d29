"""The driver tables seen as a corpus: documents with paths, paragraphs as chunks, benchmark items as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables of whole texts, which are dealt out where their files have fewer splits than there are cores.
TEXTS = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name in TEXTS and rows.rdd.getNumPartitions() < cores else rows


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, size, mtime, sha of every document; no text."""
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", path.alias("path"), "source", "lang", F.octet_length("text").cast("long").alias("size"),
        (F.lit(1_700_000_000) + F.pmod(F.col("doc_id") * 7919, F.lit(10_000_000))).alias("mtime"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"),
    )


PATHS = """paths as (select doc_id, source || '/' || lang || '/doc_' || doc_id || '.txt' as path, source, lang,
    strlen(text)::bigint as size, (1700000000 + (doc_id * 7919) % 10000000)::bigint as mtime, sha256(text) as sha from documents)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ordinal, chunk_id, text: the paragraphs of every document."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    return rows.withColumn("chunk_id", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("ordinal").cast("string")))


CHUNKS = """chunks as (select doc_id, lang, source, (o - 1)::int as ordinal, t as text, doc_id || ':' || (o - 1) as chunk_id
    from (select doc_id, lang, source, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as o from documents))"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, item: documents that hold the question's text as whole words in a row."""
    from ..operators.lexical import phrase_hits

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return phrase_hits(questions(spark, sf_dir), docs).select("query_id", "item")


TOKENS = "regexp_extract_all(strip_accents(lower({0})), '[\\p{{L}}\\p{{N}}]+')"
