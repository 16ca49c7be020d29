"""Corpus preparation: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``, and each works on all rows that the
stage before it kept.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.llm import bpe, mixing, simhash_similarity, substring, toxicity
from rillmark.llm.queries import TOXIC_FROM, table, vocabulary
from rillmark.llm.storage import materialise


#: Most rows of an Arrow batch in a stage that hands whole texts to Python; a bound on the memory of executors only.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to BATCH_ROWS, where they are more."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of ``labels`` scores below the limit."""
    bound_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out="__score").filter(F.col("__score") < TOXIC_FROM).drop("__score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five words, similarity 0.8): that with the smallest id."""
    bound_batches(spark)
    return simhash_similarity.keep_one_of_each(docs, shingle=5, similarity=0.8).select(docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of 20 words that stand earlier; a text that consists of such goes."""
    bound_batches(spark)
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = substring.deduplicate(docs, window=20, carry=(*rest, "n_chars")).filter("n_removed = 0 or n_removed < n_words")
    length = F.when(F.col("n_removed") == 0, F.col("carried_n_chars")).otherwise(F.length("text").cast("long"))
    return cut.select("doc_id", "text", *[F.col(f"carried_{c}").alias(c) for c in rest], length.alias("n_chars")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the curriculum takes, as often as it takes them, range-sorted in training order.

    The stage's columns are those of ``documents``, so the order is that of the
    files that it is written to and of the rows in them.
    """
    return mixing.training_order(mixing.curriculum(docs)).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the ids and of the bytes they decode to.

    ``part`` and ``place`` are the training order: the number of the file that
    the row came from and the row's place in it.  Both are null where ``docs``
    is not read from files.
    """
    bound_batches(spark)
    try:
        part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
        ordered = docs.select("*", part.alias("part"), F.col("_metadata.row_index").alias("place"))
    except AnalysisException:
        ordered = docs.select("*", *[F.lit(None).cast("long").alias(c) for c in ("part", "place")])
    encoded = bpe.encode_decode(ordered, *vocabulary(), keep=("part", "place", "lang", "source"))
    return bpe.token_digests(encoded, "doc_id", "part", "place", "lang", "source", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("source_mixing", mix_sources),
    ("byte_level_bpe", tokenize),
]

#: The first three stages are no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
