"""Retrieval metrics, comparison of runs and uncertainty."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Draws of a bootstrap that are held at once.
DRAWS = 1 << 20


def judge(ranking: DataFrame, relevant: DataFrame, questions: DataFrame, *, k: int = 10) -> DataFrame:
    """Metrics of every question: recall@1, recall@k (any and all), reciprocal rank, nDCG@k.

    ``ranking``: query_id, item, rank; an item counts at its best rank, ranks
    closed up.  ``relevant``: query_id, item.  A question without hits scores 0.
    """
    once = ranking.groupBy("query_id", "item").agg(F.min("rank").alias("rank"))
    once = once.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank", "item")))
    gold = relevant.select("query_id", "item").distinct()
    hits = once.filter(F.col("rank") <= k).join(gold, ["query_id", "item"], "left_semi")
    found = hits.groupBy("query_id").agg(
        F.min("rank").alias("first"), F.count("*").alias("n"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("gain")
    )
    size = gold.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    rows = questions.select("query_id").distinct().join(size, "query_id", "left").join(found, "query_id", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return rows.select(
        "query_id",
        F.coalesce("n_relevant", F.lit(0)).cast("long").alias("n_relevant"),
        F.coalesce((F.col("first") == 1).cast("int"), F.lit(0)).alias("recall_at_1"),
        F.when(F.col("n") > 0, 1).otherwise(0).alias("recall_any"),
        zero(F.col("n") / F.col("n_relevant")).alias("recall_all"),
        zero(1 / F.col("first")).alias("reciprocal_rank"),
        zero(F.col("gain") / F.when(F.col("n_relevant") > 0, ideal)).alias("ndcg"),
    )


def nearest_rank(rows: DataFrame, by: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """Nearest-rank percentiles of a group: the value at place ceil(share * n)."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    order = W.partitionBy(by).orderBy(value)
    upto = counted.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(W.partitionBy(by)))
    place = lambda p: F.greatest(F.ceil(F.round(F.col("n") * p * 100) / 100), F.lit(1))
    return upto.groupBy(by).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("upto") >= place(p), F.col(value))).alias(f"p{round(p * 100)}") for p in shares])


def movements(before: DataFrame, after: DataFrame) -> DataFrame:
    """Questions of two runs (query_id, first: rank of the first hit or null) and how they moved."""
    joined = after.select("query_id", F.col("first").alias("now")).join(before.select("query_id", F.col("first").alias("was")), "query_id")
    none = F.lit(1 << 30)
    was, now = F.coalesce("was", none), F.coalesce("now", none)
    kind = (
        F.when((was < none) & (now == none), "lost").when((was == 1) & (now > 1), "left first place")
        .when(now < was, "better").when(now > was, "worse").otherwise("same")
    )
    return joined.withColumn("movement", kind)


def bootstrap_interval(values: DataFrame, by: str, value: str, *, resamples: int = 1000, confidence: float = 0.95, seed: int = 20260824) -> DataFrame:
    """Percentile bootstrap of a group's mean: (by, n, mean, low, high); the seed makes it repeatable.

    Resamples are drawn some at a time, in one sequence, so what a task holds
    is a group's values and no more than ``DRAWS`` draws or one resample.
    """
    tail = (1 - confidence) / 2

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        own = np.sort(rows[value].to_numpy(dtype=np.float64))
        rng, many, means = np.random.default_rng(seed), max(1, DRAWS // len(own)), []
        for done in range(0, resamples, many):
            draws = rng.integers(0, len(own), size=(min(many, resamples - done), len(own)))
            means.append(own[draws].mean(axis=1))
        low, high = np.quantile(np.concatenate(means), [tail, 1 - tail])
        return pd.DataFrame({by: [key[0]], "n": [len(own)], "mean": [own.mean()], "low": [low], "high": [high]})

    kind = values.schema[by].dataType.simpleString()
    return values.filter(F.col(value).isNotNull()).select(by, value).groupBy(by).applyInPandas(run, f"{by} {kind}, n long, mean double, low double, high double")


def paired_delta(before: DataFrame, after: DataFrame, value: str, **options) -> DataFrame:
    """Bootstrap of the paired differences of two runs; ``verdict`` tells whether 0 is outside the interval."""
    pairs = before.select("query_id", F.col(value).alias("was")).join(after.select("query_id", F.col(value).alias("now")), "query_id")
    rows = bootstrap_interval(pairs.select(F.lit("all").alias("slice"), (F.col("now") - F.col("was")).cast("double").alias("delta")), "slice", "delta", **options)
    return rows.withColumn("verdict", F.when(F.col("low") > 0, "better").when(F.col("high") < 0, "worse").otherwise("undecided"))
