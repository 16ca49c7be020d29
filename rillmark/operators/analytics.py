"""Skylines, ratings, samples, plans and forgetful sums."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def skyline(rows: DataFrame, cost: str, score: str, *, by: list[str] | None = None, tie: str = "id") -> DataFrame:
    """Rows that no cheaper or equally cheap row reaches: by rising cost, each with a score above all before.

    Costs are reduced to their best row first, which combines on the map side;
    without ``by`` the running maximum runs over what is left in one task.
    """
    key = list(by or [])
    others = [c for c in rows.columns if c not in (*key, cost)]
    best = rows.groupBy(*key, cost).agg(F.min_by(F.struct(*others), F.struct(-F.col(score), F.col(tie))).alias("row")).select(*key, cost, "row.*")
    before = F.max(score).over(W.partitionBy(*key).orderBy(cost).rowsBetween(W.unboundedPreceding, -1))
    return best.withColumn("__before", before).filter(F.col("__before").isNull() | (F.col(score) > F.col("__before"))).drop("__before")


def stratified(rows: DataFrame, by: str, order: str, target: int) -> DataFrame:
    """About ``target`` rows: of each stratum, by its share, every k-th row in order."""
    own = W.partitionBy(by)
    counted = rows.withColumn("__n", F.count("*").over(own)).withColumn("__rn", F.row_number().over(own.orderBy(order)))
    total = rows.agg(F.count("*").alias("__all"))
    counted = counted.crossJoin(F.broadcast(total))  # one row
    quota = F.greatest(F.lit(1), F.round(F.lit(target) * F.col("__n") / F.col("__all"))).cast("long")
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / quota))
    chosen = counted.filter((F.pmod(F.col("__rn") - 1, step) == 0) & (F.floor((F.col("__rn") - 1) / step) < quota))
    return chosen.drop("__n", "__rn", "__all")


def indexing_queue(files: DataFrame) -> DataFrame:
    """Files with ``wave`` and ``folder_score``, and their ``position`` in the queue.

    Small current files first; a folder with many files for its bytes goes before others.
    """
    folder = W.partitionBy("wave", "folder")
    scored = files.withColumn("folder_score", F.round(F.count("*").over(folder) / (1 + F.log1p(F.sum("size").over(folder))), 6))
    order = W.orderBy("wave", F.col("folder_score").desc(), "size", F.col("mtime").desc(), "path")
    return scored.withColumn("position", F.row_number().over(order))


def forgetful_sums(rows: DataFrame, by: str, order: str, sums: Mapping[str, tuple[str, Column]], *, forgetting: float, among: Mapping[str, Column]) -> DataFrame:
    """(by, n_<kind>..., sums...): sums of a group where every later value makes the earlier ones count a little less.

    ``among`` names kinds of rows by conditions; a sum (kind, value) takes rows
    of its kind only, and only these age one another.  A group is dealt out by
    ranges of its order; a range is summed up by itself, then aged by the
    numbers of rows after it, so no task takes a whole group.  Rows of one place
    are in the order of their values, so reruns agree.
    """
    part, ties = "__range", [F.col(f"__{name}").desc() for name in sums]
    last = W.partitionBy(by, part).orderBy(F.col(order).desc(), *ties).rowsBetween(W.unboundedPreceding, -1)
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    held = [F.coalesce(c, F.lit(False)).alias(f"__is_{kind}") for kind, c in among.items()]
    values = [value.cast("double").alias(f"__{name}") for name, (_, value) in sums.items()]
    dealt = rows.select(by, order, *held, *values).repartitionByRange(parts, by, order).withColumn(part, F.spark_partition_id())
    aged = dealt.select("*", *[F.pow(F.lit(forgetting), F.count_if(f"__is_{kind}").over(last)).alias(f"__age_{kind}") for kind in among])
    weighed = [F.sum(F.when(F.col(f"__is_{kind}"), F.col(f"__age_{kind}") * F.col(f"__{name}"))).alias(name) for name, (kind, _) in sums.items()]
    own = aged.groupBy(by, part).agg(*[F.count_if(f"__is_{kind}").alias(f"n_{kind}") for kind in among], *weighed)
    later = W.partitionBy(by).orderBy(F.col(part).desc()).rowsBetween(W.unboundedPreceding, -1)
    own = own.select("*", *[F.pow(F.lit(forgetting), F.coalesce(F.sum(f"n_{kind}").over(later), F.lit(0))).alias(f"__age_{kind}") for kind in among])
    return own.groupBy(by).agg(*[F.sum(f"n_{kind}").alias(f"n_{kind}") for kind in among], *[F.sum(F.col(f"__age_{kind}") * F.col(name)).alias(name) for name, (kind, _) in sums.items()])


def forgetful_means(rows: DataFrame, by: str, order: str, value: str, forgetting: float = 0.995) -> DataFrame:
    """Mean of a group's values where every later value makes the earlier ones count a little less."""
    sums = {"total": ("all", F.col(value)), "whole": ("all", F.lit(1.0))}
    got = forgetful_sums(rows, by, order, sums, forgetting=forgetting, among={"all": F.lit(True)})
    return got.select(by, F.round(F.col("total") / F.col("whole"), 6).alias("mean"), F.round("whole", 6).alias("weight"))


def merge_rules(rules: DataFrame) -> DataFrame:
    """Rules that read alike (letters and digits, any case) as one: first text, total use, highest confidence, all contexts."""
    key = F.regexp_replace(F.lower("rule"), "[^a-z0-9]", "")
    ordered = rules.withColumn("key", key)
    return ordered.groupBy("key").agg(
        F.min_by("rule", "id").alias("rule"), F.sum("used").alias("used"), F.max("confidence").alias("confidence"),
        F.expr("array_join(transform(array_sort(collect_list(struct(id, context))), x -> x.context), ' | ')").alias("contexts"), (F.count("*") - 1).alias("inactive"),
    )


def elo(races: DataFrame, *, by: str, order: str, winner: str, losers: str, k: float = 32.0, start: float = 1200.0) -> DataFrame:
    """Ratings (by, player, rating) after a ladder's races in order; a winner's rating moves between its losers.

    An ordered fold: one task per ladder, since every race needs the ratings before it.
    """
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rating: dict = {}
        for _, race in rows.sort_values(order).iterrows():
            won = race[winner]
            for lost in race[losers]:
                if lost == won:
                    continue
                a, b = rating.get(won, start), rating.get(lost, start)
                gain = round(k * (1 - 1 / (1 + 10 ** ((b - a) / 400))), 2)
                rating[won], rating[lost] = round(a + gain, 2), round(b - gain, 2)
        return pd.DataFrame({by: [key[0]] * len(rating), "player": list(rating), "rating": list(rating.values())})

    kinds = races.schema[by].dataType.simpleString(), races.schema[winner].dataType.simpleString()
    return races.select(by, order, winner, losers).groupBy(by).applyInPandas(run, f"{by} {kinds[0]}, player {kinds[1]}, rating double")


def least_squares(rows: DataFrame, *, by: str, order: str, x: str, y: str, forgetting: float = 0.995, ridge: float = 1e-3) -> DataFrame:
    """(by, intercept, slope): recursive least squares with forgetting, neither coefficient below 0.

    Six sums of a group are all that a fit needs.  The fit of both coefficients
    is the best if neither is below 0; else the best is one of those with fewer.
    """
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    # a value that is missing leaves its group without a fit, not with one of fewer rows
    nan = F.lit(float("nan"))
    a, b = F.coalesce(a, nan), F.coalesce(b, nan)
    values = {"w": F.lit(1.0), "x": a, "xx": a * a, "y": b, "xy": a * b}
    own = forgetful_sums(rows, by, order, {k: ("all", v) for k, v in values.items()}, forgetting=forgetting, among={"all": F.lit(True)})
    w, xx, cross = F.col("w") + ridge, F.col("xx") + ridge, F.col("x")
    least = w * xx - cross * cross
    both = F.array((xx * F.col("y") - cross * F.col("xy")) / least, (w * F.col("xy") - cross * F.col("y")) / least)
    alone = F.array(F.col("y") / w, F.lit(0.0)), F.array(F.lit(0.0), F.col("xy") / xx)
    # what each takes off the loss of no coefficient at all
    gain = F.col("y") * F.col("y") / w, F.col("xy") * F.col("xy") / xx
    fits = lambda fit: F.forall(fit, lambda c: ~F.isnan(c) & (c >= 0))
    first = F.when(fits(alone[0]) & (~fits(alone[1]) | (gain[0] >= gain[1])), alone[0]).when(fits(alone[1]), alone[1]).otherwise(F.array(F.lit(0.0), F.lit(0.0)))
    best = F.when(F.isnan(F.col("xx") + F.col("xy") + F.col("y")), F.array(F.lit(0.0), F.lit(0.0))).when(fits(both), both).otherwise(first)
    return own.select(by, best.alias("__best")).select(by, F.get("__best", F.lit(0)).alias("intercept"), F.get("__best", F.lit(1)).alias("slope"))


def remaining_time(items: DataFrame, *, by: str, expected: str, spread: str, draws: int = 2000, seed: int = 7) -> DataFrame:
    """(by, n, p50, p90) of the total of items whose durations are log-normal around what is expected."""
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        own = rows.sort_values([expected, spread])
        r = np.random.default_rng(seed)
        totals = np.zeros(draws)
        for mean, sigma in zip(own[expected], own[spread]):
            totals += mean * np.exp(r.normal(0, sigma, draws))
        middle, high = np.quantile(totals, [0.5, 0.9])
        return pd.DataFrame({by: [key[0]], "n": [len(own)], "p50": [middle], "p90": [max(middle, high)]})

    kind = items.schema[by].dataType.simpleString()
    return items.select(by, expected, spread).groupBy(by).applyInPandas(run, f"{by} {kind}, n long, p50 double, p90 double")


def debounce(changes: DataFrame, *, key: str, at: str, action: str, quiet_s: float = 0.8) -> DataFrame:
    """Changes that count: the last of each run of a key's changes less than ``quiet_s`` apart."""
    following = F.lead(at).over(W.partitionBy(key).orderBy(at, action))
    gap = (F.unix_micros(following.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 1e6
    return changes.withColumn("__gap", gap).filter(F.col("__gap").isNull() | (F.col("__gap") >= quiet_s)).drop("__gap")
