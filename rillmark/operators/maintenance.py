"""Upserts, reconciliation, integrity and quarantine of index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows in place of old ones of the same key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def forget(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(gone.select(*key).distinct(), key, "left_anti")


def quarantine(old: DataFrame, failures: DataFrame, now: int, *, base_s: int = 3600, retire_after: int = 2, retire_s: int = 36_500 * 86_400) -> DataFrame:
    """Failures merged into the quarantine (path, hash, attempts, next_try).

    The same content counts on, other content starts at 1; the wait doubles with
    every attempt, and from ``retire_after`` attempts it is as good as forever.
    """
    was = old.select("path", F.col("hash").alias("__hash"), F.col("attempts").alias("__n"), F.col("next_try").alias("__next"))
    both = was.join(failures.select("path", "hash").distinct(), "path", "full_outer")
    failed = F.col("hash").isNotNull()
    attempts = F.when(~failed, F.col("__n")).when(F.col("hash") == F.col("__hash"), F.col("__n") + 1).otherwise(1)
    wait = F.when(attempts >= retire_after, F.lit(retire_s)).otherwise(base_s * F.pow(F.lit(2), attempts - 1))
    return both.select(
        "path", F.coalesce("hash", "__hash").alias("hash"), attempts.cast("long").alias("attempts"), F.when(failed, F.lit(now) + wait).otherwise(F.col("__next")).cast("long").alias("next_try")
    )


def prune_latest(rows: DataFrame, by: str, order: str, keep: int) -> DataFrame:
    """The ``keep`` newest rows of every group."""
    number = F.row_number().over(W.partitionBy(by).orderBy(F.col(order).desc()))
    return rows.withColumn("__n", number).filter(F.col("__n") <= keep).drop("__n")


def reconcile(registered: DataFrame, seen: DataFrame) -> DataFrame:
    """(path, state, target): what became of registered paths that a pass did not see.

    'moved' if the same content was seen under a path that isn't registered
    (the smallest such path), else 'removed'.
    """
    missing = registered.join(seen.select("path"), "path", "left_anti").select("path", "sha")
    fresh = seen.join(registered.select("path"), "path", "left_anti").groupBy("sha").agg(F.min("path").alias("target"))
    return missing.join(fresh, "sha", "left").select("path", F.when(F.col("target").isNull(), "removed").otherwise("moved").alias("state"), "target")


def may_delete(removed: int, registered: int, complete: bool, *, floor: int = 10, share: float = 0.2, force: bool = False) -> bool:
    """Whether a pass may delete: it was complete, and neither ten nor a fifth of the registry is gone."""
    return complete and (force or removed < floor or removed <= share * registered)


def integrity(registered: DataFrame, vectors: DataFrame) -> DataFrame:
    """(finding, n) of a registry (id, model) against stored vectors (id, model)."""
    stored = vectors.groupBy("id").agg(F.count("*").alias("copies"), F.max("model").alias("stored"))
    both = registered.select("id", F.col("model").alias("model")).withColumn("known", F.lit(True)).join(stored, "id", "full_outer")
    finding = (
        F.when(F.col("known").isNull(), "orphan").when(F.col("copies").isNull() & F.col("model").isNull(), "draft")
        .when(F.col("copies").isNull(), "missing").when(F.col("copies") > 1, "duplicate").when(~F.col("model").eqNullSafe(F.col("stored")), "other model").otherwise("ok")
    )
    return both.groupBy(finding.alias("finding")).agg(F.count("*").alias("n"))


def collisions(files: DataFrame) -> DataFrame:
    """(path, roots): relative paths that stand under more than one root."""
    return files.groupBy("path").agg(F.countDistinct("root").alias("roots")).filter("roots > 1")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, n): rows of each table, with repeats, that the other lacks; empty if they are equal."""
    only = a.exceptAll(b).select(F.lit("left").alias("side")).unionByName(b.exceptAll(a).select(F.lit("right").alias("side")))
    return only.groupBy("side").agg(F.count("*").alias("n"))


def frozen(old: DataFrame, now: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change): removed, added and changed rows by a fingerprint of their fields."""
    def printed(rows: DataFrame, name: str) -> DataFrame:
        lines = [F.concat(F.lit(f"{f}="), F.coalesce(F.trim(F.regexp_replace(F.col(f).cast("string"), r"\s+", " ")), F.lit(""))) for f in sorted(fields)]
        return rows.select(key, F.sha2(F.concat_ws("\n", *lines), 256).alias(name))

    both = printed(old, "was").join(printed(now, "is"), key, "full_outer")
    change = F.when(F.col("is").isNull(), "removed").when(F.col("was").isNull(), "added").when(F.col("was") != F.col("is"), "changed")
    return both.select(key, change.alias("change")).filter("change is not null")
