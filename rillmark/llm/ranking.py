"""Exact running positions and sums inside large groups, without one task per group.

A group's rows are dealt to a fixed number of buckets by a hash of their id;
order is bucket first, then id.  Bucket totals (at most groups x BUCKETS rows)
give each bucket its offset, and only the rows of one bucket are sorted
together, so a group with a third of all rows is spread over BUCKETS tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 4096


def md5_part(id_col: str, first: int, digits: int) -> Column:
    """Some hexadecimal digits of the MD5 of the id as text, as a number; a null id counts as ''."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), first, digits), 16, 10).cast("long")


def bucket(id_col: str) -> Column:
    return F.pmod(md5_part(id_col, 17, 8), F.lit(BUCKETS)).cast("int")


def running_before(rows: DataFrame, group: str, order: list[str], value: Column, out: str, id_col: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the group that come before, and drop nothing.

    ``order`` must make a row's place definite among equal ids.  Null groups are
    one group.  ``value`` is a BIGINT expression.
    """
    dealt = rows.withColumn("__bucket", bucket(id_col)).withColumn("__value", value)
    totals = dealt.groupBy(group, "__bucket").agg(F.sum("__value").alias("__total"))
    ahead = W.partitionBy(group).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        F.col(group).alias("__group"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__total").over(ahead), F.lit(0)).alias("__offset")
    )
    inside = W.partitionBy(group, "__bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumn("__inside", F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    joined = placed.join(offsets, placed[group].eqNullSafe(offsets["__group"]) & (placed["__bucket"] == offsets["__b"]))
    return joined.withColumn(out, F.col("__offset") + F.col("__inside")).drop(
        "__bucket", "__value", "__inside", "__group", "__b", "__offset"
    )
