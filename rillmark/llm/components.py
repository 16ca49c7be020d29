"""Connected components of a link table, distributed.

Alternating large-star and small-star rounds (Kiveris et al., 2014): both
replace links by links to smaller nodes without changing what is connected,
until every node links directly to the smallest node of its component.  The
number of rounds grows with the logarithm of the longest chain; each round is
one aggregation with map-side combining and one join that Spark can split on
skew, so a node with very many links is no hot spot.  No links reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import remove, write

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest node in its neighbourhood."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, moves to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a > b")


def connected_components(links: DataFrame) -> DataFrame:
    """Component of every node that has a link to another node.

    ``links`` has the BIGINT columns ``a`` and ``b``; direction, repeats, self
    links and rows with a null end do not matter.  Returns ``node`` and
    ``component`` (smallest reachable node); nodes without links are absent.
    An empty table gives an empty result.
    """
    spark = links.sparkSession
    read = spark.read.schema(SCHEMA).parquet
    current = write(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    state = None
    while True:
        following = write(_small_star(_large_star(read(current)).distinct()).distinct(), "links")
        new_state = tuple(
            read(following).agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        )
        remove(spark, current)
        current = following
        if new_state == state:
            break
        state = new_state
    return read(current).select(F.col("a").alias("node"), F.col("b").alias("component"))
