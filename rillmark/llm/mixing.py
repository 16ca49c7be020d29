"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1]: linear from
its start to its end weight.  A source's demand is its target in words; its
cumulative demand D(t) is the target times the integral of its schedule, scaled
to end at the target.  A document that covers the words from u of its source's
stream is placed at the time t where D(t) = u, which inverts the cumulative
demand in closed form, and documents are range-sorted by that position.

Words are counted once, into a written table of ids, hashes and sizes; places
and ranks are found on that table alone, and whole rows move once, to be joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import running_before
from .storage import materialise

#: Copies per range of the sort, about, and the fewest ranges.
BIN_COPIES, LEAST_BINS = 1 << 16, 1024
#: Columns that a mix adds.
ADDED = ("__size", "__source_size", "__target", "__copies", "__positions", "__ranks")
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, *, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Target of every source: ``share`` of all words by weight, none above ``most`` times its own.

    ``sizes`` has one row per source: ``source`` and ``source_size``.  Sources in
    order of code point, null last, take the weights in turn.  Resharing the
    excess until no target is above its bound gives min(bound, weight * level)
    for one level, found here in one pass over the sources by bound per weight.
    """
    number = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    turn = (F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1).cast("int")
    weighed = sizes.withColumn("number", number).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn))
    bounded = weighed.withColumn("bound", most * F.col("source_size"))
    by_bound = W.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = W.partitionBy()
    spare = bounded.withColumn("all", F.lit(share) * F.sum("source_size").over(whole)).withColumn(
        "bound_before", F.coalesce(F.sum("bound").over(by_bound.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    ).withColumn("weight_from", F.sum("weight").over(by_bound.rowsBetween(0, W.unboundedFollowing)))
    # capping all before this source leaves this level; the first source below its bound at its level has the largest such
    level = spare.withColumn("level", (F.col("all") - F.col("bound_before")) / F.col("weight_from"))
    found = F.max(F.when(F.col("weight") * F.col("level") <= F.col("bound"), F.col("level"))).over(whole)
    return level.withColumn("target", F.least(F.col("bound"), F.coalesce(F.col("weight") * found, F.col("bound")))).select(
        "source", "source_size", "number", "weight", "target"
    )


def _time_of(part: Column, start: Column, end: Column) -> Column:
    """t where the integral of a linear schedule, scaled to 1 at t = 1, reaches ``part``."""
    # start * t + (end - start) * t^2 / 2 = part * (start + end) / 2, in the form that is stable when start = end
    area = part * (start + end) / 2
    return 2 * area / (start + F.sqrt(F.greatest(start * start + 2 * (end - start) * area, F.lit(0.0))))


def _ranks(copies: DataFrame, bins: int) -> DataFrame:
    """Add ``rank`` (from 0), the place of each copy after a range sort by position; rows without a position get null.

    Positions are cut into ranges; the totals of the ranges (one row per
    range) give each range its first rank, and each range is sorted by itself.
    """
    placed = copies.filter("position is not null").withColumn("bin", F.least(F.floor(F.col("position") * bins), F.lit(bins - 1)).cast("int"))
    totals = placed.groupBy("bin").agg(F.count("*").alias("held"))
    ahead = F.coalesce(F.sum("held").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    firsts = totals.select(F.col("bin").alias("range"), ahead.alias("first"))
    inside = F.row_number().over(W.partitionBy("bin").orderBy("position", "number", "at"))
    ranked = placed.withColumn("inside", inside).join(firsts, F.col("bin") == F.col("range"))
    ranked = ranked.withColumn("rank", F.col("first") + F.col("inside") - 1).select(*copies.columns, "rank")
    return ranked.unionByName(copies.filter("position is null").withColumn("rank", F.lit(None).cast("long")))


def curriculum(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    ramps: tuple[tuple[float, float], ...] = ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0)),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Every row of ``docs`` with what the mix takes of it and where.

    Adds ``__size`` (words), ``__source_size``, ``__target``, ``__copies`` (how
    often it is taken, at most ``most``), ``__positions`` (array of times in
    [0, 1], one per copy) and ``__ranks`` (array: each copy's place, from 0, in
    the training order).  Whole documents are taken: a source's stream repeats
    its documents in one fixed pseudo-random order, and a document is in the mix
    as often as the middle of its words lies below the target, so taken words
    miss the target by at most half a document.  ``ramps`` are the schedules
    (start, end) that sources take in turn.  Copies at one position are ordered
    by source, then by their place in its stream.

    A null or blank text has no words and is not taken; a null source is a
    source; repeated ids are told apart by their texts, and rows alike in both
    are interchangeable.  Columns of ``docs`` keep their values, whatever their
    names, but for one named like an added column, which is replaced.  An empty
    table gives an empty result.  Reruns give the same result.
    """
    spark = docs.sparkSession
    # columns are numbered while they are carried, so that no name clashes
    carried = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    name = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    row_id = F.coalesce(F.col(name[id_col]).cast("string"), F.lit(""))
    row_key = F.xxhash64(name[text_col], name[source_col])
    slim = carried.select(row_id.alias("id"), row_key.alias("key"), F.col(name[source_col]).alias("source"), word_count(F.col(name[text_col])).alias("size"))
    slim = materialise(slim, "sizes")
    bins = max(LEAST_BINS, int(slim.count() * most) // BIN_COPIES)
    plan = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, share=share, most=most)
    ramp = F.element_at(
        F.array(*[F.struct(F.lit(start).alias("a"), F.lit(end).alias("b")) for start, end in ramps]),
        (F.pmod(F.col("number") - 1, F.lit(len(ramps))) + 1).cast("int"),
    )
    plan = plan.select(F.col("source").alias("planned"), "number", "source_size", "target", ramp.alias("ramp"))
    placed = running_before(slim, "source", ["id", "key"], F.col("size"), "before", "id")
    joined = placed.join(plan, placed["source"].eqNullSafe(plan["planned"]))
    # the middle of each copy's words in its source's stream
    middles = F.transform(F.sequence(F.lit(0), F.lit(int(most) - 1)), lambda k: F.col("before") + k * F.col("source_size") + F.col("size") / 2)
    wanted = F.when(F.col("size") > 0, F.filter(middles, lambda u: u <= F.col("target"))).otherwise(F.filter(middles, lambda u: F.lit(False)))
    copies = joined.withColumn("at", F.explode_outer(wanted)).withColumn("position", _time_of(F.col("at") / F.col("target"), F.col("ramp.a"), F.col("ramp.b")))
    facts = ["id", "key", "before", "size", "source_size", "target"]
    found = _ranks(copies.select(*facts, "number", "at", "position"), bins).repartition("id", "key")
    taken = F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("at", "position", "rank"))))
    found = found.groupBy(*facts).agg(taken.alias("taken"))
    # rows alike in id and text have a place each, in an array; all others have an array of one
    plan_of = F.struct("before", "size", "source_size", "target", "taken")
    found = found.groupBy("id", "key").agg(F.sort_array(F.collect_list(plan_of)).alias("plans"))
    named = carried.withColumn("id", row_id).withColumn("key", row_key)
    named = named.withColumn("nth", F.row_number().over(W.partitionBy("id", "key").orderBy("key")))
    # alike rows without words share one place
    mixed = named.join(found, ["id", "key"]).withColumn("plan", F.element_at("plans", F.least(F.col("nth"), F.size("plans"))))
    added = [F.col("plan.size"), F.col("plan.source_size"), F.col("plan.target"), F.size("plan.taken"), F.col("plan.taken.position"), F.col("plan.taken.rank")]
    return mixed.select(*[F.col(name[c]).alias(c) for c in docs.columns if c not in ADDED], *[c.alias(a) for c, a in zip(added, ADDED)])


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per copy that the mix takes, range-sorted by ``position``, with its ``rank``.

    The ranges are equal parts of [0, 1], which demand fills about evenly, so
    no row is read to find them.  Columns of the input named ``position`` or
    ``rank`` are replaced.
    """
    parts = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = [c for c in mixed.columns if c not in (*ADDED, "position", "rank")]
    copies = mixed.select(*kept, F.explode(F.arrays_zip("__positions", "__ranks")).alias("__copy"))
    copies = copies.select(*kept, F.col("__copy.__positions").alias("position"), F.col("__copy.__ranks").alias("rank"))
    ranged = copies.repartitionById(parts, F.least(F.floor(F.col("position") * parts), F.lit(parts - 1)).cast("int"))
    return ranged.sortWithinPartitions("rank")
