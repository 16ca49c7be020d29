"""Overviews, folder manifests, outlines, paged reads and cells."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overview(documents: DataFrame) -> DataFrame:
    """Counts, chunk total, dates and share of documents that are all right, in one row."""
    ok = F.count_if(F.col("status") == "ok")
    return documents.agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks"), F.min("mtime").alias("oldest"), F.max("mtime").alias("newest"),
        ok.alias("ok"), F.round(ok / F.count("*"), 4).alias("ok_share"),
    )


def most_frequent(rows: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The n most frequent values; ties by value."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), key).limit(n)


def census(files: DataFrame, axes: list[str]) -> DataFrame:
    """(axis, value, files, bytes, share): every axis counted in one scan by grouping sets."""
    long = files.select("size", F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes])))
    counted = long.groupBy("axis", "value").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return counted.withColumn("share", F.round(F.col("files") / F.sum("files").over(W.partitionBy("axis")), 6))


def outline(chunks: DataFrame, *, doc: str, order: str, trail: str, text: str) -> DataFrame:
    """Sections: runs of consecutive chunks with one trail; a trail that comes again later is a new section."""
    by = W.partitionBy(doc).orderBy(order)
    changed = F.coalesce((~F.col(trail).eqNullSafe(F.lag(trail).over(by))).cast("int"), F.lit(1))
    marked = chunks.withColumn("__first", F.when(F.row_number().over(by) == 1, 1).otherwise(changed))
    numbered = marked.withColumn("section", F.sum("__first").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(doc, "section").agg(
        F.first(trail).alias("trail"), F.min(order).alias("first"), F.count("*").alias("n_chunks"), F.sum(F.length(text)).alias("chars")
    )


def page(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """One page by offset, with the total and the offset of the next page (null on the last)."""
    total = rows.agg(F.count("*").alias("total"))
    got = rows.orderBy(*order).offset(offset).limit(limit)
    following = F.when(F.lit(offset + limit) < F.col("total"), F.lit(offset + limit))
    return got.crossJoin(F.broadcast(total)).withColumn("next", following)  # the total is one row


def cells(rows: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Spreadsheet cells (key, column, value) of a table's columns; empty cells have no row."""
    from ..functions.keys import column_letters

    parts = F.array(*[F.struct(column_letters(F.lit(i + 1)).alias("column"), F.col(c).cast("string").alias("value")) for i, c in enumerate(values)])
    return rows.select(*key, F.inline(parts)).filter("value is not null and value <> ''")


def keyset_page(rows: DataFrame, order: list[str], after: tuple | None, limit: int) -> DataFrame:
    """The next ``limit`` rows after a key; the scan is cut by the key and never by a count."""
    if after is not None:
        rows = rows.filter(F.struct(*order) > F.struct(*[F.lit(v).alias(c) for v, c in zip(after, order)]))
    return rows.orderBy(*order).limit(limit)


def pack(rows: DataFrame, *, by: str, order: list[str], size: str, budget: int) -> DataFrame:
    """Rows of each group, in order, as long as their sizes fit the budget together; ``used`` is the running size."""
    running = F.sum(size).over(W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("used", running).filter(F.col("used") <= budget)


def revision(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Fingerprint of a set of rows that no order changes: count and sum of row hashes."""
    digest = F.conv(F.substring(F.md5(F.to_json(F.struct(*columns)).cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.sum(digest).cast("string")), 256).alias("revision"))


def make_cursor(revision: str, offset: int) -> str:
    return base64.urlsafe_b64encode(json.dumps({"v": 1, "r": revision, "o": offset}).encode()).decode()


def read_cursor(cursor: str, revision: str) -> int:
    """Offset in an opaque cursor; a cursor of another state of the rows is refused."""
    found = json.loads(base64.urlsafe_b64decode(cursor))
    if found.get("v") != 1 or found.get("r") != revision:
        raise ValueError("the rows have changed since the cursor was made")
    return int(found["o"])


def slices(text: Column, most: int) -> Column:
    """Array of (start, part): a text in parts of at most ``most`` code points; one empty part for an empty text."""
    count = F.greatest(F.ceil(F.length(text) / most), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((i * most).alias("start"), F.substring(text, i * most + 1, F.lit(most)).alias("part")))


def canonical(blocks: DataFrame, *, doc: str, order: str, trail: str, text: str) -> DataFrame:
    """Blocks with the Markdown they add and its span in the document's canonical text.

    Headings are written by difference: only the levels below what a block's
    trail (an array) shares with the trail before it.
    """
    by = W.partitionBy(doc).orderBy(order)
    before = F.coalesce(F.lag(trail).over(by), F.array().cast("array<string>"))
    rows = blocks.withColumn("__was", before)
    same = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size(trail), F.lit(1))), F.lit(0),
        lambda n, i: F.when((n == i - 1) & (i <= F.size(trail)) & (i <= F.size("__was")) & (F.get(F.col(trail), i - 1) == F.get(F.col("__was"), i - 1)), i).otherwise(n),
    )
    rows = rows.withColumn("__same", same)
    heads = F.transform(F.col(trail), lambda h, i: F.when(i >= F.col("__same"), F.concat(F.repeat(F.lit("#"), i + 1), F.lit(" "), h, F.lit("\n\n"))))
    rows = rows.withColumn("__head", F.array_join(F.filter(heads, lambda h: h.isNotNull()), ""))
    rows = rows.withColumn("markdown", F.concat("__head", F.col(text), F.lit("\n\n")))
    upto = F.coalesce(F.sum(F.length("markdown")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = upto + F.length("__head")
    return rows.withColumn("start", start).withColumn("end", start + F.length(text)).drop("__was", "__same", "__head")
