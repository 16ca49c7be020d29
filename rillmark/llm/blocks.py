"""Comparing rows that share a key, in blocks of bounded size.

Rows come as (table, key, ...).  A key's rows are dealt into chunks, and every
pair of chunks is a unit of work of its own, so that a key with a third of all
rows becomes many bounded units instead of one task.  Nothing is dropped: each
pair of rows of a key meets in exactly one unit, or within its chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_pairs(rows: DataFrame, chunk_rows: int, salt: str) -> DataFrame:
    """Add ``ci`` and ``cj`` to rows with columns ``tab`` and ``key``; drop keys with one row.

    ``salt`` is the column whose hash deals a large key's rows to chunks.  Keys
    of up to ``chunk_rows`` rows stay whole (ci = cj = 0).
    """
    sizes = rows.groupBy("tab", "key").agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / F.lit(chunk_rows)).cast("int")
    dealt = rows.join(sizes, ["tab", "key"]).withColumn("parts", parts).drop("n")
    mine = F.pmod(F.xxhash64(F.col(salt)), F.col("parts")).cast("int")
    dealt = dealt.withColumn("mine", mine).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    )
    return (
        dealt.withColumn("ci", F.least("mine", "other"))
        .withColumn("cj", F.greatest("mine", "other"))
        .drop("parts", "other")
    )


def components_of(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Label 0..n-1 by the smallest index that the links left-right reach."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        np.minimum.at(label, before, label)
        label = label[label]
        if np.array_equal(label, before):
            return label


def whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut where the first four columns change, so that no unit is split."""
    kept: pa.RecordBatch | None = None
    for batch in batches:
        if kept is not None and kept.num_rows:
            batch = pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        names = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(4)], axis=1)
        same = (names == names[-1]).all(axis=1)
        end = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if end:
            yield batch.slice(0, end)
        kept = batch.slice(end)
    if kept is not None and kept.num_rows:
        yield kept
