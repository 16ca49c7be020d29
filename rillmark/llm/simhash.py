"""Near-duplicate documents by SimHash fingerprints and pigeonhole blocks.

A 64-bit fingerprint is split into b blocks.  If two fingerprints differ in at
most d bits, at least b - d of their blocks are equal, so joining on every
choice of b - d blocks finds every such pair.  Pairs that share a choice are
verified by their Hamming distance.  Equal fingerprints are one class
throughout, and a crowded block value is compared in bounded chunk pairs, so a
large group of copies never meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .blocks import chunk_pairs, components_of, whole_units
from .components import connected_components
from .storage import materialise

SEED = 42
CHUNK_ROWS = 1024
_SHINGLES_AT_ONCE = 1 << 16


def shingle_slices(text: str | None, shingle: int) -> Iterator[list[bytes]]:
    """All word shingles of a whole text, A-Z folded, repeats included, some at a time; one if it is shorter."""
    words = (text or "").encode().lower().split()
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(length + 1) - 1
    size = min(shingle, len(words))
    starts, ends = (ends - length)[: len(words) - size + 1], ends[size - 1 if size else 0 :]
    for at in range(0, len(starts), _SHINGLES_AT_ONCE):
        s, e = starts[at : at + _SHINGLES_AT_ONCE].tolist(), ends[at : at + _SHINGLES_AT_ONCE].tolist()
        yield [joined[i:j] for i, j in zip(s, e)]


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit; bytes are added eight at a time, 255 rows before they could overflow."""
    if not len(hashes):
        return np.zeros(64, dtype=np.int64)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
    sums = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)
    return sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, shingle: int) -> int:
    """Unsigned 64-bit SimHash of one whole text; 0 if it has no words."""
    ones, count = np.zeros(64, dtype=np.int64), 0
    for slices in shingle_slices(text, shingle):
        ones += bit_counts(np.fromiter(map(xxh64_intdigest, slices, repeat(SEED)), dtype=np.uint64, count=len(slices)))
        count += len(slices)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fingerprint`` (BIGINT with the same bits) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("fingerprint", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=[id_col, "fingerprint"])

    return rows.mapInArrow(run, schema)


def block_masks(distance: int, rows: int) -> list[int]:
    """Bit masks of the choices of blocks to join on.

    The number of blocks grows until a choice has as many bits as it takes to
    tell ``rows`` fingerprints apart; every number of blocks over ``distance``
    finds every pair, so this changes cost only.
    """
    blocks = distance + 2
    while (64 // blocks) * (blocks - distance) < min(36, rows.bit_length()) and comb(blocks + 1, distance) <= 330:
        blocks += 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(parts, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links(unit: np.ndarray, prints: np.ndarray, node: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node) that span what is close within equal units; rows are sorted by unit."""
    names, index = np.unique(node, return_inverse=True)
    left, right, have = [], [], 0
    rows, shift = np.arange(len(unit) - 1), 1
    while len(rows := rows[: np.searchsorted(rows, len(unit) - shift)]):
        rows = rows[unit[rows] == unit[rows + shift]]
        near = rows[np.bitwise_count(prints[rows] ^ prints[rows + shift]) <= distance]
        left.append(index[near])
        right.append(index[near + shift])
        if (have := have + len(near)) > 1_000_000:
            label = components_of(len(names), np.concatenate(left), np.concatenate(right))
            moved = np.flatnonzero(label != np.arange(len(names)))
            left, right, have = [moved], [label[moved]], 0
        shift += 1
    if not left:
        return node[:0], node[:0]
    label = components_of(len(names), np.concatenate(left), np.concatenate(right))
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def hamming_components(prints: DataFrame, *, distance: int, id_col: str = "doc_id") -> DataFrame:
    """Add ``component_id``: the smallest id reachable by links of at most ``distance`` differing bits.

    ``prints`` has ``id_col`` (BIGINT) and ``fingerprint`` (BIGINT) and should
    be a written table: it is read several times.  Fingerprints are the nodes,
    so repeated rows, repeated ids and null ids link like any others; a group
    without an id has a null component.
    """
    classes = materialise(prints.groupBy("fingerprint").agg(F.min(id_col).alias("least")), "classes")
    masks = block_masks(distance, classes.count())
    tables = F.array(*[F.struct(F.lit(t).alias("tab"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])
    dealt = chunk_pairs(classes.select("fingerprint", F.inline(tables)), CHUNK_ROWS, "fingerprint")
    unit = ["tab", "key", "ci", "cj"]
    partitions = max(1, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.select(*unit, "fingerprint").repartition(partitions, *unit).sortWithinPartitions(*unit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_units(batches):
            keys = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(4)], axis=1)
            number = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))])
            node = np.asarray(batch.column(4))
            a, b = _links(number, node.view(np.uint64), node, distance)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    found = connected_components(dealt.mapInArrow(run, "a long, b long"))
    group = F.coalesce("component", "fingerprint").alias("group")
    grouped = classes.join(found, classes["fingerprint"] == found["node"], "left").select("fingerprint", "least", group)
    named = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    labelled = grouped.join(named, "group").select("fingerprint", "component_id")
    return prints.join(labelled, "fingerprint").select(id_col, "fingerprint", "component_id")


def near_duplicates(
    docs: DataFrame, *, shingle: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, ``fingerprint`` (BIGINT), ``component_id`` for every row of ``docs``.

    A null or empty text has fingerprint zero, linked like any other; a text
    shorter than a shingle is one shingle.  A null id is kept, and takes the
    smallest id of its group (null if it has none).  An empty table gives none.
    """
    return hamming_components(materialise(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col), "prints"), distance=distance, id_col=id_col)
