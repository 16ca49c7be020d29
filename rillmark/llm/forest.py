"""Approximate nearest neighbours by a forest of hash prefixes.

Every tree hashes a vector to a long string of hyperplane signs; a tree is the
sorted array of its strings, so all strings with a given prefix are one range.
A query descends in every tree to its longest matching prefix and ascends in
all trees together, one sign at a time, until the ranges hold enough
candidates, which are scored by exact cosine in double precision.

Rows are dealt to shards of bounded size and every shard holds a forest over
its rows; queries stream past every shard, and the best of all shards win.
The share of candidates is a parameter: vectors without structure need a large
one, since their neighbours are hardly nearer than the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import materialise
from .vectors import cosines, element_type, matrix, norms, vector_bytes

TREES, DEPTH = 64, 24
#: Share of a shard's rows that a query looks at, at least.
CANDIDATES = 0.3
#: Most rows of a shard; small tables are dealt to up to SPREAD shards of FEWEST rows at least.
SHARD_ROWS, SPREAD, FEWEST = 16_384, 64, 512


class Forest:
    """Sorted hash strings of one shard's vectors of one length."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, rows: np.ndarray, seed: int):
        self.keys, self.ids, self.rows, self.norms = keys, ids, rows, norms(rows)
        self.planes = np.random.default_rng([seed, rows.shape[1]]).standard_normal((rows.shape[1], TREES * DEPTH))
        strings = self.strings(rows)
        self.order = np.argsort(strings, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(strings.T, self.order, axis=1)

    def strings(self, rows: np.ndarray) -> np.ndarray:
        """Hash strings as numbers: rows x trees."""
        signs = (rows @ self.planes > 0).reshape(len(rows), TREES, DEPTH)
        return signs @ (1 << np.arange(DEPTH - 1, -1, -1, dtype=np.int64))

    def ranges(self, strings: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Range of each tree's strings that share the first ``level`` signs with each query: trees x queries."""
        low = strings >> (DEPTH - level) << (DEPTH - level)
        high = low + (1 << (DEPTH - level))
        return tuple(np.stack([np.searchsorted(self.sorted[t], x[:, t]) for t in range(TREES)]) for x in (low, high))

    def search(self, queries: np.ndarray, skip: np.ndarray, k: int, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and cosines of the k best candidates of every query, without the row that has the query's key."""
        enough = max(k + 1, int(np.ceil(share * len(self.ids))))
        strings, query_norms = self.strings(queries), norms(queries)
        ranges = [self.ranges(strings, level) for level in range(DEPTH + 1)]
        held = np.stack([(high - low).sum(axis=0) for low, high in ranges])
        for q in range(len(queries)):
            # ranges overlap between trees, so a level may hold fewer rows than its ranges' lengths add up to
            for level in range(int(np.flatnonzero(held[:, q] >= min(enough, len(self.ids)))[-1]), -1, -1):
                low, high = (x[:, q].tolist() for x in ranges[level])
                seen = np.zeros(len(self.ids), dtype=bool)
                for t in range(TREES):
                    seen[self.order[t, low[t] : high[t]]] = True
                if np.count_nonzero(seen) >= enough or level == 0:
                    break
            seen &= self.keys != skip[q]
            at = np.flatnonzero(seen)
            score = cosines(self.rows[at], self.norms[at], queries[q], query_norms[q])
            best = np.lexsort((self.ids[at], -score))[:k]
            yield self.ids[at][best], score[best]


def nearest(
    embeddings: DataFrame,
    is_query: Column,
    *,
    k: int = 5,
    share: float = CANDIDATES,
    seed: int = 1,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest rows found for every row where ``is_query`` holds, by cosine.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``, nearest
    first, ties to the smaller id; fewer rows if there are fewer candidates.
    Vectors that are null, empty, zero or hold null or non-finite components
    take no part, nor do rows with a null id; vectors of another length are no
    candidates.  Rows are told apart by a number of their own, not by their
    ids: of rows that repeat an id each is a query and each is a candidate for
    the others, so a query id that repeats has every rank as often.  Other
    columns are ignored.  An empty table gives none.
    """
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    dtype = element_type(rows.schema["v"].dataType)
    width = np.dtype(dtype).itemsize

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vector_bytes(batch.column(1), dtype), pa.binary()), batch.column(2)], names=["vec_id", "v", "q"])

    good = rows.filter("vec_id is not null").mapInArrow(read, "vec_id long, v binary, q boolean").filter("v is not null")
    # the numbers of the rows are fixed once the table is written
    good = materialise(good.withColumn("row", F.monotonically_increasing_id()), "vectors")
    count = good.count()
    shards = max(1, -(-count // SHARD_ROWS), min(SPREAD, count // FEWEST))
    indexed = good.select(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "row", "vec_id", "v")
    asked = good.filter("q").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "row", "vec_id", "v")
    partitions = max(1, int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    stream = indexed.unionByName(asked).repartition(partitions, "shard").sortWithinPartitions("shard", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, ids, blobs, forests = None, [], [], [], None
        none = np.zeros(0, dtype=np.int64)
        for batch in batches:
            shard, kind, row, vec = (np.asarray(batch.column(i)) for i in range(4))
            cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)]):
                if lo == hi:
                    continue
                own = batch.column(4).slice(lo, hi - lo).to_pylist()
                if shard[lo] != now:
                    now, keys, ids, blobs, forests = shard[lo], [], [], [], None
                if kind[lo] == 0:
                    keys.append(row[lo:hi])
                    ids.append(vec[lo:hi])
                    blobs += own
                    continue
                if forests is None:
                    forests = _forests(*(np.concatenate(x) if x else none for x in (keys, ids)), blobs, dtype, width, seed)
                out = []
                for size, at in _by_size(own, width):
                    if size in forests:
                        queries = matrix([own[i] for i in at], dtype)
                        for i, (found, score) in zip(at, forests[size].search(queries, row[lo + at], k, share)):
                            out.append((np.full(len(found), row[lo + i]), np.full(len(found), vec[lo + i]), found, score))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["query", "query_id", "vec_id", "score"])

    found = stream.mapInArrow(search, "query long, query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_size(blobs: list[bytes], width: int) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.array([len(b) // width for b in blobs])
    for size in np.unique(sizes).tolist():
        yield size, np.flatnonzero(sizes == size)


def _forests(keys: np.ndarray, ids: np.ndarray, blobs: list[bytes], dtype: str, width: int, seed: int) -> dict[int, Forest]:
    return {size: Forest(keys[at], ids[at], matrix([blobs[i] for i in at], dtype), seed) for size, at in _by_size(blobs, width)}
