"""Near-duplicate embeddings by random-hyperplane sign hashing.

Every vector gets a key of ``bits`` signs in each of several tables; vectors
that share a key in a table are compared by exact cosine in double precision.
Bits grow with the logarithm of the number of vectors and tables follow, so
that a pair at the threshold is missed with a probability below ``miss``.

Equal vectors are one class throughout, with a number of its own; ids come in
at the end only.  Keys travel with a sketch of 256 further signs, and only the
rows whose sketch is close to another's under the same key get their vectors,
so bytes grow with the tables by keys and sketches alone.  A crowded key is
compared in bounded chunk pairs.  A pair that meets in several tables counts in
the first of them.  Compared blocks pass on counts and a spanning forest, never
their pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import chunk_pairs, components_of, whole_units
from .components import connected_components
from .storage import materialise
from .vectors import element_type, matrix, norms, vector_bytes

CHUNK_ROWS = 512
MISS = 1e-6
#: 64-bit words of a sketch, and the standard deviations by which a pair at the threshold may differ from what is expected.
SKETCH, SPREAD = 4, 6.0


def plan(vectors: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Bits per key and number of tables."""
    bits = max(8, math.ceil(math.log2(max(1, vectors) / 256)))
    agree = 1 - math.acos(threshold) / math.pi
    return bits, math.ceil(math.log(miss) / math.log1p(-(agree**bits)))


def sketch_distance(threshold: float) -> int:
    """Most differing sketch bits of a pair that is looked at; one at the threshold exceeds it with a probability of about 1e-9."""
    bits, share = 64 * SKETCH, math.acos(threshold) / math.pi
    return math.ceil(bits * share + SPREAD * math.sqrt(bits * share * (1 - share)))


def _planes(size: int, columns: int, seed: int) -> np.ndarray:
    """Normals of the hyperplanes for vectors of this length: first those of the tables, then the sketch's."""
    return np.random.default_rng([seed, size]).standard_normal((size, columns + 64 * SKETCH))


def _units(blobs: list[bytes], dtype: str) -> np.ndarray:
    rows = matrix(blobs, dtype)
    return rows / norms(rows)[:, None]


def _keys(units: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """Keys of unit vectors in every table: rows x tables."""
    signs = (units @ planes > 0).reshape(len(units), -1, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def near_duplicates(
    embeddings: DataFrame, *, threshold: float = 0.95, miss: float = MISS, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for every row.

    ``n_links`` is the number of other rows linked directly (cosine at least
    ``threshold``), ``component_id`` the smallest id reachable by links, itself
    included.  Vectors of unequal length never link.  Vectors that are null,
    zero, or hold null or non-finite components link with nothing.  Every row
    is compared by its vector, whatever its id: rows that repeat an id link
    like others.  A null id is kept, counts as a link and joins groups; it names
    a component only where no id is known (then null).  Other columns are
    ignored.  An empty table gives an empty result.
    """
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    # components stay as they came; all arithmetic is in doubles
    dtype = element_type(rows.schema["v"].dataType)
    width = np.dtype(dtype).itemsize

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vector_bytes(batch.column(1), dtype), pa.binary())], names=["vec_id", "v"])

    vectors = materialise(rows.mapInArrow(read, "vec_id long, v binary").withColumn("class", F.sha2("v", 256)), "vectors")
    classes = vectors.filter("v is not null").groupBy("class").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    # the numbers are fixed once the table is written
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    bits, tables = plan(classes.count(), threshold, miss)

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            blobs = batch.column(1).to_pylist()
            sizes = np.array([len(b) // width for b in blobs])
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                units = _units([blobs[i] for i in at], dtype)
                if size not in made:
                    made[size] = _planes(size, tables * bits, seed)
                keys = _keys(units, made[size][:, : tables * bits], bits)
                sketches = np.packbits(units @ made[size][:, tables * bits :] > 0, axis=1)
                offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * tables)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at)),
                        pa.array([x.tobytes() for x in sketches], pa.binary()),
                        pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1).astype(np.int32))),
                        pa.array(np.full(len(at), size)),
                    ],
                    names=["node", "sketch", "keys", "size"],
                )

    hashed = classes.select("node", "v").mapInArrow(hash_all, "node long, sketch binary, keys array<int>, size long")
    keyed = materialise(hashed.select("node", "sketch", "size", F.posexplode("keys").alias("tab", "code")), "keys")
    # vectors of unlike lengths never share a key
    keyed = keyed.select("tab", (F.col("size") * F.lit(1 << 32) + F.col("code")).alias("key"), "node", "sketch")
    unit = ["tab", "key", "ci", "cj"]
    partitions = max(1, int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = chunk_pairs(keyed, CHUNK_ROWS, "node").select(*unit, "mine", "node", "sketch")
    dealt = dealt.repartition(partitions, *unit).sortWithinPartitions(*unit)
    most = sketch_distance(threshold)

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_units(batches):
            ci, cj, mine = (np.asarray(batch.column(i)) for i in (2, 3, 4))
            sketches = np.frombuffer(b"".join(batch.column(6).to_pylist()), dtype=np.uint64).reshape(-1, SKETCH)
            close = np.zeros(len(mine), dtype=bool)
            for lo, hi in _units_of(batch):
                own = sketches[lo:hi]
                near = sum(np.bitwise_count(own[:, None, w] ^ own[None, :, w]).astype(np.int16) for w in range(SKETCH)) <= most
                np.fill_diagonal(near, False)
                if ci[lo] != cj[lo]:
                    near &= mine[lo:hi, None] != mine[None, lo:hi]
                close[lo:hi] = near.any(axis=1)
            yield batch.select([0, 1, 2, 3, 4, 5]).filter(pa.array(close))

    screened = dealt.mapInArrow(screen, "tab int, key long, ci int, cj int, mine int, node long")
    screened = screened.join(classes.select("node", "n", "v"), "node").select(*unit, "mine", "node", "n", "v")
    screened = screened.repartition(partitions, *unit).sortWithinPartitions(*unit)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in whole_units(batches):
            tab, ci, cj, mine, node, n = (np.asarray(batch.column(i)) for i in (0, 2, 3, 4, 5, 6))
            counts, edges = [], []
            for lo, hi in _units_of(batch):
                blobs = batch.column(7).slice(lo, hi - lo).to_pylist()
                found = _compare_unit(blobs, mine[lo:hi] if ci[lo] != cj[lo] else None, threshold, dtype)
                if found is None:
                    continue
                left, right, units = found
                size = units.shape[1]
                if size not in made:
                    made[size] = _planes(size, tables * bits, seed)
                # pairs that meet in an earlier table count there
                some, places = np.unique(np.concatenate([left, right]), return_inverse=True)
                keys = _keys(units[some], made[size][:, : int(tab[lo]) * bits], bits)
                first = ~(keys[places[: len(left)]] == keys[places[len(left) :]]).any(axis=1)
                left, right = left[first], right[first]
                if not len(left):
                    continue
                total = np.zeros(hi - lo, dtype=np.int64)
                np.add.at(total, left, n[lo + right])
                np.add.at(total, right, n[lo + left])
                linked = np.flatnonzero(total)
                counts.append((node[lo + linked], total[linked]))
                label = components_of(hi - lo, left, right)
                moved = np.flatnonzero(label != np.arange(hi - lo))
                edges.append((node[lo + moved], node[lo + label[moved]]))
            if counts:
                a = np.concatenate([x for x, _ in counts] + [x for x, _ in edges])
                b = np.concatenate([np.zeros(len(x), dtype=np.int64) for x, _ in counts] + [y for _, y in edges])
                linked = np.concatenate([y for _, y in counts] + [np.zeros(len(x), dtype=np.int64) for x, _ in edges])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(linked)], names=["a", "b", "linked"])

    found = materialise(screened.mapInArrow(compare, "a long, b long, linked long"), "found")
    components = connected_components(found.filter("linked = 0").select("a", "b"))
    links = found.filter("linked > 0").groupBy("a").agg(F.sum("linked").alias("linked"))
    labelled = (
        classes.select("class", "node", "n", "least")
        .join(links, F.col("node") == links["a"], "left")
        .join(components.withColumnRenamed("node", "c"), F.col("node") == F.col("c"), "left")
        .select("class", "least", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("group"))
    )
    named = labelled.groupBy("group").agg(F.min("least").alias("component_id"))
    labelled = labelled.join(named, "group").select("class", "n_links", "component_id")
    result = vectors.select("vec_id", "class").filter("class is not null").join(labelled, "class")
    alone = vectors.filter("class is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return result.select("vec_id", "n_links", "component_id").unionByName(alone).withColumn("kept", F.col("component_id").eqNullSafe(F.col("vec_id")))


def _units_of(batch: pa.RecordBatch) -> list[tuple[int, int]]:
    """First and last place of each unit of more than one row; rows are sorted by unit."""
    names = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(4)], axis=1)
    cuts = (np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist()
    return [(lo, hi) for lo, hi in zip([0, *cuts], [*cuts, len(names)]) if hi - lo > 1]


def _compare_unit(blobs: list[bytes], mine: np.ndarray | None, threshold: float, dtype: str):
    """Pairs (i < j) of a unit's rows that link, across chunks only where ``mine`` is given, and the unit vectors; None if there are none."""
    units = _units(blobs, dtype)
    left, right = np.nonzero(units @ units.T >= threshold - 1e-9)
    upper = left < right if mine is None else (left < right) & (mine[left] != mine[right])
    left, right = left[upper], right[upper]
    exact = (units[left] * units[right]).sum(axis=1) >= threshold
    left, right = left[exact], right[exact]
    return (left, right, units) if len(left) else None
