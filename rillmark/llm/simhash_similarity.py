"""Near-duplicate documents at a Jaccard similarity of word shingles, by wide SimHash fingerprints.

Two texts whose shingle sets have Jaccard similarity J differ in a share of
arccos(2J / (1 + J)) / pi of their SimHash bits.  At J = 0.8 that is 15 bits in
100, too many for exact pigeonhole blocks to tell texts apart, so a fingerprint
here has 512 bits and is split into blocks several times over, after fixed
permutations: two texts at the threshold share one of the blocks with a
probability of 1 - miss.  Pairs that share a block are verified by Hamming
distance; of the close pairs of a unit of work those that span it with the
least distances go on, and these are verified by the exact similarity.  A
spanning tree of least distances joins whatever the close pairs join, so a
crowded group costs one pair per member and not its square; but a pair of the
tree that fails the exact check may have displaced one that would hold.  So
where failed pairs leave a group of close texts in several parts, all pairs
across its parts are verified exactly, in units of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from .blocks import chunk_pairs, components_of, whole_units
from .components import connected_components
from .simhash import SEED, bit_counts, shingle_slices
from .storage import materialise

WORDS = 8
BITS = 64 * WORDS
MISS = 0.01
CHUNK_ROWS = 512
#: Odd multipliers that derive further hashes of a shingle from its first.
_MULTIPLIERS = np.array([2 * (0x9E3779B97F4A7C15 * (i + 1) >> 1 & (1 << 62) - 1) + 1 for i in range(WORDS)], dtype=np.uint64)


def expected_share(similarity: float) -> float:
    """Share of bits in which two texts of this Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def plan(texts: int, similarity: float, miss: float = MISS) -> tuple[int, int, int]:
    """Bits per block, number of blocks, and the distance up to which pairs are looked at exactly."""
    share = expected_share(similarity)
    bits = max(12, math.ceil(math.log2(max(2, texts))) - 5)
    tables = math.ceil(math.log(miss) / math.log1p(-((1 - share) ** bits)))
    return bits, tables, math.ceil(BITS * share + 3 * math.sqrt(BITS * share * (1 - share)))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, ASCII case folded; its only one if it is shorter."""
    slices = [s for part in shingle_slices(text, shingle) for s in part]
    return np.unique(np.fromiter(map(xxh64_intdigest, slices, repeat(SEED)), dtype=np.uint64, count=len(slices)))


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """SimHash of 512 bits of a set of shingle hashes."""
    ones = np.zeros((WORDS, 64), dtype=np.int64)
    for i, m in enumerate(_MULTIPLIERS):
        x = hashes * m
        ones[i] = bit_counts((x ^ (x >> np.uint64(32))) * m)
    return np.packbits(2 * ones.reshape(-1) > len(hashes), bitorder="little").tobytes()


def _spanning(left: np.ndarray, right: np.ndarray, distance: np.ndarray, n: int) -> np.ndarray:
    """Places of pairs that form a spanning forest of least distances (Boruvka's rounds)."""
    order = np.lexsort((right, left, distance))
    label, chosen = np.arange(n), []
    while len(order):
        a, b = label[left[order]], label[right[order]]
        order, a, b = order[a != b], a[a != b], b[a != b]
        if not len(order):
            break
        both = np.concatenate([a, b])
        best = np.full(n, len(order))
        np.minimum.at(best, both, np.concatenate([np.arange(len(order))] * 2))
        picked = np.unique(best[np.unique(both)])
        chosen.append(order[picked])
        step = components_of(n, a[picked], b[picked])
        label = step[label]
    return np.concatenate(chosen) if chosen else np.zeros(0, dtype=np.int64)


def _cross_links(part: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links by exact similarity that join the parts of one unit as far as all pairs across parts would."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(size) - size
    part, marked = np.unique(part, return_inverse=True)[1], np.zeros(len(names), dtype=bool)
    left, right = [], []
    for i in range(len(sets) - 1):
        later = np.arange(i + 1, len(sets))
        fit = np.minimum(size[later], size[i]) >= similarity * np.maximum(size[later], size[i])
        later = later[fit & (part[later] != part[i])]
        if not len(later):
            continue
        own = flat[starts[i] : starts[i] + size[i]]
        marked[own] = True
        n = size[later]
        ends = np.cumsum(n)
        places = np.arange(ends[-1]) + np.repeat(starts[later] - (ends - n), n)
        common = np.add.reduceat(marked[flat[places]].astype(np.int64), ends - n)
        marked[own] = False
        for j in later[common >= similarity * (n + size[i] - common)].tolist():
            if part[j] != part[i]:
                left.append(i)
                right.append(j)
                part[part == part[j]] = part[i]
    return left, right


def near_duplicates(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``text_key``, ``group`` and ``component_id`` of every row of ``docs``.

    Texts with equal sets of word shingles are always in one group; others are
    linked by a Jaccard similarity of at least ``similarity`` of these sets.
    Texts without words (null, empty, blank) form one group.  ``group`` is a
    number of the group, ``component_id`` its smallest id, null if it has none;
    ``text_key`` is the hexadecimal MD5 of the text (null: of the empty text),
    which tells rows of one id apart.  Every row is compared by its text,
    whatever its id.  Other columns are ignored.  An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("text_key"))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(t.as_py(), shingle) for t in batch.column(1)]
            columns = [
                batch.column(0),
                batch.column(2),
                pa.array([xxh3_128_digest(h.tobytes()) for h in hashes], pa.binary()),
                pa.array([wide_fingerprint(h) for h in hashes], pa.binary()),
                pa.array([len(h) for h in hashes], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text_key", "set", "print", "size"])

    printed = materialise(rows.mapInArrow(prints, "id long, text_key string, set binary, print binary, size long"), "prints")
    least = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "text_key"))
    named = printed.groupBy("set").agg(F.first("print").alias("print"), F.first("size").alias("size"), least.alias("least"))
    # the numbers are fixed once the table is written
    classes = materialise(named.withColumn("node", F.monotonically_increasing_id()), "classes")
    bits, tables, most = plan(classes.count(), similarity)
    per_round = BITS // bits

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = [np.random.default_rng(i).permutation(BITS) for i in range(-(-tables // per_round))]
        picks = np.concatenate([o[: per_round * bits] for o in orders]).reshape(-1, bits)[:tables]
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
            keys = np.unpackbits(raw, axis=1, bitorder="little")[:, picks] @ weights
            tab = np.tile(np.arange(tables, dtype=np.int32), batch.num_rows)
            node = np.repeat(np.asarray(batch.column(1)), tables)
            yield pa.RecordBatch.from_arrays([pa.array(tab), pa.array(keys.reshape(-1)), pa.array(node)], names=["tab", "key", "node"])

    keyed = classes.filter("size > 0").select("print", "node").mapInArrow(blocks, "tab int, key long, node long")
    unit = ["tab", "key", "ci", "cj"]
    dealt = chunk_pairs(keyed, CHUNK_ROWS, "node").join(classes.select("node", "print", "size"), "node")
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.select(*unit, "node", "size", "print").repartition(partitions, *unit).sortWithinPartitions(*unit, "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_units(batches):
            names = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(4)], axis=1)
            number = np.concatenate([[0], np.cumsum((names[1:] != names[:-1]).any(axis=1))])
            node, size = np.asarray(batch.column(4)), np.asarray(batch.column(5))
            raw = np.frombuffer(b"".join(batch.column(6).to_pylist()), dtype=np.uint64).reshape(-1, WORDS)
            left, right, distance, shift = [], [], [], 1
            at = np.arange(len(number) - 1)
            while len(at := at[: np.searchsorted(at, len(number) - shift)]):
                at = at[number[at] == number[at + shift]]
                # sets of these sizes can't reach the similarity otherwise
                fit = at[np.minimum(size[at], size[at + shift]) >= similarity * np.maximum(size[at], size[at + shift])]
                apart = np.bitwise_count(raw[fit] ^ raw[fit + shift]).sum(axis=1, dtype=np.int64)
                near = apart <= most
                left.append(fit[near])
                right.append(fit[near] + shift)
                distance.append(apart[near])
                shift += 1
            if not left:
                continue
            left, right, distance = np.concatenate(left), np.concatenate(right), np.concatenate(distance)
            spans = _spanning(left, right, distance, len(number))
            if len(spans):
                a, b = node[left[spans]], node[right[spans]]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    pairs = materialise(dealt.mapInArrow(compare, "a long, b long").filter("a <> b").distinct(), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # a text of each class that has a pair: that of its least row
    wanted = classes.join(ends, classes["node"] == ends["id"]).select(
        F.col("node"), F.col("least.id").alias("least_id"), F.col("least.text_key").alias("least_key")
    )
    same = rows["id"].eqNullSafe(wanted["least_id"]) & (rows["text_key"] == wanted["least_key"])
    texts = rows.join(wanted, same).groupBy(F.col("node").alias("id")).agg(F.min("text").alias("text"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                left, right = shingle_hashes(x.as_py(), shingle), shingle_hashes(y.as_py(), shingle)
                common = len(np.intersect1d(left, right, assume_unique=True))
                good.append(common >= similarity * (len(left) + len(right) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], names=["a", "b", "good"])

    joined = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b"
    )
    verified = materialise(joined.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long, good boolean"), "verified")
    found = connected_components(verified.filter("good"))
    parts = materialise(ends.join(found, ends["id"] == found["node"], "left").select("id", F.coalesce("component", "id").alias("part")), "parts")
    found = parts.select(F.col("id").alias("node"), F.col("part").alias("component"))
    failed = verified.filter("not good").join(parts.select(F.col("id").alias("a"), F.col("part").alias("pa")), "a")
    failed = failed.join(parts.select(F.col("id").alias("b"), F.col("part").alias("pb")), "b").filter("pa <> pb")
    failed = materialise(failed.select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "failed")
    if not failed.isEmpty():
        more = connected_components(_links_across_parts(failed, parts, texts, shingle, similarity))
        found = found.join(more.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component", "left").select(
            "node", F.coalesce("whole", "component").alias("component")
        )
    grouped = classes.join(found, classes["node"] == found["node"], "left").select("set", "least", F.coalesce("component", classes["node"]).alias("group"))
    smallest = grouped.groupBy("group").agg(F.min("least.id").alias("component_id"))
    labelled = grouped.join(smallest, "group").select("set", "group", "component_id")
    return printed.join(labelled, "set").select(F.col("id").alias(id_col), "text_key", "group", "component_id")


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def keep_one_of_each(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row with the smallest id stays.

    Rows without an id come last, rows of one id by their ``text_key``; of rows
    alike in both the one stays whose columns, written as JSON, have the least
    MD5.  All columns are kept, whatever their names and types.  An empty
    table gives an empty result.
    """
    groups = near_duplicates(docs, shingle=shingle, similarity=similarity, id_col=id_col, text_col=text_col)
    order = F.min(F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), "text_key"))
    winners = groups.groupBy("group").agg(order.alias("least")).select(F.col("least.id").alias("least_id"), F.col("least.text_key").alias("least_key"))
    # columns travel in one struct, so that no name clashes
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("key"), F.struct("*").alias("row"))
    kept = rows.join(winners, rows["id"].eqNullSafe(winners["least_id"]) & (rows["key"] == winners["least_key"]), "left_semi")
    one = kept.groupBy("id", "key").agg(F.min_by("row", F.md5(F.to_json("row").cast("binary"))).alias("row"))
    return one.select("row.*")


def _links_across_parts(failed: DataFrame, parts: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links between parts (``a``, ``b``) by any two of their texts, among parts that failed pairs join to one group.

    The largest part of a group is not compared within itself: its chunks meet
    the chunks of the other rows only.
    """
    groups = connected_components(failed)
    # a group's smallest node stands there as a component only
    groups = groups.unionByName(groups.select(F.col("component").alias("node"), "component").distinct())
    sizes = parts.join(groups, parts["part"] == groups["node"]).groupBy("component", "part").agg(F.count("*").alias("n"))
    most = sizes.groupBy("component").agg(F.sum("n").alias("all"), F.max(F.struct("n", "part")).alias("main"))
    small = F.col("all") <= CHUNK_ROWS
    chunks = lambda n: F.ceil(n / F.lit(CHUNK_ROWS)).cast("int")
    most = most.select(
        F.col("component").alias("key"),
        F.col("main.part").alias("main"),
        F.when(small, 0).otherwise(chunks(F.col("main.n"))).alias("main_chunks"),
        F.when(small, 1).otherwise(chunks(F.col("all") - F.col("main.n"))).alias("other_chunks"),
    )
    rows = parts.join(groups, parts["part"] == groups["node"]).select("id", "part", F.col("component").alias("key")).join(most, "key")
    in_main = (F.col("part") == F.col("main")) & (F.col("main_chunks") > 0)
    salt = F.xxhash64("id")
    rows = rows.withColumn(
        "mine",
        F.when(in_main, F.pmod(salt, F.greatest("main_chunks", F.lit(1)))).otherwise(F.col("main_chunks") + F.pmod(salt, F.col("other_chunks"))).cast("int"),
    )
    first = F.when(in_main, F.col("main_chunks")).otherwise(F.lit(0))
    rows = rows.withColumn("other", F.explode(F.sequence(first, F.col("main_chunks") + F.col("other_chunks") - 1)))
    unit = ["tab", "key", "ci", "cj"]
    dealt = rows.select(F.lit(0).alias("tab"), "key", F.least("mine", "other").alias("ci"), F.greatest("mine", "other").alias("cj"), "id", "part")
    partitions = max(1, int(failed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.join(texts, "id").select(*unit, "part", "text").repartition(partitions, *unit).sortWithinPartitions(*unit)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_units(batches):
            names = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(4)], axis=1)
            cuts = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
            part = np.asarray(batch.column(4))
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)]):
                sets = [shingle_hashes(t.as_py(), shingle) for t in batch.column(5).slice(lo, hi - lo)]
                left, right = _cross_links(part[lo:hi], sets, similarity)
                if left:
                    yield pa.RecordBatch.from_arrays([pa.array(part[lo:hi][left]), pa.array(part[lo:hi][right])], names=["a", "b"])

    return dealt.mapInArrow(link, "a long, b long")
