"""Vector and name rankings, rank fusion, families and the delivered search."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import fold, name_tokens
from .lexical import top_k
from .scoring import BLOCK, CELLS, Asked, Best, Terms, best_rows, id_keys, output, place_of

#: Constant of reciprocal rank fusion.
RRF_K = 60


def exact_neighbours(queries: DataFrame, items: DataFrame, *, k: int, id_col: str = "id", vector_col: str = "vector", block: int = 4096) -> DataFrame:
    """(query_id, item, score, rank): exact cosine top-k of a stated query set against all items.

    Queries are met in blocks of about ``block`` by every partition of the
    items, which keeps k per query; what is shuffled is k rows per query and
    task.  Vectors that are null, empty, zero or hold null or non-finite
    components are left out, vectors of unequal length don't meet, and a query
    never finds the item of its own id.  Float vectors are compared in doubles.
    """
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = items.select(F.col(id_col).alias("item"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    asked, rows = asked.filter(finite), rows.filter(finite)
    schema = T.StructType([asked.schema["query_id"], rows.schema["item"], T.StructField("score", T.DoubleType())])
    parts = -(-asked.count() // block)
    numbered = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(max(parts, 1))))
    found = [_block(rows, numbered.filter(F.col("part") == p), k, schema) for p in range(parts)]
    if not found:
        return rows.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(1))
    return top_k(reduce(DataFrame.unionByName, found), k)


def _block(rows: DataFrame, queries: DataFrame, k: int, schema: T.StructType) -> DataFrame:
    """The k best items of one block of queries; the block is read to the driver and broadcast."""
    data = queries.select("query_id", "v").toPandas()
    names, vectors = data["query_id"].tolist(), [np.array(v, dtype=np.float64) for v in data["v"]]
    widths = np.array([len(v) for v in vectors], dtype=np.int64)
    asked = {w: (np.flatnonzero(widths == w), np.stack([v for v in vectors if len(v) == w])) for w in np.unique(widths).tolist()}
    shared = rows.sparkSession.sparkContext.broadcast((names, asked))
    types = to_arrow_schema(schema)

    def search(batches):
        names, asked = shared.value
        best = Best(len(names), k)
        for batch in batches:
            ids, own = batch.column(0), batch.column(1)
            counts, place, key, values = np.diff(np.asarray(own.offsets)), place_of(ids), id_keys(ids), ids.to_pylist()
            for width, (numbers, matrix) in asked.items():
                alike, sizes = np.flatnonzero(counts == width), np.sqrt((matrix * matrix).sum(axis=1))
                unit = matrix / sizes[:, None]
                # so many items at once that neither their scores nor the vectors of a piece of pairs take much memory
                high = max(1, min(CELLS // len(numbers), CELLS // width))
                for low in range(0, len(alike), high):
                    at = alike[low : low + high]
                    items = np.asarray(own.take(pa.array(at)).flatten()).reshape(-1, width)
                    lengths = np.sqrt((items * items).sum(axis=1))
                    near = unit @ (items / lengths[:, None]).T
                    cut = best.cut[numbers] - 1e-6
                    if np.isinf(cut).any():
                        # k of these and one for the query's own row; all that tie with the last stay in
                        most = min(k + 1, len(at))
                        cut = np.maximum(cut, np.partition(near, len(at) - most, axis=1)[:, len(at) - most] - 1e-6)
                    query, item = np.nonzero(near >= cut[:, None])
                    piece = max(1, CELLS // width)
                    for a in range(0, len(query), piece):
                        q, i = query[a : a + piece], item[a : a + piece]
                        exact = (items[i] * matrix[q]).sum(axis=1) / (lengths[i] * sizes[q])
                        other = np.array([values[r] != names[n] for r, n in zip(at[i].tolist(), numbers[q].tolist())], dtype=bool)
                        best.add(numbers[q][other], np.round(exact[other], 6), at[i][other], place, key)
        yield from best.batches(names, types)

    return rows.mapInArrow(search, schema)


def name_ranking(queries: DataFrame, paths: DataFrame, *, k: int, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, item, score, rank): two points per token in the file name, one per token in the folders only.

    ``paths`` are distinct and queries have one row each.  Queries are met in
    blocks by every partition of the paths, which keeps k per query; what is
    shuffled is k rows per query and task.  Ties by shorter path, then by path.
    """
    asked = queries.select("query_id", name_tokens(F.col("text"), stop_words).alias("tokens")).filter(F.size("tokens") > 0).collect()
    last = F.element_at(F.split("path", "/"), -1)
    folders = F.array_join(F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))), "/")
    own = name_tokens(F.regexp_replace(last, r"\.[^.]*$", ""), stop_words)
    # dealt out, since short paths come in few splits, and in the order of ties
    index = paths.select(F.col("path").alias("item"), F.length("path").alias("__size"), own.alias("__0"), F.array_except(name_tokens(folders, stop_words), own).alias("__1"))
    index = index.repartition(paths.sparkSession.sparkContext.defaultParallelism).sortWithinPartitions("__size", "item")
    schema = output(queries.schema["query_id"].dataType, paths.schema["path"].dataType)
    numbers = {t: n for n, t in enumerate(dict.fromkeys(t for r in asked for t in r.tokens))}
    blocks = []
    for low in range(0, len(asked), BLOCK):
        block = asked[low : low + BLOCK]
        held = [(i, numbers[t], 1) for i, r in enumerate(block) for t in r.tokens]
        # a token is taken to stand in as many paths as queries
        share = np.bincount([t for _, t, _ in held], minlength=len(numbers)) / len(block)
        blocks.append(Asked([r.query_id for r in block], held, share))
    terms = Terms([(t,) for t in numbers]) if asked else None
    scored = best_rows(index, terms, blocks, [2.0, 1.0], k, schema, digits=0, ordered=True).withColumn("score", F.col("score").cast("long"))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.length("item"), "item")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fuse(rankings: list[DataFrame], weights: list[float], *, k: int | None = None) -> DataFrame:
    """(query_id, item, score, rank): weighted reciprocal rank fusion; a ranking of weight 0 is left out."""
    if len(rankings) != len(weights):
        raise ValueError("as many weights as rankings are needed")
    used = [
        r.select("query_id", "item", (F.lit(float(w)) / (RRF_K + F.col("rank"))).alias("part")) for r, w in zip(rankings, weights) if w
    ]
    if not used:
        raise ValueError("no ranking has a weight")
    fused = reduce(DataFrame.unionByName, used).groupBy("query_id", "item").agg(F.round(F.sum("part"), 9).alias("score"))
    return top_k(fused, k if k else (1 << 31) - 1)


# -- version families ------------------------------------------------------------

# What a file name may carry without being another document, each after any blanks, underscores and hyphens.
#: State words and version numbers, which a word must end with.
STATES = "final|finalizado|atualizado|comentado|revisado|revisada|apresentado|antigo|old|rev[0-9]*"
VERSION = r"v[0-9]+(?:[._][0-9]+)*"
#: Marks of copies, wherever they stand.
COPIES = r"c[oó]pia(?:\s+de)?|copy(?:\s+of)?|bkp[0-9]*(?:[._][0-9]+)*"
NUMBERED = r"\s*\([0-9]+\)"
#: Initials of who revised it, in capitals at the end.
INITIALS = "[ _-][A-Z]{2,3}$"
SEPARATORS = "[ _.-]+"

_MARKS = rf"[ _-]*(?:{VERSION}|{STATES})([^\p{{L}}\p{{N}}_]|$)|[ _-]*(?:{COPIES})|{NUMBERED}"


def stem(path: Column) -> Column:
    """File name without extension and without marks of versions, copies, states and initials, folded.

    Marks stack, so what is left is stripped again until nothing changes; every
    step shortens the name, so half its length is steps enough.  A name that
    consists of marks stays whole.
    """
    whole = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    strip = lambda name: F.regexp_replace(F.regexp_replace(name, INITIALS, ""), f"(?iu){_MARKS}", "$1")
    steps = F.sequence(F.lit(0), F.floor(F.length(whole) / 2).cast("int"))
    start = F.struct(whole.alias("name"), F.lit(False).alias("done"))

    def step(state: Column, _: Column) -> Column:
        now = strip(state["name"])
        return F.when(state["done"], state).otherwise(F.struct(now.alias("name"), (now == state["name"]).alias("done")))

    bare = F.trim(F.regexp_replace(fold(F.aggregate(steps, start, step, lambda s: s["name"])), SEPARATORS, " "))
    return F.when(bare == "", fold(whole)).otherwise(bare)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def version(path: Column) -> Column:
    """Last version number that the file name declares, as an array of numbers, else null."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    found = F.regexp_extract_all(name, F.lit(rf"(?iu)[ _-]({VERSION})(?![\p{{L}}\p{{N}}_])"), F.lit(1))
    last = F.when(F.size(found) > 0, F.substring(F.element_at(found, -1), 2, 1 << 30))
    return F.split(last, r"[._]").cast("array<int>")


def collapse_families(ranking: DataFrame, *, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per version family and format group of a ranking, at the best position of its members.

    ``ranking`` has query_id, path, rank, mtime.  Within a family (same folder,
    extension and stem) the member with the highest declared version wins if at
    least two versions are declared (then the older file, then the greater
    path), else the newest file (then the smaller path).  Winners of one stem
    in several formats leave the best placed.  Adds ``position``, ``formats``
    and ``older`` (paths that lost, in order); ``carry`` names further columns
    of the winners to return.
    """
    rows = ranking.withColumn("family", F.concat_ws("::", fold(folder(F.col("path"))), fold(extension(F.col("path"))), stem(F.col("path")))).withColumn("v", version(F.col("path")))
    family = W.partitionBy("query_id", "family")
    rows = rows.withColumn("__versions", F.size(F.collect_set("v").over(family))).withColumn("__best", F.min("rank").over(family))
    declared = F.col("__versions") > 1
    order = family.orderBy(
        F.when(declared, F.coalesce("v", F.array().cast("array<int>"))).desc_nulls_last(),
        F.when(declared, F.col("mtime")).asc_nulls_last(),
        F.when(declared, F.col("path")).desc_nulls_last(),
        F.when(~declared, F.col("mtime")).desc_nulls_last(),
        "path",
    )
    rows = rows.withColumn("__place", F.row_number().over(order))
    won = rows.groupBy("query_id", "family").agg(
        F.min("__best").alias("position"),
        F.max(F.when(F.col("__place") == 1, F.col("path"))).alias("path"),
        F.expr("transform(array_sort(collect_list(if(__place > 1, struct(__place, path), null))), x -> x.path)").alias("older"),
        *[F.first(F.when(F.col("__place") == 1, F.col(c)), ignorenulls=True).alias(c) for c in carry],
    )
    group = W.partitionBy("query_id", F.concat_ws("::", fold(folder(F.col("path"))), stem(F.col("path"))))
    best = won.withColumn("__n", F.row_number().over(group.orderBy("position", "path"))).withColumn(
        "formats", F.sort_array(F.collect_set(extension(F.col("path"))).over(group))
    )
    return best.filter("__n = 1").select("query_id", "path", "position", "formats", "older", *carry)


def newest_of_families(files: DataFrame) -> DataFrame:
    """Of each family (folder, extension, stem) the newest file of ``files`` (path, mtime), then the greater path; versions in names don't count."""
    family = [fold(folder(F.col("path"))), fold(extension(F.col("path"))), stem(F.col("path"))]
    best = files.groupBy(*[c.alias(n) for c, n in zip(family, ("folder", "extension", "stem"))]).agg(F.max(F.struct("mtime", "path")).alias("best"))
    return best.select(F.col("best.path").alias("path"), F.col("best.mtime").alias("mtime"))


# -- context ----------------------------------------------------------------------


def context(hits: DataFrame, chunks: DataFrame, window: int, *, few: bool = False) -> DataFrame:
    """Texts before and after every hit, within ``window`` chunks of its document, other hits left out.

    The band join is made an equi-join: a hit asks for each ordinal around it.
    ``few`` hits are broadcast to the chunks, whose texts then stay in place.
    """
    asked = hits.select("query_id", "doc_id", "ordinal", F.explode(F.sequence(F.lit(-window), F.lit(window))).alias("step")).filter("step <> 0")
    asked = asked.withColumn("near", F.col("ordinal") + F.col("step"))
    taken = hits.select("query_id", "doc_id", F.col("ordinal").alias("near"))
    asked = asked.join(taken, ["query_id", "doc_id", "near"], "left_anti")
    near = chunks.select("doc_id", F.col("ordinal").alias("near"), "text").join(F.broadcast(asked) if few else asked, ["doc_id", "near"])
    side = lambda cond: F.expr(f"trim(array_join(transform(array_sort(collect_list(if({cond}, struct(near, text), null))), x -> x.text), '\n'))")
    sides = near.groupBy("query_id", "doc_id", "ordinal").agg(side("step < 0").alias("before"), side("step > 0").alias("after"))
    out = hits.join(sides, ["query_id", "doc_id", "ordinal"], "left")
    return out.withColumn("before", F.coalesce("before", F.lit(""))).withColumn("after", F.coalesce("after", F.lit("")))


def first_per_document(ranking: DataFrame, document: str = "doc") -> DataFrame:
    """Chunk ranking as a document ranking: each document at its first chunk, ranks closed up."""
    best = ranking.groupBy("query_id", document).agg(F.min("rank").alias("__first"))
    order = W.partitionBy("query_id").orderBy("__first", document)
    return best.withColumn("rank", F.row_number().over(order)).select("query_id", F.col(document).alias("item"), "rank")
