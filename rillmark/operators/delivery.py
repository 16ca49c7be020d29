"""The delivered search: vectors, words and names fused, filtered, collapsed, re-ranked and shown in context.

One plan answers all queries of a batch.  Tables:

- queries: query_id, text and, for the vector ranking, vector
- chunks: chunk_id, doc, ordinal, trail, text and, for the vector ranking, vector; where they carry root, path and mtime
  of their document as well, their texts are not joined to it
- documents: doc, root, path, mtime; one path may stand in several roots
- vectors (optional): chunk_id, vector, in place of the chunks' own

The k results of each query are broadcast to find their texts, which are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.glossary import expand
from ..functions.keys import source_group
from . import lexical, ranking

# Candidates of each ranking, weights of the rankings, characters of a snippet, most hits and context of a request.
CANDIDATES = 200
DENSE, LEXICAL, NAME = 1.0, 0.25, 0.5
SNIPPET = 300
MOST_HITS, MOST_CONTEXT = 50, 3
#: Fixed value: the group of files whose names don't tell them apart.
NAMELESS = "reuniao"


@dataclass(frozen=True)
class Search:
    """What a batch of queries asks for.

    ``folder``, ``since`` and ``until`` (seconds, both included) keep chunks
    before they are ranked by vector and words, but names after: their ranks
    keep gaps, and a document without a time passes.  ``root`` keeps results.
    A ranking of weight 0 is left out.  ``names_by_group`` gives names of
    meetings no weight.  ``rerank`` gets (query_id, item, rank, title, trail,
    text) of the first ``head`` results and returns (query_id, item, model);
    see :func:`reorder`.
    """

    k: int = 10
    window: int = 0
    folder: str = ""
    since: float | None = None
    until: float | None = None
    root: str | None = None
    older: bool = False
    dense: float = DENSE
    lexical: float = LEXICAL
    name: float = NAME
    names_by_group: bool = False
    candidates: int = CANDIDATES
    fields: Mapping[str, float] = field(default_factory=lambda: {"text": 1.0, "trail": 1.0, "path": 1.0})
    glossary: Mapping[str, Sequence[str]] = field(default_factory=dict)
    prune: bool = True
    rerank: Callable[[DataFrame], DataFrame] | None = None
    head: int = 0
    rerank_weight: float | None = None

    def __post_init__(self) -> None:
        if not 1 <= self.k <= MOST_HITS or not 0 <= self.window <= MOST_CONTEXT:
            raise ValueError(f"k must be 1 to {MOST_HITS}, window 0 to {MOST_CONTEXT}")


def reorder(results: DataFrame, scores: DataFrame, *, head: int, weight: float | None = None) -> DataFrame:
    """Results (query_id, item, rank, ...) with the first ``head`` of each query in the order of a model's scores.

    Without ``weight`` the model's order replaces the old one; with it both are
    fused by reciprocal ranks, the old with weight 1.  Ties keep the old order,
    as do a query with a single result and all results after the head; results
    without a score come last in the head.
    """
    rows = results.join(scores.select("query_id", "item", "model"), ["query_id", "item"], "left").withColumn("__head", F.col("rank") <= head)
    part = W.partitionBy("query_id", "__head")
    rows = rows.withColumn("__model", F.row_number().over(part.orderBy(F.col("model").desc_nulls_last(), "rank")))
    key = F.col("__model").cast("double") if weight is None else -(1.0 / (ranking.RRF_K + F.col("rank")) + weight / (ranking.RRF_K + F.col("__model")))
    order = W.partitionBy("query_id").orderBy(F.when(F.col("__head"), 0).otherwise(1), F.when(F.col("__head"), F.round(key, 12)), "rank")
    return rows.withColumn("__new", F.row_number().over(order)).withColumn("rank", F.col("__new")).select(*results.columns)


def _in_folder(path: Column, folder: str) -> Column:
    prefix = folder.strip().replace("\\", "/").strip("/")
    return (path == prefix) | path.startswith(f"{prefix}/") if prefix else F.lit(True)


def _chunk_rankings(queries: DataFrame, rows: DataFrame, search: Search, vectors: DataFrame | None) -> list[tuple[str, float, DataFrame]]:
    """(source, weight, ranking) of the vector and the word ranking, filters applied before the cut."""
    kept = _in_folder(F.col("path"), search.folder)
    if search.since is not None:
        kept = kept & (F.col("mtime") >= search.since)
    if search.until is not None:
        kept = kept & (F.col("mtime") <= search.until)
    filtered = bool(search.folder.strip("/\\ ")) or search.since is not None or search.until is not None
    found = []
    if search.dense:
        items = rows.filter(kept) if filtered else rows
        items = items.select("chunk_id", "vector") if vectors is None else vectors.select("chunk_id", "vector").join(items.select("chunk_id"), "chunk_id", "left_semi")
        near = ranking.exact_neighbours(queries.select(F.col("query_id").alias("chunk_id"), "vector"), items, k=search.candidates, id_col="chunk_id")
        found.append(("dense", search.dense, near.select("query_id", "item", "rank")))
    if search.lexical:
        within = kept if filtered else None
        asked = queries.withColumn("text", expand(F.col("text"), search.glossary))
        words = lexical.bm25_fields(asked, rows, k=search.candidates, fields=search.fields, within=within, prune=search.prune)
        found.append(("lexical", search.lexical, words.select("query_id", "item", "rank")))
    return found


def _names(queries: DataFrame, documents: DataFrame, search: Search) -> DataFrame | None:
    """(query_id, path, part): what a document's name adds; ranked first, filtered after."""
    if not search.name:
        return None
    asked = queries.select("query_id", expand(F.col("text"), search.glossary).alias("text"))
    times = documents.groupBy("path").agg(F.max("mtime").alias("mtime"))
    best = ranking.name_ranking(asked, times.select("path"), k=search.candidates).join(times.withColumnRenamed("path", "item"), "item")
    kept = _in_folder(F.col("item"), search.folder)
    if search.since is not None:
        kept = kept & F.coalesce(F.col("mtime") >= search.since, F.lit(True))
    if search.until is not None:
        kept = kept & F.coalesce(F.col("mtime") <= search.until, F.lit(True))
    weight = F.lit(float(search.name))
    if search.names_by_group:
        weight = F.when(source_group(F.col("item")) == NAMELESS, 0.0).otherwise(weight)
    return best.filter(kept).select("query_id", F.col("item").alias("path"), (weight / (ranking.RRF_K + F.col("rank"))).alias("part")).filter("part <> 0")


def _searched(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with root, path and time of their document; the searchable path is a column of words."""
    about = ["root", "path", "mtime"]
    return chunks if set(about) <= set(chunks.columns) else chunks.join(documents.select("doc", *about), "doc")


def _ordered(fused: DataFrame, search: Search) -> DataFrame:
    """Results (query_id, item, root, path, mtime, score, sources) in order, without roots not asked for and superseded documents.

    Adds rank, older and formats.  A document travels with its results, of
    which there are at most as many as candidates, so nothing is joined back.
    """
    if search.root is not None:
        fused = fused.filter(F.col("root") == search.root)
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "item")
    fused = fused.withColumn("rank", F.row_number().over(order))
    if search.older:
        none = F.array().cast("array<string>")
        return fused.withColumns({"older": none, "formats": none})
    own = F.collect_list(F.struct("item", "score", "sources", "root")).alias("own")
    seen = fused.groupBy("query_id", "path").agg(F.min("rank").alias("rank"), F.max("mtime").alias("mtime"), own)
    won = ranking.collapse_families(seen, carry=("own",)).select("query_id", "path", "older", "formats", F.inline("own"))
    # ranks close up over what was superseded
    return won.withColumn("rank", F.row_number().over(order))


def _held(ordered: DataFrame, search: Search) -> DataFrame:
    """The results that can be shown, without their lineage: at most ``k`` or ``head`` per query, read to the driver once."""
    rows = ordered.filter(F.col("rank") <= max(search.k, search.head))
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def _reranked(ordered: DataFrame, shown: DataFrame, search: Search) -> DataFrame:
    """The k first, after a model had its say on the head; ``shown`` has query_id, item, path, trail, text."""
    if search.rerank is not None:
        head = ordered.filter(F.col("rank") <= max(search.k, search.head))
        told = shown.select("query_id", "item", ranking.stem(F.col("path")).alias("title"), "trail", "text")
        scores = search.rerank(head.filter(F.col("rank") <= search.head).select("query_id", "item", "rank").join(told, ["query_id", "item"]))
        ordered = reorder(head, scores, head=search.head, weight=search.rerank_weight)
    return ordered.filter(F.col("rank") <= search.k)


def passages(queries: DataFrame, chunks: DataFrame, documents: DataFrame, search: Search = Search(), *, vectors: DataFrame | None = None) -> DataFrame:
    """The best chunks of every query, of current documents only unless ``older``.

    Returns query_id, rank, chunk_id, doc, ordinal, root, path, trail, text,
    score, sources (which of dense, lexical and name found it), older and
    formats (of its document's family), before and after.  A name adds to one
    chunk of the documents of its path: the best found by vector or words, else
    the first.  Ties by chunk_id.  Queries without results are absent.
    """
    rows = _searched(chunks, documents)
    about = rows.select(F.col("chunk_id").alias("item"), "ordinal", "root", "path", "mtime")
    none = F.lit(None).cast("double").alias("named")
    parts = [
        r.select("query_id", "item", (F.lit(float(w)) / (ranking.RRF_K + F.col("rank"))).alias("part"), none, F.lit(source).alias("source"))
        for source, w, r in _chunk_rankings(queries, rows, search, vectors)
    ]
    names = _names(queries, documents, search)
    if names is not None:
        # every chunk of a named document is offered; which of them gets the part is settled below
        offered = names.withColumnRenamed("part", "named").join(about.select("item", "path"), "path")
        parts.append(offered.select("query_id", "item", F.lit(None).cast("double").alias("part"), "named", F.lit(None).cast("string").alias("source")))
    if not parts:
        raise ValueError("no ranking has a weight")
    pool = reduce(DataFrame.unionByName, parts).groupBy("query_id", "item").agg(
        F.sum("part").alias("part"), F.max("named").alias("named"), F.collect_set("source").alias("sources")
    )
    pool = pool.join(about, "item")
    if search.root is not None:
        pool = pool.filter(F.col("root") == search.root)
    best = W.partitionBy("query_id", "path").orderBy(F.col("named").isNull(), F.round("part", 9).desc_nulls_last(), "ordinal", "item")
    pool = pool.withColumn("named", F.when(F.row_number().over(best) == 1, F.col("named"))).filter("part is not null or named is not null")
    fused = pool.select(
        "query_id", "item", "root", "path", "mtime",
        F.round(F.coalesce("part", F.lit(0.0)) + F.coalesce("named", F.lit(0.0)), 9).alias("score"),
        F.sort_array(F.when(F.col("named").isNotNull(), F.array_append("sources", F.lit("name"))).otherwise(F.col("sources"))).alias("sources"),
    )
    ordered = _held(_ordered(fused, search), search)
    texts = chunks.select(F.col("chunk_id").alias("item"), "doc", "ordinal", "trail", "text")
    shown = texts.join(F.broadcast(ordered.select("query_id", "item", "path")), "item") if search.rerank is not None else ordered
    hits = texts.join(F.broadcast(_reranked(ordered, shown, search)), "item").withColumnRenamed("item", "chunk_id")
    if search.window:
        hits = ranking.context(hits.withColumnRenamed("doc", "doc_id"), chunks.withColumnRenamed("doc", "doc_id"), search.window, few=True).withColumnRenamed("doc_id", "doc")
    else:
        hits = hits.withColumns({"before": F.lit(""), "after": F.lit("")})
    return hits.select("query_id", "rank", "chunk_id", "doc", "ordinal", "root", "path", "trail", "text", "score", "sources", "older", "formats", "before", "after")


def documents_found(queries: DataFrame, chunks: DataFrame, documents: DataFrame, search: Search = Search(), *, vectors: DataFrame | None = None) -> DataFrame:
    """The best documents of every query, of current ones only unless ``older``.

    Each chunk ranking becomes a ranking of documents by their first chunk,
    ranks closed up, before it is fused; a name adds to every document of its
    path.  Returns query_id, rank, doc, root, path, score, sources, older,
    formats and snippet: the opening of the document's best chunk in the first
    ranking that holds it, else of its first chunk.  Ties by doc.
    """
    rows = _searched(chunks, documents)
    of_chunk = rows.select(F.col("chunk_id").alias("item"), "doc", "ordinal", "root")
    if search.root is not None:
        of_chunk = of_chunk.filter(F.col("root") == search.root)
    parts, best = [], []
    for number, (source, w, r) in enumerate(_chunk_rankings(queries, rows, search, vectors)):
        placed = r.join(of_chunk, "item")
        parts.append(ranking.first_per_document(placed).select("query_id", "item", (F.lit(float(w)) / (ranking.RRF_K + F.col("rank"))).alias("part"), F.lit(source).alias("source")))
        best.append(placed.select("query_id", "doc", F.lit(number).alias("number"), F.col("rank").cast("long").alias("place"), "item"))
    names = _names(queries, documents, search)
    if names is not None:
        parts.append(names.join(documents.select("path", F.col("doc").alias("item")), "path").select("query_id", "item", "part", F.lit("name").alias("source")))
    if not parts:
        raise ValueError("no ranking has a weight")
    about = documents.select(F.col("doc").alias("item"), "root", "path", "mtime")
    fused = reduce(DataFrame.unionByName, parts).groupBy("query_id", "item").agg(
        F.round(F.sum("part"), 9).alias("score"), F.sort_array(F.collect_set("source")).alias("sources")
    )
    ordered = _held(_ordered(fused.join(about, "item"), search), search)
    # only what can be shown looks for its chunk
    kept = ordered.select("query_id", F.col("item").alias("doc"), "path")
    openings = of_chunk.join(F.broadcast(kept.select("query_id", "doc")), "doc").select("query_id", "doc", F.lit(len(best)).alias("number"), F.col("ordinal").cast("long").alias("place"), "item")
    first = reduce(DataFrame.unionByName, [*best, openings]).groupBy("query_id", "doc").agg(F.min(F.struct("number", "place", "item")).alias("b"))
    chosen = kept.join(first, ["query_id", "doc"]).select("query_id", "doc", "path", F.col("b.item").alias("chunk_id"))
    texts = chunks.select("chunk_id", "trail", "text").join(F.broadcast(chosen), "chunk_id")
    texts = texts.select("query_id", F.col("doc").alias("item"), "path", "trail", "text")
    hits = _reranked(ordered, texts, search).join(texts.select("query_id", "item", "text"), ["query_id", "item"], "left")
    snippet = F.coalesce(F.substring("text", 1, SNIPPET), F.lit("")).alias("snippet")
    return hits.select("query_id", "rank", F.col("item").alias("doc"), "root", "path", "score", "sources", "older", "formats", snippet)
