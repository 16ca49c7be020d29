"""The registry of documents: references, queues of work, lookups and listings.

A registry has a row per document and root: root, path, doc (public id), size,
mtime, status, model, chunker, parser, scanned, n_chunks; operators name the
columns they need.  All are joins, aggregations and expressions on its columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import in_folder
from .ranking import extension, version

#: Scheme of a reference, and digits of a public id.
SCHEME, ID_DIGITS = "sc", 12
#: A document in one of these states is always read again.
RETRIED = ("erro", "timeout")
#: Extensions whose type is refined by whether they hold tables.
SHEETS = ("xlsx", "xlsm", "xls")
OCR = "ocr:"


# -- references ------------------------------------------------------------------


def parse_reference(text: Column) -> Column:
    """Struct of base, doc, path and error for 'sc://base/id', a bare id of 12 hexadecimal digits, or a path."""
    raw = F.trim(F.coalesce(text, F.lit("")))
    is_uri = F.lower(raw).startswith(f"{SCHEME}://")
    rest = F.substring(raw, len(SCHEME) + 4, 1 << 30)
    base = F.regexp_extract(rest, "^([^/]*)/", 1)
    target = F.lower(F.trim(F.regexp_extract(rest, "(?s)^[^/]*/(.*)$", 1)))
    is_id = lambda c: F.lower(c).rlike(f"^[0-9a-f]{{{ID_DIGITS}}}$")
    nothing = F.lit(None).cast("string")
    error = (
        F.when(raw == "", "empty")
        .when(is_uri & ((base == "") | (target == "")), "malformed")
        .when(is_uri & ~is_id(target), "no id")
    )
    good_uri = is_uri & error.isNull()
    return F.struct(
        F.when(good_uri, base).otherwise(nothing).alias("base"),
        F.when(good_uri, target).when(error.isNull() & is_id(raw), F.lower(raw)).otherwise(nothing).alias("doc"),
        F.when(error.isNull() & ~is_uri & ~is_id(raw), raw).otherwise(nothing).alias("path"),
        error.alias("error"),
    )


def base_conflict(named: Column, serving: str | None) -> Column:
    """Why a reference that names a base can't be answered here; null if it can."""
    if not serving:
        return F.when(F.coalesce(named, F.lit("")) != "", "no base is served by name")
    return F.when((F.coalesce(named, F.lit("")) != "") & (named != serving), "another base")


def by_validity(order: W) -> W:
    """Newest first, then the smaller path."""
    return order.orderBy(F.col("mtime").desc_nulls_last(), "path")


def resolve(registry: DataFrame, references: DataFrame, root: str | None = None) -> DataFrame:
    """The document of every reference (``ref``, ``doc`` or ``path``): root, path, ``paths`` of it, ``state``.

    An id that several files share stands for the preferred one: the highest
    version where at least two declare different ones (then the older file, then
    the greater path), else the newest file (then the smaller path).  A path in
    several roots is ambiguous unless ``root`` names one.  Unknown references
    keep a row with state 'unknown'.
    """
    own = registry.filter(F.col("root") == root) if root else registry
    own = own.select("root", F.col("path").alias("own_path"), F.col("doc").alias("own_doc"), "mtime")
    by_id = references.filter("doc is not null").join(own, F.col("doc") == F.col("own_doc"))
    by_path = references.filter("doc is null and path is not null").join(own, F.col("path") == F.col("own_path"))
    rows = by_id.withColumn("by_id", F.lit(True)).unionByName(by_path.withColumn("by_id", F.lit(False))).withColumn("v", version(F.col("own_path")))
    same = W.partitionBy("ref")
    declared = F.size(F.collect_set("v").over(same)) > 1
    rows = rows.withColumn("declared", declared)
    order = same.orderBy(
        F.when(F.col("declared"), F.coalesce("v", F.array().cast("array<int>"))).desc_nulls_last(),
        F.when(F.col("declared"), F.col("mtime")).asc_nulls_last(),
        F.when(F.col("declared"), F.col("own_path")).desc_nulls_last(),
        F.when(~F.col("declared"), F.col("mtime")).desc_nulls_last(),
        "own_path", "root",
    )
    best = rows.withColumn("n", F.row_number().over(order)).groupBy("ref").agg(
        F.max(F.when(F.col("n") == 1, F.col("root"))).alias("root"), F.max(F.when(F.col("n") == 1, F.col("own_path"))).alias("found"),
        F.count("*").alias("paths"), F.max("by_id").alias("by_id"),
    )
    ambiguous = ~F.col("by_id") & (F.col("paths") > 1)
    state = F.when(F.col("paths").isNull(), "unknown").when(ambiguous, "ambiguous").otherwise("found")
    out = references.select("ref").distinct().join(best, "ref", "left").withColumn("state", state)
    only = lambda c: F.when(F.col("state") == "found", F.col(c)).alias(c)
    return out.select("ref", "state", only("root"), only("found"), F.coalesce("paths", F.lit(0)).cast("long").alias("paths"))


# -- queues ----------------------------------------------------------------------


def type_key(path: Column, scanned: Column, has_table: Column) -> Column:
    """Extension, refined where it is known whether a PDF is scanned or a sheet holds a table."""
    ext = extension(path)
    refined = F.when((ext == "pdf") & scanned.isNotNull(), F.when(scanned, "pdf:ocr").otherwise("pdf:texto"))
    return refined.when(ext.isin(*SHEETS) & has_table.isNotNull(), F.concat(ext, F.when(has_table, ":tabela").otherwise(":texto"))).otherwise(ext)


def indexable(files: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """Files with a supported extension (with the dot, any case)."""
    return files.filter(F.concat(F.lit("."), extension(F.col("path"))).isin(*[e.lower() for e in extensions]))


def awaiting_model(registry: DataFrame, model: str) -> DataFrame:
    """Documents with chunks whose vectors are of no model or of another one."""
    return registry.filter((F.col("status") == "ok") & (F.col("n_chunks") > 0) & ~F.col("model").eqNullSafe(F.lit(model)))


def awaiting_ocr(registry: DataFrame, engine: str) -> DataFrame:
    """Scanned documents that no OCR engine has read, or an older one."""
    return registry.filter(F.col("scanned") & ~F.col("parser").eqNullSafe(F.lit(engine)))


def reindex_decision(seen: DataFrame, registry: DataFrame, *, model: str, parser: Column, chunker: str) -> DataFrame:
    """Files that a pass saw (root, path, size, mtime) and why each is indexed again: ``reason``, null if it isn't.

    A file that OCR has read is read again only if its bytes changed.
    """
    known = registry.select("root", "path", *[F.col(c).alias(f"known_{c}") for c in ("size", "mtime", "status", "model", "chunker", "parser")], F.lit(True).alias("known"))
    rows = seen.join(known, ["root", "path"], "left")
    bytes_changed = (F.col("known_size") != F.col("size")) | (F.abs(F.col("known_mtime") - F.col("mtime")) > 1e-6)
    by_ocr = F.coalesce(F.col("known_parser"), F.lit("")).startswith(OCR)
    reason = (
        F.when(F.col("known").isNull(), "new")
        .when(F.col("known_status").isin(*RETRIED), "retry")
        .when(bytes_changed, "bytes")
        .when(by_ocr, F.lit(None))
        .when(~F.col("known_model").eqNullSafe(F.lit(model)), "model")
        .when(~F.col("known_chunker").eqNullSafe(F.lit(chunker)), "chunker")
        .when(~F.col("known_parser").eqNullSafe(parser), "parser")
    )
    return rows.withColumn("reason", reason).select(*seen.columns, "reason")


def stamp_model(registry: DataFrame, done: DataFrame, model: str) -> DataFrame:
    """The registry with ``model`` set on the documents (root, path) that are done."""
    marked = done.select("root", "path").distinct().withColumn("__done", F.lit(True))
    rows = registry.join(marked, ["root", "path"], "left")
    return rows.withColumn("model", F.when(F.col("__done"), F.lit(model)).otherwise(F.col("model"))).select(registry.columns)


def release(quarantine: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The quarantine without the rows of these keys."""
    return quarantine.join(keys.select(*on).distinct(), on, "left_anti")


# -- lookups ---------------------------------------------------------------------


def chunks_by_id(chunks: DataFrame, registry: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks with these ids and, where it is known, their document's path and mtime; unknown ids are absent."""
    wanted = chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return wanted.join(registry.select("doc_id", "path", "mtime"), "doc_id", "left")


def chunk_ids_by_path(chunks: DataFrame, registry: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, chunk_ids): a document's chunk ids in order, as an array."""
    wanted = registry.join(paths.select("path").distinct(), "path", "left_semi").select("doc_id", "path")
    rows = chunks.join(wanted, "doc_id").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ordinal", "chunk_id"))).alias("found"))
    return rows.select("path", F.col("found.chunk_id").alias("chunk_ids"))


def mention_frequency(mentions: DataFrame) -> DataFrame:
    """(doc, kind, value, documents): a document's identifiers and in how many documents each stands."""
    spread = mentions.groupBy("kind", "value").agg(F.countDistinct("doc").alias("documents"))
    return mentions.select("doc", "kind", "value").distinct().join(spread, ["kind", "value"])


def text_volume(chunks: DataFrame) -> DataFrame:
    """(doc_id, chars, n): characters and chunks of every document."""
    return chunks.groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n"))


def length_statistics(chunks: DataFrame) -> DataFrame:
    """n, total, mean, most and least characters of chunks; zeros if there are none."""
    size = F.length("text")
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return chunks.agg(
        F.count("*").alias("n"), zero(F.sum(size), "total"), F.coalesce(F.round(F.avg(size), 6), F.lit(0.0)).alias("mean"),
        zero(F.max(size), "most"), zero(F.min(size), "least"),
    )


# -- states ----------------------------------------------------------------------


def model_coverage(registry: DataFrame) -> DataFrame:
    """(model, n): good documents by the model of their vectors; 'lexical' where there is none."""
    name = F.when(F.coalesce("model", F.lit("")) == "", "lexical").otherwise(F.col("model"))
    return registry.filter("status = 'ok'").groupBy(name.alias("model")).agg(F.count("*").alias("n"))


def without_canonical(registry: DataFrame, stored: DataFrame) -> DataFrame:
    """Good documents (by ``sha``) that the parse store doesn't hold."""
    return registry.filter("status = 'ok'").join(stored.select("sha").distinct(), "sha", "left_anti")


def graph_lag(chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """with_chunks, in_graph: how many documents each knows."""
    left = chunks.agg(F.countDistinct("doc_id").alias("with_chunks"))
    return left.crossJoin(mentions.agg(F.countDistinct("doc").alias("in_graph")))


def known_documents(*tables: DataFrame) -> DataFrame:
    """Distinct (root, path) of all tables."""
    return reduce(DataFrame.unionByName, [t.select("root", "path") for t in tables]).distinct()


def with_census(registry: DataFrame, seen: DataFrame, folder: str = "", recursive: bool = True) -> DataFrame:
    """Documents of a folder: the registered ones, and files on disk that aren't registered yet (``only_seen``)."""
    inside = in_folder(F.col("path"), folder, recursive)
    known = registry.filter(inside).select("root", "path", "size", "mtime", F.lit(False).alias("only_seen"))
    fresh = seen.filter(inside).join(registry.select("root", "path"), ["root", "path"], "left_anti")
    return known.unionByName(fresh.select("root", "path", "size", "mtime", F.lit(True).alias("only_seen")))


def health(findings: DataFrame) -> DataFrame:
    """(base, state, errors, warnings): 'inoperante' with any error, 'atencao' with any warning, else 'saudavel'."""
    found = findings.groupBy("base").agg(F.count_if(F.col("level") == "erro").alias("errors"), F.count_if(F.col("level") == "aviso").alias("warnings"))
    return found.withColumn("state", F.when(F.col("errors") > 0, "inoperante").when(F.col("warnings") > 0, "atencao").otherwise("saudavel"))


# -- parse store -------------------------------------------------------------------

#: Fixed value: version of the stored form.
STORED_FORM = "1"


def parse_key(sha: Column, parser: Column, route: Column, engine: Column) -> Column:
    """Key of a parse result: 32 digits of a hash over its parts and the version of the stored form."""
    parts = [F.coalesce(c, F.lit("")) for c in (sha, parser, route, engine)] + [F.lit(STORED_FORM)]
    return F.substring(F.sha2(F.encode(F.concat_ws("\0", *parts), "utf-8"), 256), 1, 32)


def parse_hits(files: DataFrame, store: DataFrame) -> DataFrame:
    """Files (with ``key``) and whether the store has a sound entry for them; a corrupt entry is a miss."""
    sound = store.filter("not corrupt").select("key").distinct().withColumn("hit", F.lit(True))
    return files.join(sound, "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def parse_garbage(store: DataFrame, live: DataFrame, *, now: float, grace_s: float) -> DataFrame:
    """Entries to drop: their content (``sha``) is live no more and they are older than the grace period.

    Entries that name no content stay.  An empty live set drops nothing: it
    rather tells of a registry that can't be read.
    """
    any_live = live.limit(1).agg(F.count("*").alias("__live"))
    old = store.filter(F.col("sha").isNotNull() & (F.lit(now) - F.col("written") > grace_s))
    dead = old.join(live.select("sha").distinct(), "sha", "left_anti")
    return dead.crossJoin(F.broadcast(any_live)).filter("__live > 0").drop("__live")
