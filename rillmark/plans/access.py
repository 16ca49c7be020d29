"""Queries of the access operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import access
from .corpus import CHUNKS, PATHS, chunks, paths, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    status = F.when(F.length("text") < 200, "short").when(F.col("doc_id") % 17 == 0, "failed").otherwise("ok")
    return docs.select("doc_id", "lang", "source", status.alias("status"), F.size(F.split("text", "\n")).cast("long").alias("n_chunks"), (F.col("doc_id") * 13 % 9973).alias("mtime"))


_DOCUMENTS = """docs as (select doc_id, lang, source, case when length(text) < 200 then 'short' when doc_id % 17 = 0 then 'failed' else 'ok' end as status,
  len(string_split(text, chr(10)))::bigint as n_chunks, doc_id * 13 % 9973 as mtime from documents)"""


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.overview(_documents(spark, sf_dir))


def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.most_frequent(_documents(spark, sf_dir), "source")


def status_cross_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).groupBy("lang").pivot("status", ["ok", "short", "failed"]).agg(F.count("doc_id"))
    return rows.select("lang", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("ok", "short", "failed")])


def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = paths(spark, sf_dir).withColumn("band", keys.size_band(F.col("size"))).withColumn("year", F.year(F.timestamp_seconds("mtime")))
    return access.census(files, ["lang", "source", "band", "year"])


_BAND = "case when size <= 0 then '0 B' when size < 1024 then '< 1 KB' when size < 10240 then '1-10 KB' when size < 102400 then '10-100 KB' when size < 1048576 then '100 KB-1 MB' when size < 10485760 then '1-10 MB' when size < 104857600 then '10-100 MB' else '>= 100 MB' end"
CENSUS_SQL = f"""with {PATHS}, long as (select size, 'lang' as axis, lang as value from paths union all select size, 'source', source from paths
  union all select size, 'band', {_BAND} from paths union all select size, 'year', year(to_timestamp(mtime))::varchar from paths)
select axis, value, count(*) as files, sum(size)::bigint as bytes, round(count(*)::double / sum(count(*)) over (partition by axis), 6) as share from long group by axis, value"""


def largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).select("size", "path").orderBy(F.col("size").desc(), F.col("path").desc()).limit(50)


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).withColumn("trail", F.floor(F.pmod(F.col("ordinal") * 3, F.lit(7)) / 3).cast("string"))
    return access.outline(rows, doc="doc_id", order="ordinal", trail="trail", text="text")


OUTLINE_SQL = f"""with {CHUNKS}, t as (select *, (ordinal * 3 % 7 // 3)::varchar as trail from chunks),
m as (select *, case when lag(trail) over (partition by doc_id order by ordinal) is not distinct from trail and ordinal > 0 then 0 else 1 end as f from t),
n as (select *, sum(f) over (partition by doc_id order by ordinal rows unbounded preceding)::bigint as section from m)
select doc_id, section, any_value(trail) as trail, min(ordinal) as first, count(*) as n_chunks, sum(length(text))::bigint as chars from n group by doc_id, section"""


def speaker_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sections of consecutive turns of one role."""
    return access.outline(table(spark, sf_dir, "conversations"), doc="conv_id", order="turn", trail="role", text="text")


TURNS_SQL = """with m as (select *, case when lag(role) over w is not distinct from role and row_number() over w > 1 then 0 else 1 end as f from conversations window w as (partition by conv_id order by turn)),
n as (select *, sum(f) over (partition by conv_id order by turn rows unbounded preceding)::bigint as section from m)
select conv_id, section, any_value(role) as trail, min(turn) as first, count(*) as n_chunks, sum(length(text))::bigint as chars from n group by conv_id, section"""


def manifest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paths(spark, sf_dir).filter(keys.in_folder(F.col("path"), "src1")).select("path", "size", keys.document_id(F.col("sha")).alias("public_id"))
    return access.page(rows, ["path"], 10, 20).select("path", "size", "public_id", "total", F.col("next").cast("long").alias("next"))


MANIFEST_SQL = f"""with {PATHS}, f as (select path, size, substr(sha, 1, 12) as public_id from paths where starts_with(path, 'src1/'))
select *, (select count(*) from f) as total, case when 30 < (select count(*) from f) then 30::bigint end as next from f order by path limit 20 offset 10"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.lit("nation").alias("sheet"), F.col("n_nationkey").alias("row"), "n_name", "n_regionkey")
    return access.cells(rows, ["sheet", "row"], ["n_name", "n_regionkey"])


def sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir)


def sheet_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.keyset_page(_cells(spark, sf_dir), ["sheet", "row", "column"], ("nation", 7, "A"), 12)


_CELLS = "cells as (select 'nation' as sheet, n_nationkey as row, unnest(['A', 'B']) as column, unnest([n_name, n_regionkey::varchar]) as value from nation)"


def pack_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.pack(paths(spark, sf_dir), by="source", order=["path"], size="size", budget=50_000).select("source", "path", "used")


def page_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.inline(access.slices(F.col("text"), 1000)))
    return docs.select("doc_id", F.col("start").cast("long").alias("start"), F.md5(F.col("part").cast("binary")).alias("digest"))


SLICES_SQL = """select doc_id, (i * 1000)::bigint as start, md5(substr(text, (i * 1000 + 1)::bigint, 1000)) as digest
from (select doc_id, text, unnest(range(0, greatest(ceil(length(text) / 1000.0), 1)::bigint)) as i from documents)"""


def canonical_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of paragraphs under made-up headings; slicing them gives the paragraphs back."""
    n = F.col("ordinal")
    trail = F.array(F.concat(F.lit("part "), F.floor(n / 6).cast("string")), F.concat(F.lit("section "), F.floor(n / 2).cast("string")))
    rows = access.canonical(chunks(spark, sf_dir).withColumn("trail", trail), doc="doc_id", order="ordinal", trail="trail", text="text")
    return rows.select("doc_id", "ordinal", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.length("markdown").cast("long").alias("added"))


CANONICAL_SQL = f"""with {CHUNKS}, h as (select doc_id, ordinal, length(text) as len,
  (case when ordinal % 6 = 0 then length('# part ' || (ordinal // 6)) + 2 else 0 end) + (case when ordinal % 2 = 0 then length('## section ' || (ordinal // 2)) + 2 else 0 end) as head from chunks)
select doc_id, ordinal, (coalesce(sum(head + len + 2) over w, 0) + head)::bigint as start, (coalesce(sum(head + len + 2) over w, 0) + head + len)::bigint as end, (head + len + 2)::bigint as added
from h window w as (partition by doc_id order by ordinal rows between unbounded preceding and 1 preceding)"""

QUERIES = {
    "overview": (overview, f"with {_DOCUMENTS} select count(*) as documents, sum(n_chunks)::bigint as chunks, min(mtime) as oldest, max(mtime) as newest, count(*) filter (where status = 'ok') as ok, round((count(*) filter (where status = 'ok'))::double / count(*), 4) as ok_share from docs"),
    "top_sources": (top_sources, f"with {_DOCUMENTS} select source, count(*) as n from docs group by source order by n desc, source limit 10"),
    "status_cross_table": (status_cross_table, f"with {_DOCUMENTS} select lang, count(*) filter (where status = 'ok') as ok, count(*) filter (where status = 'short') as short, count(*) filter (where status = 'failed') as failed from docs group by lang"),
    "file_census": (census, CENSUS_SQL),
    "largest_files": (largest, f"with {PATHS} select size, path from paths order by size desc, path desc limit 50"),
    "document_outline": (outline, OUTLINE_SQL),
    "speaker_turns": (speaker_turns, TURNS_SQL),
    "manifest_page": (manifest_page, MANIFEST_SQL),
    "sheet_cells": (sheet_cells, f"with {_CELLS} select sheet, row, \"column\", value from cells"),
    "sheet_keyset_page": (sheet_page, f"with {_CELLS} select sheet, row, \"column\", value from cells where (sheet, row, \"column\") > ('nation', 7, 'A') order by sheet, row, \"column\" limit 12"),
    "pack_folder": (pack_folder, f"with {PATHS} select * from (select source, path, (sum(size) over (partition by source order by path rows unbounded preceding))::bigint as used from paths) where used <= 50000"),
    "page_slices": (page_slices, SLICES_SQL),
    "canonical_spans": (canonical_spans, CANONICAL_SQL),
}
