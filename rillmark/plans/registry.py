"""Queries of the registry, over the documents as registered files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import registry as ops
from .corpus import CHUNKS, chunks, table


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (d % n + 1).cast("int"))
    docs = table(spark, sf_dir, "documents")
    sha = F.sha2(F.col("text").cast("binary"), 256)
    return docs.select(
        "doc_id", pick(3, "A", "B", "A").alias("root"), F.concat("source", F.lit("/"), "lang", F.lit("/f"), (d % 900).cast("string"), F.lit("_v"), (d % 4).cast("string"), F.lit("."), pick(4, "pdf", "xlsx", "txt", "docx")).alias("path"),
        F.substring(sha, 1, 12).alias("doc"), sha.alias("sha"), F.octet_length("text").cast("long").alias("size"), (d * 7919 % 1_000_003).cast("double").alias("mtime"),
        pick(11, "erro", "ok", "ok", "vazio", "ok", "ok", "timeout", "ok", "ok", "ok", "ok").alias("status"), pick(4, None, "m1", "m2", "").alias("model"), pick(9, *["c2"] * 8, "c1").alias("chunker"),
        pick(5, None, "ocr:1", "ocr:2", "txt:1", "txt:2").alias("parser"), (d % 6 == 0).alias("scanned"), F.when(d % 5 > 0, d % 2 == 0).alias("has_table"), F.size(F.split("text", "\n")).cast("long").alias("n_chunks"),
    )


REG = """reg as (select doc_id, ['A','B','A'][(doc_id % 3 + 1)::int] as root, source || '/' || lang || '/f' || (doc_id % 900) || '_v' || (doc_id % 4) || '.' || ['pdf','xlsx','txt','docx'][(doc_id % 4 + 1)::int] as path,
  sha256(text)[1:12] as doc, sha256(text) as sha, strlen(text)::bigint as size, (doc_id * 7919 % 1000003)::double as mtime,
  ['erro','ok','ok','vazio','ok','ok','timeout','ok','ok','ok','ok'][(doc_id % 11 + 1)::int] as status, [null,'m1','m2',''][(doc_id % 4 + 1)::int] as model, case when doc_id % 9 = 8 then 'c1' else 'c2' end as chunker,
  [null,'ocr:1','ocr:2','txt:1','txt:2'][(doc_id % 5 + 1)::int] as parser, doc_id % 6 = 0 as scanned, case when doc_id % 5 > 0 then doc_id % 2 = 0 end as has_table, len(string_split(text, chr(10)))::bigint as n_chunks from documents)"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, r = F.col("doc_id"), registered(spark, sf_dir)
    text = (
        F.when(d % 8 == 0, F.concat(F.lit("SC://main/"), F.upper("doc"))).when(d % 8 == 1, F.concat(F.lit("  "), F.col("doc"), F.lit(" "))).when(d % 8 == 2, F.lit(" "))
        .when(d % 8 == 3, F.concat(F.lit("sc://"), F.col("doc"))).when(d % 8 == 4, F.concat(F.lit("sc://other/"), F.substring("doc", 1, 11))).when(d % 8 == 5, F.concat(F.lit("sc://other/"), F.col("doc")))
        .when(d % 8 == 6, F.concat(F.lit("./"), F.col("doc"))).otherwise(F.col("path"))
    )
    return r.select(d.cast("string").alias("ref"), text.alias("text"))


REFS = f"""{REG}, refs as (select doc_id::varchar as ref, case doc_id % 8 when 0 then 'SC://main/' || upper(doc) when 1 then '  ' || doc || ' ' when 2 then ' ' when 3 then 'sc://' || doc when 4 then 'sc://other/' || doc[1:11]
  when 5 then 'sc://other/' || doc when 6 then './' || doc else path end as text from reg),
cut as (select ref, trim(text) as raw, regexp_extract(trim(text), '(?i)^sc://([^/]*)/', 1) as b, lower(trim(regexp_extract(trim(text), '(?is)^sc://[^/]*/(.*)$', 1))) as t, starts_with(lower(trim(text)), 'sc://') as uri from refs),
judged as (select *, case when raw = '' then 'empty' when uri and (b = '' or t = '') then 'malformed' when uri and not regexp_full_match(t, '[0-9a-f]{{12}}') then 'no id' end as error, regexp_full_match(lower(raw), '[0-9a-f]{{12}}') as id from cut),
parsed as (select ref, case when uri and error is null then b end as base, case when error is not null then null when uri then t when id then lower(raw) end as doc, case when error is null and not uri and not id then raw end as path, error from judged)"""


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references(spark, sf_dir).select("ref", F.inline(F.array(ops.parse_reference(F.col("text")))))


def parse_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).withColumn("conflict", ops.base_conflict(F.col("base"), "main"))


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.resolve(registered(spark, sf_dir), parsed(spark, sf_dir))


RESOLVE_SQL = f"""with {REFS}, hits as (select p.ref, true as by_id, r.root, r.path, r.mtime from parsed p join reg r on p.doc = r.doc union all
  select p.ref, false, r.root, r.path, r.mtime from parsed p join reg r on p.doc is null and p.path = r.path),
v as (select *, (regexp_extract(path, '_v([0-9]+)', 1))::int as v from hits), d as (select *, (select count(distinct v) from v w where w.ref = v.ref) > 1 as declared from v),
o as (select *, row_number() over (partition by ref order by case when declared then v end desc nulls last, case when declared then mtime end asc nulls last, case when declared then path end desc nulls last, case when not declared then mtime end desc nulls last, path, root) as n from d),
g as (select ref, max(root) filter (n = 1) as root, max(path) filter (n = 1) as found, count(*) as paths, bool_or(by_id) as by_id from o group by ref),
j as (select p.ref, g.root, g.found, g.paths, case when paths is null then 'unknown' when not by_id and paths > 1 then 'ambiguous' else 'found' end as state from (select distinct ref from parsed) p left join g using (ref))
select ref, state, case when state = 'found' then root end as root, case when state = 'found' then found end as found, coalesce(paths, 0) as paths from j"""


def type_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ops.type_key(F.col("path"), F.when(F.col("doc_id") % 8 > 0, F.col("scanned")), F.col("has_table"))
    return registered(spark, sf_dir).groupBy(key.alias("type")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


TYPES_SQL = f"""with {REG}, t as (select *, regexp_extract(lower(path), '\\.([^./]*)$', 1) as ext, case when doc_id % 8 > 0 then scanned end as s from reg)
select case when ext = 'pdf' and s is not null then case when s then 'pdf:ocr' else 'pdf:texto' end when ext in ('xlsx','xlsm','xls') and has_table is not null then ext || case when has_table then ':tabela' else ':texto' end else ext end as type,
  count(*) as n, sum(size)::bigint as bytes from t group by 1"""


def indexable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.indexable(registered(spark, sf_dir), (".PDF", ".txt")).select("doc_id", "path")


def pending_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.awaiting_model(registered(spark, sf_dir), "m2").select("doc_id", "root", "path")


def ocr_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.awaiting_ocr(registered(spark, sf_dir), "ocr:2").select("doc_id", "root", "path")


def reindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, d = registered(spark, sf_dir), F.col("doc_id")
    size, mtime = F.when(d % 13 == 0, F.col("size") + 1).otherwise(F.col("size")), F.when(d % 17 == 0, F.col("mtime") + 1).otherwise(F.col("mtime"))
    path = F.when(d % 19 == 0, F.concat("path", F.lit(".new"))).otherwise(F.col("path"))
    keyed = F.concat("root", d.cast("string"))
    seen = r.select("doc_id", keyed.alias("root"), path.alias("path"), size.alias("size"), mtime.alias("mtime"))
    return ops.reindex_decision(seen, r.withColumn("root", keyed), model="m2", parser=F.lit("txt:1"), chunker="c2").select("doc_id", "reason")


REINDEX_SQL = f"""with {REG} select doc_id, case when doc_id % 19 = 0 then 'new' when status in ('erro', 'timeout') then 'retry' when doc_id % 13 = 0 or doc_id % 17 = 0 then 'bytes' when parser like 'ocr:%' then null
  when model is distinct from 'm2' then 'model' when chunker <> 'c2' then 'chunker' when parser is distinct from 'txt:1' then 'parser' end as reason from reg"""


def stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = registered(spark, sf_dir).withColumn("root", F.col("doc_id").cast("string"))
    return ops.stamp_model(r, ops.awaiting_model(r, "m2").filter("doc_id % 2 = 0"), "m2").select("doc_id", "model")


def released(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = registered(spark, sf_dir)
    return ops.release(r.filter("status <> 'ok'").select("doc_id", "status"), r.filter("doc_id % 2 = 0"), ["doc_id"])


def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir).select("doc_id", "ordinal", "chunk_id", "text")
    ids = c.filter("ordinal % 3 = 0").select("chunk_id").unionByName(c.select(F.concat("chunk_id", F.lit("x")).alias("chunk_id")))
    return ops.chunks_by_id(c, registered(spark, sf_dir).filter("doc_id % 4 > 0"), ids).select("chunk_id", "path", "mtime", F.length("text").alias("chars"))


def ids_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = registered(spark, sf_dir).withColumn("path", F.concat("path", F.lit("#"), F.col("doc_id").cast("string")))
    found = ops.chunk_ids_by_path(chunks(spark, sf_dir), r, r.filter("doc_id % 3 = 0"))
    return found.select("path", F.size("chunk_ids").cast("long").alias("n"), F.md5(F.array_join("chunk_ids", ",").cast("binary")).alias("digest"))


def mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return ops.mention_frequency(li.select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("value")))


def folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = registered(spark, sf_dir).withColumn("root", F.col("doc_id").cast("string"))
    return ops.with_census(r.filter("doc_id % 5 > 0"), r.filter("doc_id % 3 > 0"), "src1/en").select("root", "path", "size", "only_seen")


def canonical_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = registered(spark, sf_dir)
    return ops.without_canonical(r, r.filter("doc_id % 3 = 0")).agg(F.count("*").alias("n"))


def lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter("l_quantity > 30").select(F.col("l_orderkey").alias("doc"))
    return ops.graph_lag(chunks(spark, sf_dir).select("doc_id"), li)


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = registered(spark, sf_dir)
    return ops.known_documents(r.filter("doc_id % 2 = 0"), r.filter("n_chunks > 2")).groupBy("root").agg(F.count("*").alias("n"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("status") == "ok", "ok").when(F.col("status") == "vazio", "aviso").otherwise("erro")
    return ops.health(registered(spark, sf_dir).select((F.col("doc_id") % 40).alias("base"), level.alias("level")))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = registered(spark, sf_dir)
    key = ops.parse_key(F.col("sha"), F.col("parser"), F.lit("native"), F.lit(None).cast("string"))
    store = r.filter("doc_id % 2 = 0").select(key.alias("key"), (F.col("doc_id") % 10 == 0).alias("corrupt"))
    return ops.parse_hits(r.select("doc_id", key.alias("key")), store)


def garbage(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = registered(spark, sf_dir)
    store = r.select("doc_id", F.when(F.col("doc_id") % 9 > 0, F.col("sha")).alias("sha"), F.col("mtime").alias("written"))
    return ops.parse_garbage(store, r.filter("doc_id % 3 = 0"), now=1_000_003.0, grace_s=300_000.0).select("doc_id")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the order table as a sheet per customer segment."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sha"), F.col("o_orderpriority").alias("sheet"))
    return o.groupBy("sha", "sheet").agg(F.count("*").alias("n"))


QUERIES = {
    "parse_references": (parse_references, f"with {REFS} select *, case when coalesce(base, '') <> '' and base <> 'main' then 'another base' end as conflict from parsed"),
    "resolve_references": (resolved, RESOLVE_SQL),
    "type_keys": (type_keys, TYPES_SQL),
    "indexable_files": (indexable, f"with {REG} select doc_id, path from reg where path like '%.pdf' or path like '%.txt'"),
    "pending_model": (pending_model, f"with {REG} select doc_id, root, path from reg where status = 'ok' and n_chunks > 0 and (model is null or model <> 'm2')"),
    "ocr_queue": (ocr_queue, f"with {REG} select doc_id, root, path from reg where scanned and (parser is null or parser not like 'ocr:%' or parser <> 'ocr:2')"),
    "reindex_decision": (reindexed, REINDEX_SQL),
    "stamped_models": (stamped, f"with {REG} select doc_id, case when doc_id % 2 = 0 and status = 'ok' and n_chunks > 0 then 'm2' else model end as model from reg"),
    "released_quarantine": (released, f"with {REG} select doc_id, status from reg where status <> 'ok' and doc_id % 2 <> 0"),
    "chunks_by_id": (looked_up, f"with {CHUNKS}, {REG} select c.chunk_id, r.path, r.mtime, length(c.text) as chars from chunks c left join reg r on c.doc_id = r.doc_id and r.doc_id % 4 > 0 where c.ordinal % 3 = 0"),
    "chunk_ids_by_path": (ids_by_path, f"with {CHUNKS}, {REG} select path || '#' || r.doc_id as path, count(*) as n, md5(string_agg(chunk_id, ',' order by ordinal)) as digest from chunks c join reg r on c.doc_id = r.doc_id where r.doc_id % 3 = 0 group by 1"),
    "mention_frequency": (mention_counts, "with m as (select distinct l_orderkey as doc, l_returnflag as kind, l_partkey as value from lineitem) select *, count(*) over (partition by kind, value) as documents from m"),
    "folder_with_census": (folder, f"with {REG} select doc_id::varchar as root, path, size, doc_id % 5 = 0 as only_seen from reg where path like 'src1/en/%' and (doc_id % 5 > 0 or doc_id % 3 > 0)"),
    "without_canonical": (canonical_gap, f"with {REG} select count(*) as n from reg where status = 'ok' and sha not in (select sha from reg where doc_id % 3 = 0)"),
    "model_coverage": (lambda s, d: ops.model_coverage(registered(s, d)), f"with {REG} select case when coalesce(model, '') = '' then 'lexical' else model end as model, count(*) as n from reg where status = 'ok' group by 1"),
    "text_volume": (lambda s, d: ops.text_volume(chunks(s, d)), f"with {CHUNKS} select doc_id, sum(length(text))::bigint as chars, count(*) as n from chunks group by 1"),
    "length_statistics": (lambda s, d: ops.length_statistics(chunks(s, d)), f"with {CHUNKS} select count(*) as n, sum(length(text))::bigint as total, round(avg(length(text)), 6) as mean, max(length(text))::bigint as most, min(length(text))::bigint as least from chunks"),
    "folder_quarantine": (lambda s, d: registered(s, d).filter("status <> 'ok'").filter(ops.in_folder(F.col("path"), "src2", True)).select("doc_id", "path", F.col("status").alias("reason")), f"with {REG} select doc_id, path, status as reason from reg where status <> 'ok' and path like 'src2/%'"),
    "graph_lag": (lag, "select (select count(distinct doc_id) from documents) as with_chunks, (select count(distinct l_orderkey) from lineitem where l_quantity > 30) as in_graph"),
    "known_documents": (known, f"with {REG} select root, count(*) as n from (select root, path from reg where doc_id % 2 = 0 union select root, path from reg where n_chunks > 2) group by 1"),
    "base_health": (states, f"with {REG}, g as (select doc_id % 40 as base, count(*) filter (status in ('erro', 'timeout')) as errors, count(*) filter (status = 'vazio') as warnings from reg group by 1) select *, case when errors > 0 then 'inoperante' when warnings > 0 then 'atencao' else 'saudavel' end as state from g"),
    "parse_store_hits": (stored, f"with {REG}, k as (select doc_id, sha256(concat_ws(chr(0), sha, coalesce(parser, ''), 'native', '', '1'))[1:32] as key from reg) select doc_id, key, exists (select 1 from k s where s.key = k.key and s.doc_id % 2 = 0 and s.doc_id % 10 <> 0) as hit from k"),
    "parse_store_garbage": (garbage, f"with {REG} select doc_id from reg where doc_id % 9 > 0 and 1000003 - mtime > 300000 and sha not in (select sha from reg where doc_id % 3 = 0)"),
    "cell_counts": (cells, "select o_custkey as sha, o_orderpriority as sheet, count(*) as n from orders group by all"),
}
