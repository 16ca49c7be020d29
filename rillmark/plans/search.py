"""Queries of the retrieval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, lexical, ranking
from .corpus import CHUNKS, PATHS, TOKENS, chunks, paths, questions, table

K = 10


def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.bm25(questions(spark, sf_dir), chunks(spark, sf_dir), k=K)
    return found.select("query_id", F.col("item").alias("chunk_id"), "score", "rank")


_POSTINGS = f"""{CHUNKS},
words as (select chunk_id as item, {TOKENS.format('text')} as w from chunks),
post as (select item, len(w) as length, unnest(w) as term from words),
tf as (select item, term, any_value(length) as length, count(*) as tf from post group by all),
size as (select count(*)::double as c, sum(len(w))::double as n from words),
qt as (select distinct item_id as query_id, unnest({TOKENS.format('text')}) as term from benchmark),
df as (select term, count(*)::double as df from tf group by term),
flag as (select query_id, qt.term, 2 * coalesce(df, 0) < (select c from size) as rare from qt left join df using (term)),
terms as (select query_id, term from (select *, bool_or(rare) over (partition by query_id) as any_rare from flag) where rare or not any_rare),
scored as (select query_id, item, round(sum(greatest(ln(((select c from size) - df + 0.5) / (df + 0.5)), 1e-6) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / ((select n from size) / (select c from size)))))), 6) as score
  from terms join tf using (term) join df using (term) group by query_id, item),
lex as (select *, row_number() over (partition by query_id order by score desc, item)::int as rank from scored)"""

BM25_SQL = f"with {_POSTINGS} select query_id, item as chunk_id, score, rank from lex where rank <= {K}"


def postings_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.postings(chunks(spark, sf_dir))
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("most"))


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return lexical.phrase_hits(questions(spark, sf_dir), docs).select("query_id", F.col("item").alias("doc_id"), "hits")




def phrase_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(spark, sf_dir).select("query_id", "doc_id", F.lit(1).cast("long").alias("found"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return ranking.exact_neighbours(rows.filter("id % 20 = 0"), rows, k=K).select("query_id", F.col("item").alias("vec_id"), "score", "rank")


KNN_SQL = f"""with pairs as (select q.vec_id as query_id, e.vec_id, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) as score
  from embeddings q join embeddings e on q.vec_id <> e.vec_id where q.vec_id % 20 = 0)
select * from (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from pairs) where rank <= {K}"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path"))
    asked = _page_queries(spark, sf_dir)
    return ranking.name_ranking(asked, pages.distinct(), k=K).select("query_id", F.col("item").alias("path"), "score", "rank")


def _page_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").filter("page_id % 20 = 0")
    return pages.select(F.col("page_id").alias("query_id"), F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[/._-]", " ").alias("text"))


_NAME_TOKENS = "list_filter(list_distinct(regexp_extract_all(strip_accents(lower({0})), '[0-9a-z]+')), lambda x: length(x) > 1)"
NAMES_SQL = f"""with q as (select page_id as query_id, {_NAME_TOKENS.format("regexp_replace(regexp_replace(url, '^https?://', ''), '[/._-]', ' ', 'g')")} as w from pages where page_id % 20 = 0),
p as (select distinct regexp_replace(url, '^https?://', '') as path from pages),
t as (select path, {_NAME_TOKENS.format("regexp_replace(list_last(string_split(path, '/')), '\\.[^.]*$', '')")} as own,
  {_NAME_TOKENS.format("array_to_string(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1), '/')")} as dirs from p),
s as (select query_id, path, (2 * len(list_intersect(w, own)) + len(list_filter(list_intersect(w, dirs), lambda x: not list_contains(own, x))))::bigint as score from q, t)
select * from (select *, row_number() over (partition by query_id order by score desc, length(path), path)::int as rank from s where score > 0) where rank <= {K}"""


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by BM25 and by phrase rank, fused; documents by their first chunk."""
    lex = lexical.bm25(questions(spark, sf_dir), chunks(spark, sf_dir), k=50)
    docs = ranking.first_per_document(lex.withColumn("doc", F.substring_index("item", ":", 1).cast("long")))
    exact = phrases(spark, sf_dir).select("query_id", F.col("doc_id").alias("item"), F.col("hits").cast("double").alias("score"))
    exact = lexical.top_k(exact.withColumn("score", F.lit(1.0)), 50)
    return ranking.fuse([docs, exact], [1.0, 0.5], k=K).select("query_id", F.col("item").alias("doc_id"), "score", "rank")


HYBRID_SQL = f"""with {_POSTINGS},
first as (select query_id, split_part(item, ':', 1)::bigint as doc_id, min(rank) as r from lex where rank <= 50 group by all),
docs as (select query_id, doc_id, row_number() over (partition by query_id order by r, doc_id) as rank from first),
ph as (select query_id, doc_id, row_number() over (partition by query_id order by doc_id) as rank from (
  select item_id as query_id, doc_id from (select item_id, ' ' || array_to_string({TOKENS.format('text')}, ' ') || ' ' as p from benchmark)
  join (select doc_id, ' ' || array_to_string({TOKENS.format('text')}, ' ') || ' ' as t from documents) on contains(t, p))),
fused as (select query_id, doc_id, round(sum(part), 9) as score from (select query_id, doc_id, 1.0::double / (60 + rank) as part from docs
  union all select query_id, doc_id, 0.5::double / (60 + rank) from ph where rank <= 50) group by all)
select * from (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from fused) where rank <= {K}"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranking of files whose names carry versions, copies and formats."""
    p = table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    base = F.concat(F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")), F.lit("/report "), (n % 37).cast("string"))
    mark = F.when(n % 5 == 0, F.concat(F.lit("_v"), (n % 4).cast("string"), F.lit("."), (n % 12).cast("string"))).when(n % 5 == 1, " - copy").when(n % 5 == 2, " (2)").when(n % 5 == 3, "_v1 final").otherwise("")
    ext = F.when(n % 3 == 0, ".pdf").otherwise(".docx")
    rows = p.select((n % 4).alias("query_id"), F.concat(base, mark, ext).alias("path"), n.alias("rank"), (1_000_000 + (n * 31) % 977).alias("mtime"))
    return rows.groupBy("query_id", "path").agg(F.min("rank").alias("rank"), F.max("mtime").alias("mtime"))


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ranking.collapse_families(_versions(spark, sf_dir))
    return got.select("query_id", "path", "position", F.array_join("formats", ",").alias("formats"), F.array_join("older", ",").alias("older"))


FAMILIES_SQL = r"""with raw as (select p_partkey % 4 as query_id, lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) || '/report ' || (p_partkey % 37) as base, lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) as dir, p_partkey as n from part),
named as (select query_id, base, dir, case n % 5 when 0 then '_v' || (n % 4) || '.' || (n % 12) when 1 then ' - copy' when 2 then ' (2)' when 3 then '_v1 final' else '' end as mark,
  case when n % 3 = 0 then 'pdf' else 'docx' end as ext, n as rank, 1000000 + (n * 31) % 977 as mtime from raw),
files as (select query_id, base, dir, mark, ext, min(rank) as rank, max(mtime) as mtime, base || mark || '.' || ext as path,
  case when mark like '_v_.%' then string_split(substr(mark, 3), '.')::int[] when mark = '_v1 final' then [1] end as v from named group by query_id, base, dir, mark, ext),
fam as (select *, count(distinct v) over (partition by query_id, base, ext) > 1 as declared, min(rank) over (partition by query_id, base, ext) as best from files),
placed as (select *, row_number() over (partition by query_id, base, ext order by case when declared then coalesce(v, []) end desc nulls last,
  case when declared then mtime end asc nulls last, case when declared then path end desc nulls last, case when not declared then mtime end desc nulls last, path) as place from fam),
won as (select query_id, base, ext, min(best) as position, max(case when place = 1 then path end) as path,
  coalesce(string_agg(path, ',' order by place) filter (where place > 1), '') as older from placed group by query_id, base, ext),
grouped as (select *, row_number() over (partition by query_id, base order by position, path) as n from won),
formats as (select query_id, base, string_agg(ext, ',' order by ext) as formats from won group by query_id, base)
select query_id, path, position, formats, older from grouped join formats using (query_id, base) where n = 1"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose names stack marks of copies, states, versions and initials."""
    p = table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    pick = lambda d, *values: F.element_at(F.array(*map(F.lit, values)), (F.floor(n / d) % len(values) + 1).cast("int"))
    name = F.concat(pick(1, "", "Cópia de ", "COPY OF "), F.lower(F.substring_index("p_name", " ", 1)), pick(3, "", "_v6_Comentado", " final", "_revisadaTI_GC", " apresentado_v3", "-bkp2.1", " (2)", "_de", " v2.1 FINAL (3)", "Final"), pick(30, "", "_GC", " rev2"))
    return p.select(F.concat(F.lit("Área/"), name, pick(7, ".pdf", ".PDF", ".docx")).alias("path"), (n * 31 % 977).alias("mtime")).groupBy("path").agg(F.max("mtime").alias("mtime"))


_FILES = """files as (select 'Área/' || ['', 'Cópia de ', 'COPY OF '][(p_partkey % 3 + 1)::int] || lower(split_part(p_name, ' ', 1)) || ['', '_v6_Comentado', ' final', '_revisadaTI_GC', ' apresentado_v3', '-bkp2.1', ' (2)', '_de', ' v2.1 FINAL (3)', 'Final'][(p_partkey // 3 % 10 + 1)::int]
    || ['', '_GC', ' rev2'][(p_partkey // 30 % 3 + 1)::int] || ['.pdf', '.PDF', '.docx'][(p_partkey // 7 % 3 + 1)::int] as path, max(p_partkey * 31 % 977) as mtime from part group by 1)"""


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return _files(spark, sf_dir).select("path", ranking.stem(p).alias("stem"), F.array_join(ranking.version(p).cast("array<string>"), ".").alias("version"))


_STEMS = rf"""{_FILES}, bare as (select path, mtime, regexp_replace(split_part(path, '/', -1), '\.[^.]*$', '') as whole from files),
strips as (select path, whole as now, 0 as n, length(whole) // 2 + 1 as steps from bare union all
  select path, regexp_replace(regexp_replace(now, '{ranking.INITIALS}', ''), '(?i){ranking._MARKS}', '\1', 'g'), n + 1, steps from strips where n < steps),
lasts as (select path, trim(regexp_replace(strip_accents(lower(arg_max(now, n))), '{ranking.SEPARATORS}', ' ', 'g')) as bare from strips group by path),
stems as (select path, mtime, case when bare = '' then strip_accents(lower(whole)) else bare end as stem, whole from bare join lasts using (path))"""
STEMS_SQL = rf"""with recursive {_STEMS} select path, stem, replace(substr(regexp_extract_all(whole, '(?i)[ _-]({ranking.VERSION})(?:[^\p{{L}}\p{{N}}_]|$)', 1)[-1], 2), '_', '.') as version from stems"""


def newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.newest_of_families(_files(spark, sf_dir))


NEWEST_SQL = rf"""with recursive {_STEMS} select path, mtime from (select *, row_number() over (partition by lower(regexp_extract(path, '[^.]*$')), stem order by mtime desc, path desc) as n from stems) where n = 1"""


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_chunks = chunks(spark, sf_dir)
    hits = all_chunks.filter("ordinal % 5 = 2").select((F.col("doc_id") % 7).alias("query_id"), "doc_id", "ordinal")
    got = ranking.context(hits, all_chunks, 2)
    return got.select("doc_id", "ordinal", F.md5(F.col("before").cast("binary")).alias("before"), F.md5(F.col("after").cast("binary")).alias("after"))


CONTEXT_SQL = f"""with {CHUNKS}, hits as (select doc_id, ordinal from chunks where ordinal % 5 = 2),
near as (select h.doc_id, h.ordinal, c.ordinal as o, c.text from hits h join chunks c on c.doc_id = h.doc_id and c.ordinal between h.ordinal - 2 and h.ordinal + 2 and c.ordinal <> h.ordinal)
select doc_id, ordinal, md5(trim(coalesce(string_agg(text, chr(10) order by o) filter (where o < ordinal), ''), ' ')) as before,
  md5(trim(coalesce(string_agg(text, chr(10) order by o) filter (where o > ordinal), ''), ' ')) as after
from hits left join near using (doc_id, ordinal) group by doc_id, ordinal"""


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions in the paragraphs of the documents, the first of which carries made-up identifiers besides."""
    n = F.col("doc_id")
    part = lambda d, low, most: (low + F.pmod(F.floor(n / d), F.lit(most))).cast("string")
    added = F.concat(
        F.lit(";  abnt nbr iso/iec "), part(5, 27000, 70000), F.lit(":2015;  PO-V"), part(7, 1, 1000000), F.lit("-12;  PL "), part(3, 10, 900000), F.lit("/2023;  Lei nº "),
        part(4, 10, 900000), F.lit("/1993;  NR-"), part(6, 10000, 90000), F.lit("2019;  CT-0142;  12.345.678/0001-"), part(2, 10, 90), F.lit(";  "),
    )
    rows = chunks(spark, sf_dir).select("doc_id", "ordinal", F.when(F.col("ordinal") == 0, F.concat("text", added)).otherwise(F.col("text")).alias("text"))
    return graph.mentions(rows)


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mentions(spark, sf_dir).select("doc", "kind", "value", "first")


_EDGE = "[^0-9A-Za-zÀ-ÿ]"
_FOUND = " union all ".join(
    f"select doc_id as doc, ordinal, '{kind}' as kind, unnest(regexp_extract_all(text, '{p[:4] if p.startswith('(?i)') else ''}(?:^|{_EDGE})({p.removeprefix('(?i)')})(?:{_EDGE}|$)', 1)) as raw from marked" for kind, p in graph.KINDS
)
_MENTIONS = f"""{CHUNKS},
marked as (select doc_id, ordinal, case when ordinal > 0 then text else text || ';  abnt nbr iso/iec ' || (27000 + doc_id // 5 % 70000) || ':2015;  PO-V' || (1 + doc_id // 7 % 1000000) || '-12;  PL ' || (10 + doc_id // 3 % 900000)
  || '/2023;  Lei nº ' || (10 + doc_id // 4 % 900000) || '/1993;  NR-' || (10000 + doc_id // 6 % 90000) || '2019;  CT-0142;  12.345.678/0001-' || (10 + doc_id // 2 % 90) || ';  ' end as text from chunks),
raws as ({_FOUND}), single as (select *, trim(regexp_replace(raw, '\\s+', ' ', 'g')) as one from raws),
cut as (select *, list_filter(regexp_split_to_array(upper(one), '[\\s/-]+'), lambda p: not regexp_matches(p, '^[0-9]')) as named, list_filter(regexp_split_to_array(upper(one), '[\\s/-]+'), lambda p: regexp_matches(p, '^[0-9]'))[1] as num,
  upper(split_part(one, ' ', 1)) as species, trim(regexp_replace(case when contains(one, ' ') then regexp_replace(one, '^[^ ]+ ', '') else '' end, 'n[º°.]', '', 'g')) as rest from single),
worded as (select *, case when kind = 'norma' then coalesce(list_filter([{", ".join(repr(b) for b in graph.BODIES)}], lambda b: list_contains(named, b))[1], named[-1]) || ' ' || regexp_replace(replace(split_part(num, ':', 1), '.', ''), '^([0-9]{{4,5}})(19|20)[0-9]{{2}}$', '\\1')
  when kind = 'lei' then trim(species || ' ' || case when species in ({", ".join(repr(b) for b in graph.PROMULGATED)}) then split_part(rest, '/', 1) else rest end) when kind = 'codigo' then upper(raw) else raw end as value from cut),
mentions as (select doc, kind, value, min(ordinal)::int as first from worded group by all)"""


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(_mentions(spark, sf_dir)).select("doc", "other", "weight", "shared", "rank")


def graph_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _mentions(spark, sf_dir)
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("doc").alias("documents"), F.countDistinct("value").alias("identifiers"))


QUERIES = {
    "bm25_search": (bm25, BM25_SQL),
    "postings_statistics": (
        postings_statistics,
        f"with {CHUNKS}, w as (select chunk_id, unnest({TOKENS.format('text')}) as term from chunks), tf as (select chunk_id, term, count(*) as tf from w group by all) select term, count(*) as df, sum(tf)::bigint as cf, max(tf) as most from tf group by term",
    ),
    "phrase_search": (
        phrase_documents,
        f"select item_id as query_id, doc_id, 1::bigint as found from (select item_id, ' ' || array_to_string({TOKENS.format('text')}, ' ') || ' ' as p from benchmark) join (select doc_id, ' ' || array_to_string({TOKENS.format('text')}, ' ') || ' ' as t from documents) on contains(t, p)",
    ),
    "vector_knn_exact": (knn, KNN_SQL),
    "name_ranking": (names, NAMES_SQL),
    "hybrid_search": (hybrid, HYBRID_SQL),
    "version_families": (families, FAMILIES_SQL),
    "file_stems": (stems, STEMS_SQL),
    "newest_of_families": (newest, NEWEST_SQL),
    "context_window": (context, CONTEXT_SQL),
    "identifier_mentions": (mentions, f"with {_MENTIONS} select doc, kind, value, first from mentions"),
    "graph_neighbours": (
        neighbours,
        f"with {_MENTIONS}, df as (select kind, value, count(distinct doc) as df from mentions group by all having count(distinct doc) between 2 and 40), rare as (select doc, kind, value, df from mentions join df using (kind, value)), s as (select a.doc, b.doc as other, round(sum(1.0::double / a.df), 9) as weight, count(*) as shared from rare a join rare b using (kind, value) where a.doc <> b.doc group by all) select * from (select *, row_number() over (partition by doc order by weight desc, other)::int as rank from s) where rank <= 10",
    ),
    "graph_statistics": (graph_statistics, f"with {_MENTIONS} select kind, count(*) as n, count(distinct doc) as documents, count(distinct value) as identifiers from mentions group by kind"),
}
