"""Queries of the column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, rules, text, vectors
from ..operators.graph import identifiers
from .corpus import PATHS, TOKENS, paths, table


def folded_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(text.tokens(F.col("text"))).alias("n"), F.md5(F.array_join(text.tokens(F.col("text")), " ").cast("binary")).alias("digest"))


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    got = text.html_text(F.col("html"))
    return pages.select("page_id", F.length(got).alias("n"), F.md5(got.cast("binary")).alias("digest"))


_HTML = r"regexp_replace(html, '(?is)<(script|style|head)\b.*?</(script|style|head)\s*>', ' ', 'g')"
_HTML = rf"regexp_replace({_HTML}, '(?i)</?({text.BLOCK_TAGS})\b[^>]*>', chr(10), 'g')"
_HTML = rf"regexp_replace({_HTML}, '(?s)<[^>]*>', '', 'g')"
for _entity, _char in text.ENTITIES:
    _HTML = f"replace({_HTML}, '{_entity}', '{_char.replace(chr(39), chr(39) * 2)}')"
_HTML = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({_HTML}, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{2,}}', chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def clean_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("see "), F.col("url"), F.lit("?q="), F.repeat(F.lit("abc"), 5), F.lit(" and cid:part1.png  or "), F.repeat(F.lit("Zx9"), 25), F.lit("\n\n\n\nend"))
    return table(spark, sf_dir, "pages").select("page_id", text.clean_body(raw).alias("body"))


CLEAN_SQL = r"""select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  'see ' || url || '?q=' || repeat('abc', 5) || ' and cid:part1.png  or ' || repeat('Zx9', 25) || chr(10) || chr(10) || chr(10) || chr(10) || 'end',
  'https?://([^/\s>\])]+)[^\s>\])]*', '(link: \1)', 'g'), 'cid:[^\s>\])]+', '', 'g'), '[A-Za-z0-9+/=_-]{60,}', '…', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ') as body from pages"""


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = table(spark, sf_dir, "documents").select("doc_id", "lang", text.language(F.col("text")).alias("measured"))
    return got.groupBy("lang", "measured").agg(F.count("*").alias("n"))


_COUNT = "len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+'), lambda w: w in ({0})))"
LANGUAGES_SQL = (
    "with c as (select lang, "
    + ", ".join(f"{_COUNT.format(', '.join(repr(w) for w in words))} as {name}" for name, words in text.MARKERS.items())
    + " from documents) select lang, case when greatest(pt, en) < 2 then 'indefinido' when pt >= 1.5 * en then 'pt' when en >= 1.5 * pt then 'en' else 'misto' end as measured, count(*) as n from c group by all"
)


def path_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = paths(spark, sf_dir)
    path = F.col("path")
    return files.select(
        "doc_id",
        keys.occurrence_id(F.lit("root"), path).alias("occurrence"),
        keys.chunk_id(path, F.array(F.lit("a"), F.lit("b")), F.lit(""), F.lit(3)).alias("chunk"),
        keys.document_id(F.col("sha")).alias("public_id"),
        keys.size_band(F.col("size")).alias("band"),
        keys.source_group(path).alias("source_group"),
        keys.human_bytes(F.col("size") * 37).alias("human"),
        keys.in_prefix_range(F.col("sha"), "a").alias("in_range"),
        keys.in_folder(path, "src1/en").alias("in_folder"),
        text.searchable_path(path).alias("searchable"),
        text.document_name(path).alias("name"),
        text.slug(path).alias("slug"),
        keys.column_letters(F.col("doc_id") % 800 + 1).alias("letters"),
        keys.clock_text(F.col("doc_id") * 7).alias("clock"),
        F.round(keys.clock_seconds(F.concat(F.lit("1:"), keys.clock_text(F.pmod("doc_id", F.lit(3000))), F.lit(",5"))), 3).alias("seconds"),
    )


PATH_KEYS_SQL = f"""with {PATHS} select doc_id,
  substr(sha256(encode('root') || '\\x00'::blob || encode(path)), 1, 16) as occurrence,
  substr(sha1('2' || chr(31) || path || chr(31) || 'a > b' || chr(31) || '' || chr(31) || '3'), 1, 16) as chunk,
  substr(sha, 1, 12) as public_id,
  case when size <= 0 then '0 B' when size < 1024 then '< 1 KB' when size < 10240 then '1-10 KB' when size < 102400 then '10-100 KB' when size < 1048576 then '100 KB-1 MB' when size < 10485760 then '1-10 MB' when size < 104857600 then '10-100 MB' else '>= 100 MB' end as band,
  'escritorio' as source_group,
  case when size * 37 < 1024 then (size * 37) || ' B' when size * 37 < 1048576 then printf('%.1f', round(size * 37 / 1024.0::double, 1)) || ' KB' else printf('%.1f', round(size * 37 / 1048576.0::double, 1)) || ' MB' end as human,
  sha >= 'a' and sha < 'ag' as in_range, starts_with(path, 'src1/en/') as in_folder,
  trim(regexp_replace(regexp_replace(path, '[/_]', ' ', 'g'), '\\s+', ' ', 'g')) as searchable,
  'doc ' || doc_id as name, trim(regexp_replace(path, '[^a-z0-9]+', '-', 'g'), '-') as slug,
  case when n > 702 then chr((65 + ((((n - 1) // 26 - 1) // 26) - 1) % 26)::int) else '' end || case when n > 26 then chr((65 + ((n - 1) // 26 - 1) % 26)::int) else '' end || chr((65 + (n - 1) % 26)::int) as letters,
  case when doc_id * 7 >= 3600 then (doc_id * 7 // 3600) || ':' || lpad((doc_id * 7 % 3600 // 60)::varchar, 2, '0') || ':' || lpad((doc_id * 7 % 60)::varchar, 2, '0') else lpad((doc_id * 7 // 60)::varchar, 2, '0') || ':' || lpad((doc_id * 7 % 60)::varchar, 2, '0') end as clock,
  (3600 + doc_id % 3000 + 0.5)::double as seconds
from (select *, doc_id % 800 + 1 as n from paths)"""


def period_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    n = F.col("o_orderkey") % 4
    period = F.when(n == 0, F.substring("d", 1, 4)).when(n == 1, F.substring("d", 1, 7)).when(n == 2, F.col("d")).otherwise("2023-13")
    first, last = keys.period_bounds(period)
    return o.select("o_orderkey", F.unix_micros(first).alias("first"), F.unix_micros(last).alias("last"))


PERIOD_SQL = """select o_orderkey, case o_orderkey % 4 when 3 then null else epoch_us(t) end as first,
  case o_orderkey % 4 when 0 then epoch_us(t + interval 1 year) - 1 when 1 then epoch_us(t + interval 1 month) - 1 when 2 then epoch_us(t + interval 1 day) - 1 end as last
from (select o_orderkey, date_trunc(case o_orderkey % 4 when 0 then 'year' when 1 then 'month' else 'day' end, o_orderdate)::timestamp as t from orders)"""


def vector_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    v = F.col("embedding")
    flipped = F.reverse(v)
    return e.select("vec_id", F.round(vectors.cosine(v, flipped), 6).alias("cosine"), F.round(vectors.norm(vectors.normalise(v)), 6).alias("length"), F.round(F.array_max(F.transform(vectors.scale_to_peak(v.cast("array<double>")), F.abs)), 6).alias("peak"))


VECTOR_SQL = "select vec_id, round(list_cosine_similarity(embedding::double[], list_reverse(embedding)::double[]), 6) as cosine, 1.0::double as length, 0.95::double as peak from embeddings"


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", text.keywords(F.col("text"), ("the", "of", "and", "de"), 6).alias("keywords"))


KEYWORDS_SQL = r"select item_id, array_to_string(list_slice(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}+#-]+'), lambda w: length(w) > 1 and w not in ('the', 'of', 'and', 'de')), 1, 6), ' ') as keywords from benchmark"

#: Word boundaries are written out: engines differ in what \b takes for a letter.
_ALONE = r"(?i)(^|[^\p{L}\p{N}_])%s([^\p{L}\p{N}_]|$)"
CLASSES = {"german": (_ALONE % "und", _ALONE % "der", "ß"), "english": (_ALONE % "and", _ALONE % "the"), "license": ("(?i)licen[cs]e", "(?i)apache")}
RULES = (("licensed under", "under"), ("the ", "a "), ("[0-9]{3,}", "#"))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, confidence = rules.classify(F.col("text"), CLASSES, "none")
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("class"), confidence.alias("confidence"))


def _count_sql(patterns: tuple[str, ...]) -> str:
    return " + ".join(f"regexp_matches(text, '{p}')::int" for p in patterns)


CLASSIFIED_SQL = (
    "with c as (select doc_id, " + ", ".join(f"{_count_sql(p)} as {c}" for c, p in CLASSES.items()) + " from documents), m as (select *, greatest(german, english, license) as most from c) "
    "select doc_id, case when most = 0 then 'none' when german = most then 'german' when english = most then 'english' else 'license' end as class, "
    "case when most > 0 then least(0.95::double, round(0.6::double + 0.1::double * most, 2)) else 0.55::double end as confidence from m"
)


def scrubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, hits = rules.scrub(F.col("text"), RULES)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(out.cast("binary")).alias("digest"), F.length(out).alias("n"))


_SCRUB = "text"
for _pattern, _new in RULES:
    _SCRUB = f"regexp_replace({_SCRUB}, '(?i){_pattern}', '{_new}', 'g')"
_SCRUB = f"trim(regexp_replace({_SCRUB}, ' {{2,}}', ' ', 'g'), ' ')"


def rhythm(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, mean, variance = rules.sentence_rhythm(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("sentences"), F.round(mean, 6).alias("mean"), F.round(variance, 6).alias("variance"))


RHYTHM_SQL = """with p as (select doc_id, list_filter(regexp_split_to_array(text, '[.!?]+(?:\\s+|$)'), lambda s: length(trim(s)) > 0) as parts from documents),
l as (select doc_id, list_transform(parts, lambda s: len(regexp_split_to_array(trim(s), '\\s+'))::double) as lens from p)
select doc_id, len(lens)::int as sentences, round(coalesce(list_avg(lens), 0), 6) as mean, round(coalesce(list_var_samp(lens), 0), 6) as variance from l"""

QUERIES = {
    "classified_texts": (classified, CLASSIFIED_SQL),
    "scrubbed_texts": (scrubbed, f"select doc_id, md5(t) as digest, length(t)::int as n from (select doc_id, {_SCRUB} as t from documents)"),
    "sentence_rhythm": (rhythm, RHYTHM_SQL),
    "folded_tokens": (folded_tokens, f"select doc_id, len({TOKENS.format('text')})::int as n, md5(array_to_string({TOKENS.format('text')}, ' ')) as digest from documents"),
    "html_to_text": (html_text, f"select page_id, length(t)::int as n, md5(t) as digest from (select page_id, {_HTML} as t from pages)"),
    "clean_body": (clean_body, CLEAN_SQL),
    "language_evidence": (languages, LANGUAGES_SQL),
    "path_keys": (path_keys, PATH_KEYS_SQL),
    "period_bounds": (period_bounds, PERIOD_SQL),
    "vector_arithmetic": (vector_arithmetic, VECTOR_SQL),
    "search_keywords": (keywords, KEYWORDS_SQL),
}
