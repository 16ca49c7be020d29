"""Queries of slices, coverage, gates, choices, cells and glossary expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells, glossary
from ..operators import model_choice, selection
from .corpus import TOKENS, table

_LANGS = ("pt", "en", "misto", "")


def _pick(n, d: int, *values):
    """One of the values in turn, every ``d`` rows the next."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(n / d) % len(values) + 1).cast("int"))


def _turn(n: str, d: int, *values) -> str:
    listed = ", ".join("null" if v is None else repr(v) if not isinstance(v, bool) else str(v).lower() for v in values)
    return f"[{listed}][({n} // {d} % {len(values)} + 1)::int]"


# -- questions over orders: every order is a question, its lines are the sources ------------

_EXT = (".pdf", ".eml", ".vtt", ".docx", ".pdf", ".pdf")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        n.alias("query_id"), _pick(n, 1, *_LANGS).alias("language"), _pick(n, 3, "pt", "en", "").alias("annotated"), _pick(n, 2, "todas", "qualquer").alias("mode"), (n % 7 > 0).alias("in_scope"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 3")
    p = F.col("l_partkey")
    path = F.concat(F.lit("top"), (p % 30).cast("string"), F.lit("/inbox"), (p % 4).cast("string"), F.lit("/f"), p.cast("string"), _pick(p, 1, *_EXT))
    return li.select(F.col("l_orderkey").alias("query_id"), F.when(p % 50 > 0, path).otherwise(F.concat(F.lit("f"), p.cast("string"), F.lit(".pdf"))).alias("path"), _pick(p, 7, "pt", "pt", "en", "").alias("language"))


_Q = f"""q as (select o_orderkey as query_id, {_turn('o_orderkey', 1, *_LANGS)} as language, {_turn('o_orderkey', 3, 'pt', 'en', '')} as annotated, {_turn('o_orderkey', 2, 'todas', 'qualquer')} as mode, o_orderkey % 7 > 0 as in_scope from orders)"""
_S = f"""s as (select l_orderkey as query_id, case when l_partkey % 50 > 0 then 'top' || (l_partkey % 30) || '/inbox' || (l_partkey % 4) || '/f' || l_partkey || {_turn('l_partkey', 1, *_EXT)} else 'f' || l_partkey || '.pdf' end as path,
  {_turn('l_partkey', 7, 'pt', 'pt', 'en', '')} as language from lineitem where l_linenumber <= 3)"""
_GROUP = "case when path like '%.eml' then 'email' when path like '%.vtt' then 'reuniao' else 'escritorio' end"
_GROUPS = f"g as (select query_id, case when count(distinct {_GROUP}) = 1 then max({_GROUP}) else 'misto' end as \"group\" from s group by 1)"
_UNDECIDED = "('', 'indefinido', 'misto')"
_SETS = f"m as (select query_id, case when bool_or(language in {_UNDECIDED}) then 'indefinido' when count(distinct language) = 1 then max(language) else 'misto' end as source_language from s group by 1)"
_SLICE = f"case when q.language in {_UNDECIDED} or coalesce(m.source_language, '') in {_UNDECIDED} then 'não declarado' when q.language = m.source_language then 'mesma-língua' else 'cross-lingual' end"


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.question_groups(sources(spark, sf_dir))


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = selection.set_language(sources(spark, sf_dir)).withColumnRenamed("language", "source_language")
    return questions(spark, sf_dir).join(own, "query_id").select("query_id", "source_language", selection.pair_slice(F.col("language"), F.col("source_language")).alias("slice"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("query_id")
    rows = slices(spark, sf_dir).join(groups(spark, sf_dir), "query_id")
    return rows.withColumn("recall_at_1", (n % 3 == 0).cast("int")).withColumn("reciprocal_rank", 1 / (1 + n % 8))


_JUDGED = f"{_Q}, {_S}, {_GROUPS}, {_SETS}, j as (select q.query_id, g.\"group\", {_SLICE} as slice, (q.query_id % 3 = 0)::int as recall_at_1, 1.0::double / (1 + q.query_id % 8) as reciprocal_rank from q join m using (query_id) join g using (query_id))"
_MEANS = "count(*) as n, round(avg(recall_at_1), 6) as recall_at_1, round(avg(reciprocal_rank), 6) as reciprocal_rank"
METRICS = ("recall_at_1", "reciprocal_rank")


def by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.means_by(_judged(spark, sf_dir), {"group": (*selection.GROUPS, "outro")}, METRICS)


def by_group_and_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.means_by(_judged(spark, sf_dir), {"group": selection.GROUPS, "slice": (*selection.SLICES, "outra")}, METRICS)


def language_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.language_differences(questions(spark, sf_dir).select("query_id", "annotated"), selection.set_language(sources(spark, sf_dir)))


def unexercised(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("rank"))
    n = F.col("query_id")
    after = li.withColumn("item", F.when((n % 5 == 1) & (n % 64 < 9), F.col("item") + 1).otherwise(F.col("item"))).filter("query_id % 9 > 0")
    return selection.unexercised(li, after, li.select("query_id", (n % 5).alias("slice")).distinct())


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    path = F.concat(F.lit("top"), (p % 40).cast("string"), F.lit("/inbox"), (p % 4).cast("string"), F.lit("/f"), p.cast("string"), _pick(p, 1, *_EXT))
    return table(spark, sf_dir, "part").select(F.when(p % 50 > 0, path).otherwise(F.concat(F.lit("f"), p.cast("string"), F.lit(".pdf"))).alias("path"))


_U = f"""u as (select distinct case when p_partkey % 50 > 0 then 'top' || (p_partkey % 40) || '/inbox' || (p_partkey % 4) || '/f' || p_partkey || {_turn('p_partkey', 1, *_EXT)} else 'f' || p_partkey || '.pdf' end as path from part),
few as (select * from s where query_id % 100 = 1), d as (select distinct path from few)"""
_TOP = "case when contains(path, '/') then split_part(path, '/', 1) else '(raiz)' end"


def _few(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of one question in a hundred: a few questions over a large universe."""
    return sources(spark, sf_dir).filter("query_id % 100 = 1")


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.coverage_by_folder(universe(spark, sf_dir), _few(spark, sf_dir))


_FOLDERS = f"f as (select {_TOP} as folder, count(*) as documents from u group by 1), n as (select {_TOP} as folder, count(*) as sources from d group by 1), c as (select folder, documents, coalesce(sources, 0) as sources from f left join n using (folder))"


def covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.coverage(universe(spark, sf_dir), _few(spark, sf_dir))


def scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.scope_findings(questions(spark, sf_dir), sources(spark, sf_dir), universe(spark, sf_dir))


def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    turned = F.when(F.col("id") % 10 == 0, F.transform("v", lambda x, i: F.when(i == 0, x + 1).otherwise(x))).otherwise(F.transform("v", lambda x: x * 2))
    return selection.vector_agreement(e.filter("id % 3 > 0"), e.filter("id % 4 > 0").select("id", turned.alias("v")))


AGREEMENT_SQL = """with a as (select vec_id as id, list_transform(embedding, lambda x: x::double) as v from embeddings where vec_id % 3 > 0),
b as (select vec_id as id, case when vec_id % 10 = 0 then list_transform(embedding, lambda x, i: case when i = 1 then (x + 1::float)::double else x::double end) else list_transform(embedding, lambda x: (x * 2::float)::double) end as v from embeddings where vec_id % 4 > 0),
j as (select a.v is not null as l, b.v is not null as r, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) as c from a full join b using (id))
select count(*) filter (l and r) as common, count(*) filter (not r) as only_a, count(*) filter (not l) as only_b, round(min(c), 6) as least, round(avg(c), 6) as mean, count(*) filter (c <= 0.9999) as different from j"""


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    samples = c.groupBy(F.col("c_nationkey").cast("string").alias("operation")).agg(F.max("c_acctbal").alias("p95"))
    limits = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("operation"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(b).alias("bound")) for k, b in (("produto", 9000.0), ("regressao", 9900.0))])).alias("g"))
    return selection.gate_violations(samples, limits.select("operation", "g.kind", "g.bound"))


def ann_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("nprobes"), (F.col("s_suppkey") % 10 / 10.0).alias("recall"), F.round("s_acctbal", 0).alias("p95"))
    return selection.fastest_sound(results, least_recall=0.3)


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    arm = F.when(n == 1, "raro").otherwise(_pick(n, 1, "livre", "outro", "terceiro"))
    runs = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("machine"), arm.alias("arm"), F.col("c_acctbal").alias("median"), (n % 40 == 0).alias("changed"))
    return selection.arm_contrast(runs.filter("arm <> 'raro'")).withColumn("set", F.lit("whole")).unionByName(selection.arm_contrast(runs).withColumn("set", F.lit("thin")))


_ARMS = f"""runs as (select case when c_custkey = 1 then 'raro' else {_turn('c_custkey', 1, 'livre', 'outro', 'terceiro')} end as arm, c_acctbal as median, c_custkey % 40 = 0 as changed from customer)"""


def _arms_sql(name: str, where: str) -> str:
    return f"""select arm, replicates, case when thin then null else med end as median, changed, case when thin then null else round(med / base, 2) end as ratio, case when thin then 'recusado' else 'medido' end as verdict, '{name}' as set
from (select *, min(replicates) over () < 2 as thin, max(med) filter (arm = 'livre') over () as base from (select arm, count(*) as replicates, round(median(round(median, 4)), 4) as med, bool_or(changed) as changed from runs {where} group by 1))"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        n.alias("id"), (n == 7).alias("is_reference"), (n % 7).alias("traps"), (n * 13 % 100 / 100).alias("mrr"), (n * 17 % 100 / 100).alias("recall_at_1"), (n * 29 % 100 / 100).alias("mrr_cross"), (n * 37 % 50 / 50).alias("mrr_group"),
        (n % 3).cast("double").alias("path"), (n % 5).cast("double").alias("name"), (n % 11).cast("double").alias("trail"), (n / 1e9 + n % 4).alias("name_weight"),
    )


_P = """points as (select p_partkey as id, p_partkey = 7 as is_reference, p_partkey % 7 as traps, (p_partkey * 13 % 100)::double / 100 as mrr, (p_partkey * 17 % 100)::double / 100 as recall_at_1, (p_partkey * 29 % 100)::double / 100 as mrr_cross, (p_partkey * 37 % 50)::double / 50 as mrr_group,
  p_partkey % 3 as path, p_partkey % 5 as name, p_partkey % 11 as trail, p_partkey::double / 1e9 + p_partkey % 4 as name_weight from part)"""


def best_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.best_point(_points(spark, sf_dir)).select("id", "mrr", "recall_at_1")


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    # ties beyond the weights are told apart by the trail, so that one point is left
    points = _points(spark, sf_dir).withColumn("trail", F.col("id") / 1000)
    return selection.staged_choice(points, least_traps=3, margin=0.1, trail_reference=0.05)


STAGED_SQL = f"""with {_P}, r as (select mrr as rm, mrr_cross as rc, mrr_group as rg from points where is_reference),
s as (select *, traps >= 3 as a, traps >= 3 and mrr >= rm as b, traps >= 3 and mrr >= rm and mrr_cross >= rc as c, traps >= 3 and mrr >= rm and mrr_cross >= rc and mrr_group > rg + 0.1::double as d from points, r where not is_reference)
select count(*) filter (a) as passed_traps, count(*) filter (b) as passed_mean, count(*) filter (c) as passed_cross, count(*) filter (d) as passed_group,
  (select id from s where d order by mrr_group desc, path, name, abs(id / 1000.0::double - 0.05::double) limit 1) as chosen from s"""


def shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier")
    return rows.select("s_suppkey", F.round(selection.shrunk(F.col("s_acctbal"), F.lit(100.0), F.col("s_suppkey") % 7, 5), 6).alias("value"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    return selection.session_report(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), F.when(F.col("o_custkey") % 10 > 0, n).alias("turn"), ((n % 3 == 0) & (F.col("o_custkey") % 10 > 0)).alias("followup"), ((n % 5 > 0) & (F.col("o_custkey") % 10 > 0)).alias("success")))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    calls = li.select(F.col("l_returnflag").alias("operation"), F.col("l_quantity").alias("total"), F.when(F.col("l_linenumber") > 1, F.col("l_quantity") / 2).alias("dense"), (F.col("l_discount") * 300).alias("lexical"))
    return selection.call_parts(calls, ("dense", "lexical")).select("operation", "n", *[F.round(c, 4).alias(c) for c in ("dense", "lexical", "rest")])


def work(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_type").alias("type"), F.col("p_size").cast("long").alias("size"))
    n = F.col("path").cast("long")
    return selection.work_map(p, p.filter(n % 4 > 0).select("path", F.when(n % 6 > 0, n % 5 == 0).alias("needs_work")))


# -- models ------------------------------------------------------------------------


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as a catalogue of models."""
    n = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat(_pick(n, 1, "org/m", "org/flux-", "org/m", "org/m"), n.cast("string"), _pick(n, 5, "", "", "", ":free", "")).alias("model_id"), F.col("p_name").alias("name"), _pick(n, 3, "acme", "acme", "ollama").alias("provider"), _pick(n, 7, "frontier", "local_zero_cost", "budget").alias("tier"),
        (F.round(F.col("p_retailprice")) * 0.0001).alias("cost"), (40 + n * 7919 % 600 / 10).alias("score"), (n % 150).cast("double").alias("speed"), (n * 1000 % 1_000_000).alias("context"), (n % 10 / 10).alias("latency"), _pick(n, 11, None, "text", "image", "text").alias("modality"),
    )


_M = f"""models as (select {_turn('p_partkey', 1, 'org/m', 'org/flux-', 'org/m', 'org/m')} || p_partkey || {_turn('p_partkey', 5, '', '', '', ':free', '')} as model_id, p_name as name, {_turn('p_partkey', 3, 'acme', 'acme', 'ollama')} as provider, {_turn('p_partkey', 7, 'frontier', 'local_zero_cost', 'budget')} as tier,
  round(p_retailprice) * 0.0001::double as cost, 40 + (p_partkey * 7919 % 600)::double / 10 as score, (p_partkey % 150)::double as speed, p_partkey * 1000 % 1000000 as context, (p_partkey % 10)::double / 10 as latency, {_turn('p_partkey', 11, None, 'text', 'image', 'text')} as modality from part),
judged as (select *, not (model_id like '%:free' or tier = 'local_zero_cost' or provider = 'ollama') and coalesce(modality, 'text') not in ('image', 'video') and not contains(model_id, 'flux') as ok,
  not (model_id like '%:free' or tier = 'local_zero_cost' or provider = 'ollama') and coalesce(modality, 'text') = 'image' as image_ok from models)"""


def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models(spark, sf_dir).select("model_id", model_choice.eligible().alias("text"), model_choice.eligible("image_gen").alias("image"))


def efforts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_extract("model_id", "([0-9]+)", 1).cast("long")
    cost, score = model_choice.at_effort(F.col("cost"), F.col("score"), _pick(n, 1, "LOW", "medium", "high", "max", "other", None))
    return models(spark, sf_dir).select("model_id", cost.alias("cost"), score.alias("score"))


EFFORTS_SQL = f"""with {_M}, e as (select *, regexp_extract(model_id, '([0-9]+)', 1)::bigint % 6 as e from models)
select model_id, round(cost * [0.6, 1.0, 1.8, 3.2, 1.0, 1.0][e + 1]::double, 6) as cost, least(100.0::double, round(score * [0.95, 1.0, 1.04, 1.07, 1.0, 1.0][e + 1]::double, 2)) as score from e"""


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    kind = model_choice.licence_kind(_pick(n, 1, " MIT ", "gpl-3.0", None, "Apache-2.0", "custom"))
    return table(spark, sf_dir, "part").select(n, kind.alias("licence"), model_choice.repository_score(n * 37 % 1500, kind, n % 2 == 0, n % 9 == 0).alias("score"))


REPOSITORIES_SQL = f"""with r as (select p_partkey, ['permissive', 'copyleft', 'unknown', 'permissive', 'unknown'][(p_partkey % 5 + 1)::int] as licence, p_partkey * 37 % 1500 as stars from part)
select p_partkey, licence, case when p_partkey % 9 = 0 then 0.2::double else round(least(1.0::double, 0.4::double + case when stars >= 1000 then 0.3::double when stars >= 200 then 0.2::double when stars >= 50 then 0.1::double else 0 end
  + case licence when 'permissive' then 0.2::double when 'copyleft' then 0.05::double else 0 end + case when p_partkey % 2 = 0 then 0.1::double else 0 end), 2) end as score from r"""


def proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = model_choice.frontier_proximity(models(spark, sf_dir))
    return got.select("model_id", "proximity", "near", "gap_score", "gap_cost", "opportunity")


_PROXIMITY = f"""{_M}, pool as (select * from judged where ok), b as (select min(ln(greatest(cost, 0.0001))) as c0, max(ln(greatest(cost, 0.0001))) as c1, min(score) as s0, max(score) as s1 from pool),
best as (select cost, max(score) as score from pool group by cost), line as (select cost, score from (select *, max(score) over (order by cost rows between unbounded preceding and 1 preceding) as before from best) where before is null or score > before),
scaled as (select cost, score, (ln(greatest(cost, 0.0001)) - c0) / (c1 - c0) as x, (score - s0) / (s1 - s0) as y from line, b),
pairs as (select cost as ac, score as as_, x as ax, y as ay, lead(cost) over w as bc, lead(score) over w as bs, lead(x) over w as bx, lead(y) over w as "by" from scaled window w as (order by cost)),
st as (select * from pairs where bc is not null), ends as (select min(cost) as lc, max(cost) as hc, min(score) as ls, max(score) as hs from line),
m as (select j.*, greatest(cost, 0.0001::double) as c, (ln(greatest(cost, 0.0001)) - c0) / (c1 - c0) as px, (score - s0) / (s1 - s0) as py, j.ok and exists (select 1 from pool p join line l on p.cost = l.cost and p.score = l.score where p.model_id = j.model_id and not exists (select 1 from pool q where q.cost = p.cost and q.score = p.score and q.model_id < p.model_id)) as front from judged j, b),
d as (select model_id, min(sqrt(pow(px - ax - t * (bx - ax), 2) + pow(py - ay - t * ("by" - ay), 2))) as dist from (select *, greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * ("by" - ay)) / (pow(bx - ax, 2) + pow("by" - ay, 2)))) as t from m, st) group by 1),
r as (select m.*, e.*, greatest(0, least(1, 1 - dist)) as fpi,
  case when c <= lc then ls when c >= hc then hs else (select as_ + (m.c - ac) / (bc - ac) * (bs - as_) from st where ac <= m.c and m.c <= bc order by ac limit 1) end as q,
  case when score <= ls then lc when score >= hs then hc else (select ac + (m.score - as_) / (bs - as_) * (bc - ac) from st where as_ <= m.score and m.score <= bs order by ac limit 1) end as tc from m join d using (model_id), ends e),
f as (select *, case when front then 1.0::double else round(fpi, 4) end as proximity from r),
measured as (select model_id, score, speed, ok, proximity, not front and fpi >= 0.95 as near, case when front then 0.0::double else greatest(0.0::double, round(q - score, 2)) end as gap_score, case when front then 0.0::double else greatest(0.0::double, round(c - tc, 6)) end as gap_cost,
  round((proximity * (1 + (case when speed >= 110 then 0.1::double when speed >= 80 then 0.05::double else 0.0::double end + case when context >= 500000 then 0.08::double else 0.0::double end + case when latency > 0 and latency <= 0.4 then 0.06::double else 0.0::double end)))::varchar::decimal(38, 20), 4)::double as opportunity from f)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_choice.critical_candidates(model_choice.frontier_proximity(models(spark, sf_dir).filter(model_choice.eligible())))


CANDIDATES_SQL = f"""with {_PROXIMITY}, ar as (select model_id from measured where ok order by score desc, model_id limit 1),
ch as (select model_id from measured where ok and model_id not in (select model_id from ar) order by score >= 88 desc, opportunity desc, model_id limit 1),
dr as (select model_id from measured where ok and model_id not in (select model_id from ar) and model_id not in (select model_id from ch) order by score >= 86 desc, speed desc, model_id limit 1)
select 'fast_drafter' as role, model_id from dr union all select 'balanced_challenger', model_id from ch union all select 'frontier_arbiter', model_id from ar"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    return model_choice.forgetful_profile(o.select(F.col("o_orderpriority").alias("type"), n.alias("at"), (F.col("o_totalprice") / 1000).alias("mb"), (n % 900).alias("tokens"), (n % 6).alias("chunks"), (n % 8 > 0).alias("ok")))


PROFILES_SQL = """with o as (select o_orderpriority as type, o_orderkey as place, o_totalprice / 1000 as mb, o_orderkey % 900 as tokens, o_orderkey % 6 as chunks, o_orderkey % 8 > 0 as ok from orders),
p as (select *, chunks > 0 and tokens > 0 and mb > 0 as paid from o), a as (select *, count(*) over w as age, count(*) filter (paid) over w as paid_age from p window w as (partition by type order by place rows between 1 following and unbounded following)),
s as (select type, count(*) as n, sum(case when paid then pow(0.995::double, paid_age) * tokens end) as t, sum(case when paid then pow(0.995::double, paid_age) * mb end) as m, sum(case when paid then pow(0.995::double, paid_age) * chunks end) as c, sum(case when ok then pow(0.995::double, age) else 0 end) as g, sum(pow(0.995::double, age)) as w from a group by 1)
select type, n, round(t / m, 6) as tokens_per_mb, round(t / c, 6) as tokens_per_chunk, round(g / w, 6) as ok_share from s"""


# -- cells and texts -----------------------------------------------------------------


def cell_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    n, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp_ntz") + F.expr("make_dt_interval(0, o_orderkey % 3, o_orderkey % 2 * 30)")
    return o.select(n, cells.cell_number(F.when(n % 4 > 0, F.round(F.col("o_totalprice") / (1 + n % 2 * 999), 1))).alias("number"), cells.cell_time(at).alias("time"), cells.spoken_duration((n * 977 % 500_000).cast("double")).alias("duration"))


CELLS_SQL = """select o_orderkey, case when o_orderkey % 4 = 0 then '' when v = floor(v) then v::bigint::varchar else v::varchar end as number,
  case when hour(t) = 0 and minute(t) = 0 then strftime(t, '%d/%m/%Y') else strftime(t, '%d/%m/%Y %H:%M') end as time,
  case when s < 60 then 'um instante' when s // 60 < 60 then (s // 60) || ' min' when s // 3600 < 24 then (s // 3600) || ' h' || case when s // 60 % 60 > 0 then ' ' || (s // 60 % 60) || ' min' else '' end
    else (s // 86400) || ' d' || case when s // 3600 % 24 > 0 then ' ' || (s // 3600 % 24) || ' h' else '' end end as duration
from (select o_orderkey, round(o_totalprice / (1 + o_orderkey % 2 * 999), 1) as v, o_orderdate + to_hours((o_orderkey % 3)::int) + to_minutes((o_orderkey % 2 * 30)::int) as t, o_orderkey * 977 % 500000 as s from orders)"""


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as sheets, one per part of a supplier: is a column a measure, is the sheet a dump, and the digest of its distinct values."""
    li = table(spark, sf_dir, "lineitem")
    value = F.when(F.col("l_linenumber") > 2, F.regexp_replace(F.format_string("%.2f", "l_extendedprice"), r"\.", ",")).otherwise(F.col("l_partkey").cast("string"))
    rows = li.groupBy((F.col("l_suppkey") % 50).alias("sheet")).agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", value.alias("v"))))["v"].alias("values"))
    pieces = cells.digest_pieces(F.col("values"), 300)
    return rows.select("sheet", cells.is_measure(F.col("values")).alias("measure"), cells.is_data_dump(F.size("values"), F.lit(50)).alias("dump"), F.size(pieces).cast("long").alias("pieces"), F.md5(F.array_join(pieces, "|").cast("binary")).alias("digest"))


COLUMNS_SQL = r"""with recursive v as (select l_suppkey % 50 as sheet, l_orderkey as o, l_linenumber as l, case when l_linenumber > 2 then replace(printf('%.2f', l_extendedprice), '.', ',') else l_partkey::varchar end as v from lineitem),
r as (select *, row_number() over (partition by sheet order by o, l, v) as rn from v),
s as (select sheet, count(*) as n, count(*) filter (rn <= 200 and regexp_matches(v, '^-?\d{1,3}(?:\.\d{3})*,\d+$|^-?\d+[.,]\d+$'))::double / least(count(*), 200) > 0.3 as measure from r group by 1),
u as (select sheet, v, row_number() over (partition by sheet order by min(rn)) as k from r group by sheet, v),
w as (select sheet, k, v, 1 as piece, length(v) as size from u where k = 1
  union all select u.sheet, u.k, u.v, case when w.size + length(u.v) > 300 then w.piece + 1 else w.piece end, case when w.size + length(u.v) > 300 then length(u.v) else w.size + length(u.v) end from w join u on u.sheet = w.sheet and u.k = w.k + 1 where u.k <= 8000),
p as (select sheet, piece, string_agg(v, '; ' order by k) as t from w group by all)
select s.sheet, measure, n * 40 > 20000 as dump, count(*) as pieces, md5(string_agg(t, '|' order by piece)) as digest from s join p using (sheet) group by s.sheet, measure, n"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical texts cut at their spans again: blocks are the words, some spans are made wrong."""
    q = table(spark, sf_dir, "benchmark")
    n = F.col("item_id")
    words = F.split("text", " ")
    start = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("done"), F.lit(0).alias("at"))
    made = F.aggregate(words, start, lambda s, w: F.struct(F.concat(s["done"], F.array(F.struct(s["at"].alias("start"), (s["at"] + F.length(w)).alias("end")))).alias("done"), (s["at"] + F.length(w) + 1).alias("at")), lambda s: s["done"])
    wrong = F.when(n % 4 == 1, F.reverse(made)).when(n % 4 == 2, F.transform(made, lambda x: F.struct(x["start"].alias("start"), (x["end"] + 1000).alias("end")))).otherwise(made)
    return q.select(n, cells.spans_valid(wrong, F.length("text")).alias("valid"), (F.array_join(cells.spans_texts(F.col("text"), made), " ") == F.col("text")).alias("whole"), F.size(made).cast("long").alias("blocks"))


GLOSSARY = {"ia": ("inteligência artificial", "the of"), "und": ("und der", "ISO 42001"), "X": ("the",)}


def expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark")
    text = F.concat(F.when(F.col("item_id") % 3 == 0, "Inteligencia ARTIFICIAL ").when(F.col("item_id") % 3 == 1, "IA ").otherwise("X und, "), F.col("text"))
    return rows.select("item_id", glossary.expand(text, GLOSSARY).alias("query"))


_HAS = "contains(' ' || array_to_string(w, ' ') || ' ', ' {0} ')"
EXPANDED_SQL = f"""with q as (select item_id, case item_id % 3 when 0 then 'Inteligencia ARTIFICIAL ' when 1 then 'IA ' else 'X und, ' end || text as t from benchmark), w as (select *, {TOKENS.format('t')} as w from q),
a as (select item_id, t, list_slice(list_distinct_ordered, 1, 8) as added from (select *, list_filter(c, lambda x: x is not null) as kept, list_filter(list_transform(c, lambda x, i: case when x is not null and list_position(c, x) = i then x end), lambda x: x is not null) as list_distinct_ordered from (select *, [
  case when {_HAS.format('ia')} and not {_HAS.format('inteligencia artificial')} then 'inteligência artificial' end, case when {_HAS.format('ia')} and not {_HAS.format('the of')} then 'the of' end,
  case when {_HAS.format('und')} and not {_HAS.format('und der')} then 'und der' end, case when {_HAS.format('und')} and not {_HAS.format('iso 42001')} then 'ISO 42001' end,
  case when {_HAS.format('x')} and not {_HAS.format('the')} then 'the' end,
  case when {_HAS.format('inteligencia artificial')} and not list_contains(w, 'ia') then 'ia' end, case when {_HAS.format('the of')} and not list_contains(w, 'ia') then 'ia' end,
  case when {_HAS.format('und der')} and not list_contains(w, 'und') then 'und' end, case when {_HAS.format('iso 42001')} and not list_contains(w, 'und') then 'und' end, case when {_HAS.format('the')} and not list_contains(w, 'x') then 'X' end] as c from w)))
select item_id, case when len(added) > 0 then t || ' ' || array_to_string(added, ' ') else t end as query from a"""

QUERIES = {
    "question_groups": (groups, f'with {_S}, {_GROUPS} select * from g'),
    "language_slices": (slices, f"with {_Q}, {_S}, {_SETS} select q.query_id, m.source_language, {_SLICE} as slice from q join m using (query_id)"),
    "metrics_by_group": (by_group, f"with {_JUDGED}, v as (select unnest(['email', 'reuniao', 'escritorio', 'misto', 'outro']) as \"group\"), a as (select \"group\", {_MEANS} from j group by 1) select v.\"group\", coalesce(n, 0) as n, recall_at_1, reciprocal_rank from v left join a using (\"group\")"),
    "metrics_by_group_and_slice": (by_group_and_slice, f"with {_JUDGED}, v as (select distinct \"group\", s.slice from j, (select unnest(['mesma-língua', 'cross-lingual', 'não declarado', 'outra']) as slice) s), a as (select \"group\", slice, {_MEANS} from j group by all) select v.\"group\", v.slice, coalesce(n, 0) as n, recall_at_1, reciprocal_rank from v left join a using (\"group\", slice)"),
    "language_differences": (language_check, f"with {_Q}, {_S}, {_SETS}, r as (select q.query_id, annotated, coalesce(source_language, 'indefinido') as language from q left join m using (query_id)) select * from (select query_id, case when annotated = '' and language not in {_UNDECIDED} then 'sem_anotacao' when annotated <> '' and annotated <> language then 'divergente' end as kind, annotated, language from r) where kind is not null"),
    "unexercised_slices": (unexercised, "with b as (select l_orderkey as q, list(l_partkey order by l_linenumber, l_partkey) as items from lineitem group by 1), a as (select l_orderkey as q, list(l_partkey + case when l_orderkey % 5 = 1 and l_orderkey % 64 < 9 then 1 else 0 end order by l_linenumber, l_partkey) as items from lineitem where l_orderkey % 9 > 0 group by 1) select q % 5 as slice, count(*) as common, bool_and(a.items = b.items) as untouched from a join b using (q) group by 1"),
    "coverage_by_folder": (folders, f"with {_S}, {_U}, {_FOLDERS} select * from c"),
    "coverage": (covered, f"with {_S}, {_U}, {_FOLDERS}, t as (select sum(documents)::bigint as documents, coalesce(sum(documents) filter (sources > 0), 0)::bigint as covered from c), k as (select count(*) as sources, count(*) filter (path in (select path from u)) as inside from d) select documents, covered, round(covered / documents, 6) as reach, sources, inside, sources - inside as outside, round(inside / documents, 6) as fraction from t, k"),
    "scope_findings": (scope, f"with {_Q}, {_S}, {_U}, p as (select query_id, count(distinct path) as sources, count(distinct path) filter (path in (select path from u)) as present from s group by 1), r as (select query_id, mode, in_scope, coalesce(sources, 0) as sources, coalesce(present, 0) as present from q left join p using (query_id)) select * from (select query_id, case when in_scope and not (case when mode = 'todas' then present = sources else present > 0 end) then 'silenciosa' when not in_scope and present = sources then 'anotacao_velha' end as kind, sources - present as missing, sources from r) where kind is not null"),
    "vector_agreement": (agreement, AGREEMENT_SQL),
    "gate_violations": (gates, "with s as (select c_nationkey::varchar as operation, max(c_acctbal) as p95 from customer group by 1) select operation, kind, p95, bound from s join nation on operation = n_nationkey::varchar, (values ('produto', 9000.0::double), ('regressao', 9900.0::double)) g(kind, bound) where p95 > bound"),
    "ann_choice": (ann_choice, "select s_suppkey as nprobes, (s_suppkey % 10)::double / 10 as recall, round(s_acctbal, 0) as p95 from supplier where (s_suppkey % 10)::double / 10 >= 0.3 order by p95, nprobes limit 1"),
    "arm_contrast": (arms, f"with {_ARMS} {_arms_sql('whole', chr(119) + 'here arm <> ' + repr('raro'))} union all {_arms_sql('thin', '')}"),
    "best_point": (best_point, f"with {_P} select id, mrr, recall_at_1 from points where traps >= 4 order by mrr desc, recall_at_1 desc, name_weight limit 1"),
    "staged_choice": (staged, STAGED_SQL),
    "shrunk_values": (shrunk, "select s_suppkey, round(case when n > 0 then n / (n + 5.0::double) * s_acctbal + (1 - n / (n + 5.0::double)) * 100 else 100 end, 6) as value from (select *, s_suppkey % 7 as n from supplier)"),
    "session_report": (report, "with t as (select o_custkey as session, o_custkey % 10 > 0 as real, o_orderkey % 3 = 0 as f, o_orderkey % 5 > 0 as s from orders) select session, count(*) filter (real) as turns, count(*) filter (real and f) as followups, case when count(*) filter (real) > 0 then round(count(*) filter (real and s and not f) * 100 / count(*) filter (real)::double, 1) else 100.0::double end as one_shot_pct from t group by 1"),
    "call_parts": (parts, "with c as (select l_returnflag as operation, l_quantity as total, coalesce(case when l_linenumber > 1 then l_quantity / 2 end, 0) as dense, l_discount * 300 as lexical from lineitem) select operation, count(*) as n, round(avg(dense), 4) as dense, round(avg(lexical), 4) as lexical, round(avg(greatest(0, total - dense - lexical)), 4) as rest from c group by 1"),
    "work_map": (work, "with f as (select p_type as type, p_size as size, p_partkey % 4 > 0 and p_partkey % 6 > 0 and p_partkey % 5 > 0 as done from part) select type, count(*) as files, sum(size)::bigint as bytes, count(*) filter (done) as done, count(*) filter (not done) as remaining, coalesce(sum(size) filter (not done), 0)::bigint as remaining_bytes from f group by 1"),
    "model_eligibility": (eligible, f"with {_M} select model_id, ok as text, image_ok as image from judged"),
    "model_efforts": (efforts, EFFORTS_SQL),
    "repository_scores": (repositories, REPOSITORIES_SQL),
    "frontier_proximity": (proximity, f"with {_PROXIMITY} select model_id, proximity, near, gap_score, gap_cost, opportunity from measured"),
    "critical_candidates": (candidates, CANDIDATES_SQL),
    "format_profiles": (profiles, PROFILES_SQL),
    "cell_texts": (cell_texts, CELLS_SQL),
    "sheet_columns": (columns, COLUMNS_SQL),
    "canonical_blocks": (spans, "select item_id, item_id % 4 = 1 and len(string_split(text, ' ')) = 1 or item_id % 4 in (0, 3) as valid, true as whole, len(string_split(text, ' ')) as blocks from benchmark"),
    "glossary_expansion": (expanded, EXPANDED_SQL),
}
