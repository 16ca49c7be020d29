"""Queries of the maintenance operators, over two states of the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics, maintenance
from .corpus import table


def _state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Registered files, and files that a later pass saw: some gone, some moved, some new, some changed."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"), "o_custkey")
    n = F.col("n")
    path = F.concat(F.lit("dir"), (n % 50).cast("string"), F.lit("/f"), n.cast("string"))
    old = o.filter("n % 10 <> 9").select(path.alias("path"), F.md5(n.cast("string").cast("binary")).alias("sha"))
    moved = F.when(n % 13 == 0, F.concat(F.lit("moved/f"), n.cast("string"))).otherwise(path)
    seen = o.filter("n % 7 <> 0").select(moved.alias("path"), F.md5(F.when(n % 11 == 0, n + 1).otherwise(n).cast("string").cast("binary")).alias("sha"))
    return old, seen


_STATE = """old as (select 'dir' || (o_orderkey % 50) || '/f' || o_orderkey as path, md5(o_orderkey::varchar) as sha from orders where o_orderkey % 10 <> 9),
seen as (select case when o_orderkey % 13 = 0 then 'moved/f' || o_orderkey else 'dir' || (o_orderkey % 50) || '/f' || o_orderkey end as path,
  md5((case when o_orderkey % 11 = 0 then o_orderkey + 1 else o_orderkey end)::varchar) as sha from orders where o_orderkey % 7 <> 0)"""


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, seen = _state(spark, sf_dir)
    return maintenance.upsert(old, seen, ["path"])


def forget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.forget(*_state(spark, sf_dir), ["path"])


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.reconcile(*_state(spark, sf_dir))


RECONCILE_SQL = f"""with {_STATE}, missing as (select * from old where path not in (select path from seen)),
fresh as (select sha, min(path) as target from seen where path not in (select path from old) group by sha)
select path, case when target is null then 'removed' else 'moved' end as state, target from missing left join fresh using (sha)"""


def both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.difference(*_state(spark, sf_dir))


def frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.frozen(*_state(spark, sf_dir), "path", ["sha"])


def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    n = F.col("id")
    registered = o.filter("id % 10 <> 9").select("id", F.when(n % 6 > 0, F.concat(F.lit("m"), (n % 2).cast("string"))).alias("model"))
    copies = F.when(n % 17 == 0, 2).when(n % 5 == 0, 0).otherwise(1)
    vectors = o.withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(2)))).filter(F.col("c") <= copies).select("id", F.concat(F.lit("m"), (n % 2 * (n % 19).cast("boolean").cast("int")).cast("string")).alias("model"))
    return maintenance.integrity(registered, vectors)


INTEGRITY_SQL = """with reg as (select o_orderkey as id, case when o_orderkey % 6 > 0 then 'm' || (o_orderkey % 2) end as model from orders where o_orderkey % 10 <> 9),
vec as (select o_orderkey as id, 'm' || (o_orderkey % 2 * (o_orderkey % 19 > 0)::int) as model, unnest(range(0, case when o_orderkey % 17 = 0 then 2 when o_orderkey % 5 = 0 then 0 else 1 end)) from orders),
st as (select id, count(*) as copies, max(model) as stored from vec group by id),
j as (select r.id as rid, r.model, s.copies, s.stored from reg r full join st s on r.id = s.id)
select case when rid is null then 'orphan' when copies is null and model is null then 'draft' when copies is null then 'missing' when copies > 1 then 'duplicate' when model is distinct from stored then 'other model' else 'ok' end as finding, count(*) as n from j group by 1"""


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"))
    n, text = F.col("n"), F.col("n").cast("string")
    old = o.filter("n % 3 = 0").select(text.alias("path"), F.md5(text.cast("binary")).alias("hash"), (n % 2 + 1).alias("attempts"), (n * 10).alias("next_try"))
    failed = o.filter("n % 4 = 0").select(text.alias("path"), F.md5(F.when(n % 5 == 0, n + 1).otherwise(n).cast("string").cast("binary")).alias("hash"))
    return maintenance.quarantine(old, failed, 1_700_000_000)


QUARANTINE_SQL = """with old as (select o_orderkey::varchar as path, md5(o_orderkey::varchar) as hash, o_orderkey % 2 + 1 as attempts, o_orderkey * 10 as next_try from orders where o_orderkey % 3 = 0),
fail as (select o_orderkey::varchar as path, md5((case when o_orderkey % 5 = 0 then o_orderkey + 1 else o_orderkey end)::varchar) as hash from orders where o_orderkey % 4 = 0),
j as (select coalesce(o.path, f.path) as path, coalesce(f.hash, o.hash) as hash, f.hash is not null as failed, o.next_try, case when f.hash is null then o.attempts when f.hash = o.hash then o.attempts + 1 else 1 end as attempts from old o full join fail f on o.path = f.path)
select path, hash, attempts::bigint as attempts, (case when failed then 1700000000 + case when attempts >= 2 then 36500 * 86400::bigint else 3600 * power(2, attempts - 1) end else next_try end)::bigint as next_try from j"""


def pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.prune_latest(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id", 500)


def collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 3).cast("string").alias("root"), F.concat(F.lit("p"), F.col("l_orderkey").cast("string")).alias("path"))
    return maintenance.collisions(o)


def same_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of equal content and the one that stands for them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return docs.groupBy("sha").agg(F.min("doc_id").alias("kept"), F.count("*").alias("copies")).filter("copies > 1")


def debounced(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return analytics.debounce(events, key="user_id", at="ts", action="event_id", quiet_s=3600.0).select("event_id", "user_id", "event_type")


QUERIES = {
    "upsert": (upsert, f"with {_STATE} select * from seen union all select * from old where path not in (select path from seen)"),
    "forget_documents": (forget, f"with {_STATE} select * from old where path not in (select path from seen)"),
    "reconcile": (reconcile, RECONCILE_SQL),
    "multiset_difference": (both_ways, f"with {_STATE}, l as (select * from old except all select * from seen), r as (select * from seen except all select * from old) select 'left' as side, count(*) as n from l having count(*) > 0 union all select 'right', count(*) from r having count(*) > 0"),
    "frozen_fingerprints": (frozen, f"with {_STATE} select coalesce(o.path, s.path) as path, case when s.path is null then 'removed' when o.path is null then 'added' else 'changed' end as change from old o full join seen s on o.path = s.path where o.sha is distinct from s.sha"),
    "index_integrity": (integrity, INTEGRITY_SQL),
    "quarantine": (quarantine, QUARANTINE_SQL),
    "prune_measurements": (pruned, "select event_id, event_type from (select *, row_number() over (partition by event_type order by event_id desc) as rn from events) where rn <= 500"),
    "path_collisions": (collisions, "select 'p' || l_orderkey as path, count(distinct l_suppkey % 3) as roots from lineitem group by 1 having count(distinct l_suppkey % 3) > 1"),
    "same_content": (same_content, "select sha256(text) as sha, min(doc_id) as kept, count(*) as copies from documents group by 1 having count(*) > 1"),
    "debounced_changes": (debounced, "select event_id, user_id, event_type from (select *, lead(ts) over (partition by user_id order by ts, event_id) as nx from events) where nx is null or epoch_us(nx) - epoch_us(ts) >= 3600000000"),
}
