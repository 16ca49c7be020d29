"""Queries of the analytic operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics
from .corpus import PATHS, paths, table


def skyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("cost"), F.col("p_size").alias("score"))
    return analytics.skyline(rows, "cost", "score").select("id", "cost", "score")


def skyline_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.monotonically_increasing_id().alias("id"), "l_quantity", "l_extendedprice")
    return analytics.skyline(rows, "l_extendedprice", "l_quantity", by=["l_returnflag"]).select("l_returnflag", "l_extendedprice", "l_quantity")


SKYLINE_SQL = """with b as (select * from (select p_partkey as id, p_retailprice as cost, p_size as score, row_number() over (partition by p_retailprice order by p_size desc, p_partkey) as rn from part) where rn = 1),
m as (select *, max(score) over (order by cost rows between unbounded preceding and 1 preceding) as before from b) select id, cost, score from m where before is null or score > before"""
SKYLINE_GROUP_SQL = """with b as (select l_returnflag, l_extendedprice, max(l_quantity) as l_quantity from lineitem group by all),
m as (select *, max(l_quantity) over (partition by l_returnflag order by l_extendedprice rows between unbounded preceding and 1 preceding) as before from b) select l_returnflag, l_extendedprice, l_quantity from m where before is null or l_quantity > before"""


def stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.stratified(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 100)


STRATIFIED_SQL = """with c as (select c_custkey, c_mktsegment, count(*) over (partition by c_mktsegment) as n, row_number() over (partition by c_mktsegment order by c_custkey) as rn, count(*) over () as total from customer),
q as (select *, greatest(1, round(100.0::double * n / total))::bigint as quota from c), s as (select *, greatest(1, n // quota) as step from q)
select c_custkey, c_mktsegment from s where (rn - 1) % step = 0 and (rn - 1) // step < quota"""


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = paths(spark, sf_dir)
    wave = F.when(F.col("size") < 1000, 1).when(F.col("size") < 5000, 2).when(F.col("size") < 20000, 3).otherwise(4)
    got = analytics.indexing_queue(files.select("path", "size", "mtime", F.concat_ws("/", "source", "lang").alias("folder"), wave.alias("wave")))
    return got.select("path", "wave", "folder_score", F.col("position").cast("long").alias("position"))


QUEUE_SQL = f"""with {PATHS}, f as (select path, size, mtime, source || '/' || lang as folder, case when size < 1000 then 1 when size < 5000 then 2 when size < 20000 then 3 else 4 end as wave from paths),
s as (select *, round(count(*) over w / (1 + ln(1 + (sum(size) over w)::double)), 6) as folder_score from f window w as (partition by wave, folder))
select path, wave, folder_score, row_number() over (order by wave, folder_score desc, size, mtime desc, path) as position from s"""


def forgetful(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.forgetful_means(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), "event_type", "event_id", "value")


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    rows = p.select(n.alias("id"), F.when(n % 2 == 0, F.upper("p_brand")).otherwise(F.lower("p_brand")).alias("rule"), (n % 5).alias("used"), (n % 10 / 10.0).alias("confidence"), F.concat(F.lit("c"), (n % 7).cast("string")).alias("context"))
    return analytics.merge_rules(rows)


RULES_SQL = """select regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') as key, arg_min(case when p_partkey % 2 = 0 then upper(p_brand) else lower(p_brand) end, p_partkey) as rule, sum(p_partkey % 5)::bigint as used,
max(p_partkey % 10 / 10.0::double) as confidence, string_agg('c' || (p_partkey % 7), ' | ' order by p_partkey) as contexts, count(*) - 1 as inactive from part group by 1"""


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of a task and score per cost, from prices per million and numbers of tokens."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_partkey")
    cost = F.round(F.col("l_partkey") / 1e6 * F.col("l_quantity") + F.col("l_orderkey") / 1e6 * F.col("l_linenumber"), 6)
    return l.select("l_orderkey", "l_linenumber", cost.alias("cost"), F.round(F.least(F.col("l_quantity") * 2, F.lit(100.0)) / F.greatest(cost, F.lit(0.001)), 2).alias("efficiency")).groupBy("l_linenumber").agg(
        F.count("*").alias("n"), F.round(F.sum("cost"), 3).alias("cost"), F.round(F.max("efficiency"), 2).alias("best")
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings of event kinds: every hour's most frequent kind wins over the others."""
    hours = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp").cast("long").alias("hour"), "event_type").agg(F.count("*").alias("n"))
    races = hours.groupBy("hour").agg(F.max_by("event_type", F.struct("n", "event_type")).alias("winner"), F.sort_array(F.collect_set("event_type")).alias("losers"))
    return analytics.elo(races.withColumn("ladder", F.lit("events")), by="ladder", order="hour", winner="winner", losers="losers")


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"), "l_quantity", "l_extendedprice")
    return analytics.least_squares(rows, by="l_returnflag", order="n", x="l_quantity", y="l_extendedprice")


def remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") / 10.0).alias("expected"), (F.col("p_size") % 5 / 10.0).alias("spread"))
    return analytics.remaining_time(rows, by="p_brand", expected="expected", spread="spread")


QUERIES = {
    "skyline": (skyline, SKYLINE_SQL),
    "skyline_by_group": (skyline_by_group, SKYLINE_GROUP_SQL),
    "stratified_sample": (stratified, STRATIFIED_SQL),
    "indexing_queue": (queue, QUEUE_SQL),
    "forgetful_means": (forgetful, "with r as (select event_type, value, power(0.995::double, row_number() over (partition by event_type order by event_id desc) - 1) as w from events) select event_type, round(sum(w * value) / sum(w), 6) as mean, round(sum(w), 6) as weight from r group by event_type"),
    "merged_rules": (rules, RULES_SQL),
    "task_costs": (costs, "with c as (select l_linenumber, l_quantity, round(l_partkey / 1e6::double * l_quantity + l_orderkey / 1e6::double * l_linenumber, 6) as cost from lineitem) select l_linenumber, count(*) as n, round(sum(cost), 3) as cost, round(max(round(least(l_quantity * 2, 100.0::double) / greatest(cost, 0.001::double), 2)), 2) as best from c group by 1"),
    "elo_ratings": (ratings, None),
    "calibration": (calibration, None),
    "remaining_time": (remaining, None),
}
