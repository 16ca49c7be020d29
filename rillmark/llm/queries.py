"""Registered queries of this subpackage and their SQL.

Every query runs its operator over the whole of its table and derives the
digest columns that are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.corpus import table
from . import bpe, embedding_dedup, forest, lm_score, mixing, sharding, simhash, substring, toxicity, warc
from .storage import new_path

RANKS_FILE = "byte_bpe_multi_50k.tiktoken"


def vocabulary() -> tuple[str, str]:
    """Path and pattern of the public vocabulary that op2 names."""
    import public_tokenizers

    return public_tokenizers.path(RANKS_FILE), public_tokenizers.PATTERN


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(bpe.encode_decode(table(spark, sf_dir, "documents"), *vocabulary()), "doc_id")


def op3_lm_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against those that are labelled as good."""
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    return lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


SHARDS = 24


def op5_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), shards=SHARDS)
    return placed.select(
        "doc_id", "size", F.col("text_crc32"), F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )


TOXIC_FROM = 0.3


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op7_substring_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring.deduplicate(table(spark, sf_dir, "documents"), window=20)
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op8_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.curriculum(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).alias("taken"),
        *[F.get(c, F.lit(k)).alias(f"{n}_{k + 1}") for c, n in (("__positions", "position"), ("__ranks", "rank")) for k in range(2)],
    )


def op9_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path, least_bytes=0)
    return warc.read_archive(spark, path).filter("payload is not null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_dedup": op1_embedding_dedup,
        "op2_bpe": op2_bpe,
        "op3_lm_difference": op3_lm_difference,
        "op4_simhash": op4_simhash,
        "op5_jump_sharding": op5_jump_sharding,
        "op6_toxicity": op6_toxicity,
        "op7_substring_index": op7_substring_index,
        "op8_curriculum": op8_curriculum,
        "op9_hash_forest": op9_hash_forest,
        "op10_warc": op10_warc,
    }


_BUCKET = "(('0x' || substr(md5(coalesce(doc_id::varchar, '')), 17, 8))::bigint % 4096)"
_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


# CRC-32 (reflected polynomial 0xEDB88320) of the sixteen half bytes.
_CRC_HALF_BYTES = (
    "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,"
    " 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
)
_CRC_STEP = "xor({0} >> 4, " + _CRC_HALF_BYTES + "[(({0}) & 15) + 1])"


def oracle_sql() -> dict[str, str]:
    return {
        "op5_jump_sharding": f"""
with recursive base as (
  select doc_id, strlen(coalesce(text, '')) + 8 as size, coalesce(text, '') as text, row_number() over () as r,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 16))::ubigint::uhugeint as key0, {_BUCKET} as bucket
  from documents),
jump as (
  select r, key0 as key, 0::bigint as j, 0::bigint as shard, 0::bigint as grown from base
  union all
  select r, k, floor((j + 1)::double * (2147483648::double / ((k >> 33) + 1)::double))::bigint,
         case when j < {SHARDS} then j else shard end, j
  from (select *, ((key * 2862933555777941757::uhugeint + 1::uhugeint) % 18446744073709551616::uhugeint)::uhugeint as k from jump)
  where j < {SHARDS + 1}),
ended as (select r, max(shard) as shard, max(grown) as grown from jump group by r),
crc as (
  select r, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::bigint), lambda c, b:
      {_CRC_STEP.format(_CRC_STEP.format('xor(c, b)'))}, 4294967295), 4294967295)::bigint as text_crc32
  from base)
select b.doc_id, b.size::bigint as size, c.text_crc32, 'key' as law, e.shard::int as shard,
       (row_number() over (partition by e.shard order by b.bucket, b.doc_id) - 1)::bigint as slot, e.grown::int as grown_shard
from base b join ended e using (r) join crc c using (r)
""",
        "op8_curriculum": f"""
with sized as (select doc_id, source, {_WORDS}::bigint as size,
    (('0x' || substr(md5(coalesce(doc_id::varchar, '')), 17, 8))::bigint % 4096) as bucket from documents),
sources as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (select *, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight from sources),
bounded as (select *, 2.0::double * source_size as bound from weighed),
spare as (select *, 1.5::double * sum(source_size) over () as total,
    coalesce(sum(bound) over (order by bound / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as bound_before,
    sum(weight) over (order by bound / weight, source nulls last rows between current row and unbounded following) as weight_from from bounded),
leveled as (select *, (total - bound_before) / weight_from::double as level from spare),
targets as (select source, source_size, least(bound, coalesce(weight * max(case when weight * level <= bound then level end) over (), bound))::double as target,
    row_number() over (order by source nulls last) as number from leveled),
placed as (select doc_id, number, size, source_size, target, row_number() over () as r, [1.5, 0.5, 1.0][((number - 1) % 3 + 1)::int]::double as a, [0.5, 1.5, 1.0][((number - 1) % 3 + 1)::int]::double as b,
    coalesce(sum(size) over (partition by s.source order by bucket, doc_id::varchar rows between unbounded preceding and 1 preceding), 0)::bigint as before
    from sized s join targets t on s.source is not distinct from t.source),
copies as (select *, (before + k * source_size)::double + size::double / 2.0::double as middle from placed, (values (0), (1)) copy(k)
    where size > 0 and (before + k * source_size)::double + size::double / 2.0::double <= target),
parted as (select *, (middle / target) * (a + b) / 2.0::double as area from copies),
timed as (select *, 2.0::double * area / (a + sqrt(greatest(a * a + 2.0::double * (b - a) * area, 0.0::double))) as position from parted),
ranked as (select *, row_number() over (order by position, number, middle) - 1 as rank from timed)
select p.doc_id, p.size, p.source_size, p.target, p.size * count(t.r) as taken,
    max(case when k = 0 then position end) as position_1, max(case when k = 1 then position end) as position_2,
    max(case when k = 0 then rank end) as rank_1, max(case when k = 1 then rank end) as rank_2
from placed p left join ranked t using (r) group by p.r, p.doc_id, p.size, p.source_size, p.target
""",
        "op10_warc": """
with sized as (select page_id, coalesce(html, '') as html from pages),
digests as (select page_id, strlen(html)::bigint as payload_bytes, html, sha1(html) as hex, max(page_id) over (partition by html) as owner from sized),
coded as (select page_id, payload_bytes, owner, list_reduce(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (i // 4 * 5 + 1)::int, 5))::bigint >> (15 - (i % 4) * 5)::int) & 31)::int + 1, 1)), lambda a, b: a || b) as payload_digest from digests)
select page_id, payload_bytes, payload_digest, case when page_id = owner then 'response' else 'revisit' end as record_type,
       case when page_id = owner then null else owner end as refers_to
from coded
""",
    }
