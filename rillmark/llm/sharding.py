"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in DataFrame functions only.

A key's shard depends on the key and the number of shards alone.  Going from n
to n + 1 shards moves rows only into the new shard, 1 / (n + 1) of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import md5_part, running_before

#: Multiplier of the paper's 64-bit linear congruential generator (a fixed value).
MULTIPLIER = 2862933555777941757
_LOW = 0xFFFFFFFF


def _half_product(x: Column, factor: int) -> Column:
    """x * factor modulo 2**32 for 32-bit numbers, never over 63 bits."""
    return (x * (factor & 0xFFFF) + F.shiftleft((x * (factor >> 16)).bitwiseAND(0xFFFF), 16)).bitwiseAND(_LOW)


def _next_key(hi: Column, lo: Column) -> tuple[Column, Column]:
    """Halves of key * MULTIPLIER + 1 modulo 2**64, in 32-bit limbs so that ANSI mode sees no overflow."""
    m_hi, m_lo = MULTIPLIER >> 32, MULTIPLIER & _LOW
    upper = lo * (m_lo >> 16)
    low_sum = lo * (m_lo & 0xFFFF) + F.shiftleft(upper.bitwiseAND(0xFFFF), 16) + 1
    carry = F.shiftright(low_sum, 32) + F.shiftright(upper, 16)
    return (carry + _half_product(hi, m_lo) + _half_product(lo, m_hi)).bitwiseAND(_LOW), low_sum.bitwiseAND(_LOW)


def jump_hash(hi: Column, lo: Column, shards: list[int]) -> list[Column]:
    """Shard of the 64-bit key (two unsigned halves as BIGINT) for each of several shard counts."""
    most = max(shards)

    def step(state: Column, _: Column) -> Column:
        # b: the shard reached, j: where the key jumps next
        new_hi, new_lo = _next_key(state["hi"], state["lo"])
        live = state["j"] < most
        b = F.when(live, state["j"]).otherwise(state["b"])
        target = (b + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(new_hi, 1) + 1).cast("double"))
        j = F.when(live, F.floor(target)).otherwise(state["j"])
        reached = [F.when(live & (state["j"] < n), state["j"]).otherwise(state[f"s{i}"]).alias(f"s{i}") for i, n in enumerate(shards)]
        return F.struct(new_hi.alias("hi"), new_lo.alias("lo"), b.alias("b"), j.alias("j"), *reached)

    zero = F.lit(0).cast("long")
    start = F.struct(hi.alias("hi"), lo.alias("lo"), zero.alias("b"), zero.alias("j"), *[zero.alias(f"s{i}") for i in range(len(shards))])
    end = F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)
    return [end[f"s{i}"].cast("int") for i in range(len(shards))]


def assign_shards(docs: DataFrame, *, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard of every row, its slot there and its shard once one shard is appended.

    Returns ``id_col``, ``size`` (UTF-8 bytes of the text, none if null, plus
    8), ``text_crc32``, ``shard``, ``grown_shard`` and ``slot``, which numbers a
    shard's rows from 0 without gaps.  A null id is a key like any other (the
    empty one); rows that repeat an id share its shard and get slots of their
    own; a null text counts as empty.  Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    now, grown = jump_hash(md5_part(id_col, 1, 8), md5_part(id_col, 9, 8), [shards, shards + 1])
    placed = slim.withColumn("shard", now).withColumn("grown_shard", grown)
    return running_before(placed, "shard", [id_col, "size", "text_crc32"], F.lit(1).cast("long"), "slot", id_col)
