"""Sharding by jump consistent hashing, in DataFrame functions only.

The jump hash walks a key's own random sequence: from shard b it draws the next shard j > b at which
the key would move if shards were appended one by one, and stops at the first j beyond the shard count.
No ring table is kept, and one more shard takes rows only into itself: the key moves exactly if that
first j equals the old count.

The sequence is a 64-bit linear congruential generator. Spark's long product raises on overflow in ANSI
mode, so the state is held as two 32-bit halves and multiplied by 16-bit limbs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.llm.common import table

# The multiplier of the jump hash's generator, in two halves; its draws are the top 31 bits.
MULTIPLIER_HIGH = 0x27BB2EE6
MULTIPLIER_LOW = 0x87B0B0FD
DRAW_RANGE = float(1 << 31)

MASK32 = 0xFFFFFFFF
#: Steps between two looks at whether a key's walk has ended.
STEPS_PER_LOOK = 3
#: Parts that each shard is numbered in, so that no task sorts a whole shard.
SLOT_BUCKETS = 1024


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _and32(c: Column) -> Column:
    return c.bitwiseAND(_long(MASK32))


def _next_state(high: Column, low: Column) -> tuple[Column, Column]:
    """state * multiplier + 1 modulo 2^64, in halves."""
    low0, low1 = low.bitwiseAND(_long(0xFFFF)), F.shiftright(low, 16)
    high0, high1 = high.bitwiseAND(_long(0xFFFF)), F.shiftright(high, 16)
    upper = low1 * _long(MULTIPLIER_LOW)
    sum_low = low0 * _long(MULTIPLIER_LOW) + _long(1) + upper.bitwiseAND(_long(0xFFFF)) * _long(65536)
    carry = F.shiftright(sum_low, 32) + F.shiftright(upper, 16)
    mixed = high0 * _long(MULTIPLIER_LOW) + (high1 * _long(MULTIPLIER_LOW)).bitwiseAND(_long(0xFFFF)) * _long(65536)
    return _and32(carry + mixed + low * _long(MULTIPLIER_HIGH)), _and32(sum_low)


def first_draw(key: Column) -> Column:
    """The 31 random bits that the key's sequence begins with."""
    high, _ = _next_state(_and32(F.shiftrightunsigned(key, 32)), _and32(key))
    return F.shiftright(high, 1)


def jump_walk(key: Column, shards: int) -> Column:
    """struct(shard, next_shard): where the key lies among `shards`, and the next shard that it would move to."""

    def state(high: Column, low: Column, at: Column, ahead: Column) -> Column:
        return F.struct(high.alias("high"), low.alias("low"), at.alias("at"), ahead.alias("ahead"))

    def step(acc: Column, _: Column) -> Column:
        high, low = _next_state(acc["high"], acc["low"])
        draw = (F.shiftright(high, 1) + _long(1)).cast("double")
        ahead = F.floor((acc["ahead"] + _long(1)).cast("double") * (F.lit(DRAW_RANGE) / draw)).cast("long")
        return F.when(acc["ahead"] < _long(shards), state(high, low, acc["ahead"], ahead)).otherwise(acc)

    few = F.sequence(F.lit(1), F.lit(STEPS_PER_LOOK))
    none = F.slice(few, 1, 0)

    def look(acc: Column, _: Column) -> Column:
        return F.aggregate(F.when(acc["ahead"] < _long(shards), few).otherwise(none), acc, step)

    start = state(_and32(F.shiftrightunsigned(key, 32)), _and32(key), _long(-1), _long(0))
    looks = -(-shards // STEPS_PER_LOOK)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(looks)), start, look, lambda acc: F.struct(acc["at"].alias("shard"), acc["ahead"].alias("next_shard"))
    )


def with_shards(df: DataFrame, key: str, shards: int) -> DataFrame:
    """df and the columns shard and grown_shard (the shard with one more). A null key counts as key 0."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    walk = F.col("_walk")
    return (
        df.withColumn("_walk", jump_walk(F.coalesce(F.col(key).cast("long"), _long(0)), shards))
        .withColumn("shard", walk["shard"].cast("int"))
        .withColumn("grown_shard", F.when(walk["next_shard"] == _long(shards), F.lit(shards)).otherwise(walk["shard"].cast("int")))
        .drop("_walk")
    )


def shard_documents(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", buckets: int = SLOT_BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document.

    Only the key and the shard count decide the shard (law `key`). Slots count from 0 in each shard without
    a gap: a shard is cut into `buckets` parts by the key's first random draw, parts are numbered on their own
    and shifted by what lies in the parts before. The counts of all parts are shards * buckets rows at most,
    which bounds what is broadcast. Rows with equal keys are numbered by size and checksum; rows that are equal
    in all take any order. A null text has no bytes, a null key counts as 0, an empty table gives no rows.
    """
    whole = F.col(text).cast("string")
    keyed = docs.select(F.col(key).cast("long").alias("doc_id"), whole.alias("_text"))
    draw = F.shiftright(first_draw(F.coalesce(F.col("doc_id"), _long(0))), 5)
    placed = with_shards(keyed, "doc_id", shards).withColumn("_part", F.pmod(draw, _long(buckets)).cast("int"))
    rows = placed.select(
        "doc_id",
        (F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long") + _long(16)).alias("size"),
        F.crc32(F.coalesce(F.col("_text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"), "shard", "grown_shard", "_part",
    )
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "_part").count().select("shard", "_part", F.coalesce(F.sum("count").over(before), _long(0)).alias("_start"))
    within = Window.partitionBy("shard", "_part").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("_at", F.row_number().over(within))
    return numbered.join(F.broadcast(starts), ["shard", "_part"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("_start") + F.col("_at") - _long(1)).alias("slot"), "grown_shard"
    )


def op6_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=40)


QUERIES = {"op6_jump_sharding": op6_jump_sharding}
ORACLES: dict[str, str] = {}
