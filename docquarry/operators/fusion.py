"""Fusion of ranked lists (qid, list, id, rank, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.operators.sparse import top

RANK_OFFSET = 60


def reciprocal_rank(lists: DataFrame, k: int, by: tuple = ("qid",), key: str = "doc_id") -> DataFrame:
    """Sum of 1 / (60 + rank) over the lists; ties by id."""
    scored = lists.groupBy(*by, key).agg(F.round(F.sum(1.0 / (RANK_OFFSET + F.col("rank"))), 6).alias("rrf_score"))
    return top(scored, k, "rrf_score", by, key)


def weighted_scores(lists: DataFrame, weights: dict[str, float], k: int, key: str = "doc_id") -> DataFrame:
    """Scores of each list brought to 0..1 (a constant list to 1), weighted and summed; absent is 0."""
    w = Window.partitionBy("qid", "list")
    low, high = F.min("score").over(w), F.max("score").over(w)
    unit = F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low))
    weight = F.coalesce(*(F.when(F.col("list") == name, F.lit(float(x))) for name, x in weights.items()), F.lit(0.0))
    return top(lists.select("qid", key, (unit * weight).alias("u")).groupBy("qid", key).agg(F.round(F.sum("u"), 6).alias("fused")), k, "fused")


def interleave(ranked: DataFrame, block: str, by: tuple = ("qid",)) -> DataFrame:
    """Round robin by rank over blocks: the first of each, the second of each, ...; position counts from 1."""
    return ranked.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy("rank", block)))


def interleave_then_tails(ranked: DataFrame, block: str, by: tuple = ("qid",)) -> DataFrame:
    """By rank up to the length of the shortest block, then what is left of each block in turn."""
    lengths = ranked.groupBy(*by, block).agg(F.max("rank").alias("n")).groupBy(*by).agg(F.min("n").alias("even"))
    even = F.col("rank") <= F.col("even")
    order = [F.when(even, 0).otherwise(1), F.when(even, F.col("rank")).otherwise(0), block, "rank"]
    return ranked.join(lengths, list(by)).withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).drop("even")
