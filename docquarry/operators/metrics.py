"""Retrieval metrics of ranked lists against graded labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def per_query(ranked: DataFrame, labels: DataFrame, k: int, queries: DataFrame) -> DataFrame:
    """qid, recall, precision, hit, mrr, ndcg at k for every query.

    ranked: qid, doc_id, rank (an id that comes twice counts at its best rank). labels: qid, doc_id, grade over 0.
    """
    best = ranked.where(F.col("rank") <= k).groupBy("qid", "doc_id").agg(F.min("rank").alias("rank"))
    hits = best.join(labels, ["qid", "doc_id"]).groupBy("qid").agg(
        F.count("*").alias("found"), F.min("rank").alias("first"), F.sum((F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1)).alias("dcg")
    )
    w = Window.partitionBy("qid").orderBy(F.desc("grade"), "doc_id")
    ideal = labels.withColumn("i", F.row_number().over(w)).groupBy("qid").agg(
        F.count("*").alias("relevant"), F.sum(F.when(F.col("i") <= k, (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("i") + 1))).alias("idcg")
    )
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return queries.join(ideal, "qid", "left").join(hits, "qid", "left").select(
        "qid",
        zero(F.col("found") / F.col("relevant")).alias("recall"),
        zero(F.col("found") / F.lit(k)).alias("precision"),
        F.when(F.col("found") > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("hit"),
        zero(1.0 / F.col("first")).alias("mrr"),
        zero(F.col("dcg") / F.col("idcg")).alias("ndcg"),
    )
