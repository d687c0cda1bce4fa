"""Second-stage scores, the relevance floor, and labels by contained evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions.text import tokens
from docquarry.operators.patterns import containing
from docquarry.operators.sparse import documents_of
from docquarry.session import checkpointed, few


def cross_scores(candidates: DataFrame, questions: DataFrame, docs: DataFrame) -> DataFrame:
    """candidates (qid, doc_id, ...) and rerank_score; docs are documents or an index. The default scorer is lexical: the share of the question's tokens that the document has, less a little for its length."""
    docs = documents_of(docs)
    q = questions.select("qid", F.array_distinct(tokens(F.col("question"))).alias("_q"))
    toks = F.col("toks") if "toks" in docs.columns else tokens(F.col("text"))
    candidates = checkpointed(candidates)
    d = docs.join(few(candidates.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", toks.alias("_d"))
    share = F.size(F.array_intersect("_q", F.array_distinct("_d"))) / F.greatest(F.size("_q"), F.lit(1))
    scored = candidates.join(q, "qid").join(d, "doc_id")
    return scored.withColumn("rerank_score", F.round(8.0 * share - 4.0 - F.ln(1 + F.size("_d")) / 10, 6)).drop("_q", "_d")


def below_floor(questions: DataFrame, scored: DataFrame, floor: float) -> DataFrame:
    """qid, best, refused: a question whose best passage is under the floor, or that has none, is refused before an answer is written."""
    best = scored.groupBy("qid").agg(F.round(F.max("rerank_score"), 6).alias("best"))
    return questions.join(best, "qid", "left").withColumn("refused", F.coalesce(F.col("best") < floor, F.lit(True)))


def relevance_labels(items: DataFrame, docs: DataFrame) -> DataFrame:
    """qid, doc_id, grade: documents that contain an item's text (white space folded, any case); 2 if it is the item's own source, else 1.

    Each document is read once, by an automaton of the items' texts.
    """
    folded = lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))
    asked = items.select(F.col("item_id").alias("qid"), folded(F.col("text")).alias("pattern"))
    # What a document is told by goes along with its id, so that it need not be joined again.
    named = docs.select(F.to_json(F.struct("doc_id", "source")).alias("named"), folded(F.col("text")).alias("body"))
    found = containing(named, asked, "named", "body").select("qid", F.from_json("named", docs.select("doc_id", "source").schema).alias("d"))
    own = F.col("d.source") == F.concat(F.lit("src"), (F.col("qid") % 20).cast("string"))
    return found.select("qid", "d.doc_id", F.when(own, F.lit(2)).otherwise(F.lit(1)).alias("grade"))
