"""Composed pipelines: scoped search, relabelling, prompts, and tool calls of an agent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.functions import text as T
from docquarry.operators import guard, sparse
from docquarry.session import checkpointed, few, union
from docquarry.streaming import folds


def scoped_search(docs: DataFrame, terms: DataFrame, users: DataFrame, column: str, k: int) -> DataFrame:
    """user_id, qid, doc_id, score, rank: every user's search over what they may see; statistics are those of the corpus.

    users: user_id, allowed (values of `column`). A user's k best are among the k best of each value, so the corpus
    is searched once for all users.
    """
    best = sparse.search(docs, terms, k, group=column).drop("rank")
    seen = users.select("user_id", F.explode(F.array_distinct("allowed")).alias(column)).join(best, column)
    return sparse.top(seen.select("user_id", "qid", "doc_id", "score"), k, by=("user_id", "qid"))


def answer_bearing(facts: DataFrame, passages: DataFrame) -> DataFrame:
    """qid, doc_id: passages of a fact's source that have all its distinctive numbers. They meet on (source, number), so no passage is compared with facts it shares nothing with."""
    own = facts.select("qid", "source", F.filter("numbers", lambda n: F.length(F.regexp_replace(F.regexp_replace(n, r"[^\d]", ""), "^0+", "")) >= 4).alias("n"))
    need = own.where(F.size("n") > 0).select("qid", "source", F.explode("n").alias("number"))
    wanted = need.groupBy("qid").agg(F.count("*").alias("wanted"))
    have = passages.select("doc_id", "source", F.explode(T.numbers(F.col("text"), skip_trivial=False)).alias("number"))
    hits = need.join(have, ["source", "number"]).groupBy("qid", "doc_id").agg(F.count_distinct("number").alias("found"))
    return hits.join(wanted, "qid").where("found = wanted").select("qid", "doc_id")


def relabel(before: DataFrame, after: DataFrame) -> DataFrame:
    """qid, labels, grade, lost: what each labelled question has under another chunking."""
    counted = after.groupBy("qid").agg(F.count("*").alias("labels"), F.max("grade").alias("grade"))
    out = before.select("qid").distinct().join(counted, "qid", "left")
    return out.select("qid", F.coalesce("labels", F.lit(0)).alias("labels"), F.coalesce("grade", F.lit(0)).alias("grade"), F.col("labels").isNull().alias("lost"))


def numbered_context(hits: DataFrame) -> DataFrame:
    """qid, context: hits (source, lang, rank) as numbered lines."""
    line = F.format_string("[%d] %s: %s", "rank", "source", "lang")
    return hits.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("t")))), lambda s: s["t"]), "\n---\n").alias("context"))


def run_tools(calls: DataFrame, docs: DataFrame, edges: DataFrame, allowed: tuple = ("search", "calculate", "relations")) -> DataFrame:
    """calls (run_id, seq, tool, query) with decision and result: admission in order, then each tool over all its admitted calls at once."""
    decided = folds.run(calls.withColumn("args", F.lit("{}")), folds.admission(list(allowed)), "run_id", ["seq"])
    go = decided.where("decision = 'admitted'")
    key = F.format_string("%d:%d", F.col("run_id").cast("long"), F.col("seq").cast("long"))
    found = sparse.search(docs, sparse.query_terms(go.where("tool = 'search'").select(key.alias("qid"), F.col("query").alias("question"))), 3)
    searched = found.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda s: s["doc_id"].cast("string")), ",").alias("result"))
    counted = go.where("tool = 'calculate'").select(key.alias("qid"), guard.safe_value(F.col("query")).cast("string").alias("result"))
    asked = go.where("tool = 'relations'").select(key.alias("qid"), "query")
    related = asked.join(edges, F.col("query").isin(F.col("subject"), F.col("object")), "left").groupBy("qid").agg(F.concat(F.count("subject").cast("string"), F.lit(" edges")).alias("result"))
    results = union(searched, counted, related)
    return decided.withColumn("qid", key).join(results, "qid", "left").drop("qid", "args")


def answers(hits: DataFrame, questions: DataFrame, docs: DataFrame, floor: float | None = None, quarantined: bool = False, untrusted: bool = False, refusals: DataFrame | None = None) -> DataFrame:
    """qid, refused_by, sources, context, answer, passed: from retrieved passages to a checked answer, one row a question.

    hits: qid, doc_id, rank, rerank_score. A question with a refusal (qid, refused_by) is not answered; nor is one
    without passages, with its best passage below the floor, or all of whose passages hold injected instructions
    (those go, where they are quarantined). The default writer takes the best sentences of the first passage and
    cites it; its numbers are checked against that passage.
    """
    hits = checkpointed(hits)
    # Written before they are searched for instructions, or the patterns would run over every document.
    texts = checkpointed(docs.join(few(hits.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "source", F.col("text").alias("passage")))
    found = hits.join(texts, "doc_id")
    low = found.groupBy("qid").agg(F.max("rerank_score").alias("best"))
    if quarantined:
        found = found.where(F.size(T.injections(F.col("passage"))) == 0)
    found = checkpointed(found.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))))
    shown = guard.format_untrusted(F.col("n"), F.col("source"), F.col("passage")) if untrusted else F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.col("source"), F.lit("\n"), F.col("passage"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("n", c.alias("x")))), lambda s: s["x"])
    prompts = found.groupBy("qid").agg(in_order(F.col("doc_id")).alias("sources"), F.array_join(in_order(shown), "\n---\n").alias("context"))
    first = found.where("n = 1").select("qid", "passage")
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "sentence"))), lambda s: s["sentence"]), " ")
    written = guard.extractive_sentences(first.join(questions, "qid")).groupBy("qid").agg(F.concat(parts, F.lit(" [1]")).alias("answer"))
    checked = written.join(first, "qid").withColumn("passed", F.size(guard.ungrounded(F.col("answer"), F.array("passage"))) == 0).drop("passage")
    asked = questions.select("qid")
    asked = asked.withColumn("told", F.lit(None).cast("string")) if refusals is None else asked.join(refusals.select("qid", F.col("refused_by").alias("told")), "qid", "left")
    out = asked.join(low, "qid", "left").join(prompts, "qid", "left").join(checked, "qid", "left")
    below = F.lit(False) if floor is None else F.col("best") < floor
    refused = F.when(F.col("told").isNotNull(), F.col("told")).when(F.col("best").isNull() & F.col("sources").isNull(), F.lit("no passage")).when(below, F.lit("floor")).when(F.col("sources").isNull(), F.lit("quarantine"))
    answered = F.col("refused_by").isNull()
    return out.withColumn("refused_by", refused).select("qid", "refused_by", *(F.when(answered, F.col(c)).alias(c) for c in ("sources", "context", "answer", "passed")))
