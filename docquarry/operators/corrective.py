"""Corrective answering of planned questions, with a state for each sub-question.

Round 0 searches each sub-question within its company and filing years. What is found is graded; sub-questions that
nothing answers are rewritten, their years widened by the next year's filing, maybe among tables only, and searched
again, at most twice; passages found before are not taken again. Then each question is answered from the passages that
answer, and relevant ones after them, the answer is reviewed, and mended once if it fails.

Grading, rewriting, writing and reviewing are functions of DataFrames, with plain defaults for absent models.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.functions import text as T
from docquarry.operators import agent, guard, sparse
from docquarry.operators.postings import Postings
from docquarry.session import checkpointed, few, union

#: Share of a sub-question's tokens from which a passage answers it, and from which it is relevant.
ANSWERS, RELEVANT = 0.6, 0.2
#: Wording that asks for a reported figure.
FIGURE = r"(?i)\b(how (much|many)|total|amount|percent(age)?)\b|\d"
ROUNDS, FIXES, PASSAGES = 2, 1, 4


@dataclass
class Corrected:
    """answers: qid, refused_by, passages, answer, ok, fixes. subs: qid, sub, tried (searches), answered. hits: qid, sub, doc_id, round, place, grade."""

    answers: DataFrame
    subs: DataFrame
    hits: DataFrame


def grade_by_tokens(hits: DataFrame, docs: DataFrame, answers: float = ANSWERS, relevant: float = RELEVANT) -> DataFrame:
    """hits (call, question, doc_id, ...) with grade: 2 if the passage has enough of the question's tokens, 1 if it has some, else 0."""
    terms = F.array_distinct(T.tokens(F.col("question")))
    body = sparse.documents_of(docs).join(few(checkpointed(hits.select("doc_id").distinct())), "doc_id", "left_semi").select("doc_id", F.array_distinct("toks").alias("_has"))
    share = F.size(F.array_intersect("_has", terms)) / F.greatest(F.size(terms), F.lit(1))
    return hits.join(body, "doc_id").withColumn("grade", F.when(share >= answers, 2).when(share >= relevant, 1).otherwise(0)).drop("_has")


def later_half(query: Column) -> Column:
    """The later half of the words, which is another query as long as there are two."""
    words = F.split(query, " ")
    return F.array_join(F.slice(words, (F.floor(F.size(words) / 2) + 1).cast("int"), F.size(words)), " ")


def search(index: Postings, asked: DataFrame, k: int, company: str, kind: str, year: str) -> DataFrame:
    """call, doc_id, rank: the k best passages of each (call, query, company, years, tables); null, or no years, is any. Each year is searched by itself, as the best of all are among the best of each."""
    each = asked.select("call", "query", "company", "tables", F.explode_outer(F.when(F.size("years") > 0, F.array_distinct("years"))).alias("year"))
    own = F.to_json(F.array("company", F.when(F.col("tables"), F.lit("table")), F.col("year").cast("string")))
    each = each.select(F.to_json(F.array(F.col("call"), F.col("year").cast("string"))).alias("qid"), "call", "query", own.alias("_own"))
    terms = sparse.query_terms(each, text="query").join(each.select("qid", "_own"), "qid")
    value = F.to_json(F.array(*(F.col(c).cast("string") for c in (company, kind, year))))
    found = index.search(terms, k, group="_own", value=value, patterns=True).select("qid", "doc_id", "score")
    return sparse.top(found.join(each.select("qid", "call"), "qid").select("call", "doc_id", "score"), k, by=("call",)).drop("score")


def correct(
    questions: DataFrame, subs: DataFrame, index: Postings, docs: DataFrame, k: int = 6, more: int = 4, company: str = "company", kind: str = "kind", year: str = "year",
    grade: Callable[[DataFrame, Postings], DataFrame] = grade_by_tokens, rewrite: Callable[[Column], Column] = later_half,
) -> Corrected:
    """Answer questions (qid, question) by their sub-questions (qid, sub, question, company, years).

    max(2, k // n) passages for each of n sub-questions at first, `more` in each later round. index and docs (doc_id,
    text) are of the same passages. A question without sub-questions is refused by its plan, one without relevant
    passages by `no relevant passages`.
    """
    n = Window.partitionBy("qid")
    width = F.greatest(F.lit(2), F.floor(F.lit(k) / F.count("*").over(n))).cast("int")
    state = subs.select("qid", "sub", "question", "company", F.coalesce("years", F.array().cast("array<int>")).alias("years"), F.col("question").alias("query"), F.lit(False).alias("tables"), width.alias("width"))
    state = checkpointed(state.withColumn("call", F.to_json(F.array(F.col("qid").cast("string"), F.col("sub").cast("string")))))
    open_, graded, tried = state, None, state.select("qid", "sub", F.lit(1).alias("tried"))
    for r in range(ROUNDS + 1):
        found = search(index, open_, max(k, more), company, kind, year).join(open_.select("call", "qid", "sub", "question", "width"), "call")
        found = found.where(F.col("rank") <= (F.col("width") if r == 0 else F.lit(more)))
        new = found if graded is None else found.join(graded.select("call", "doc_id"), ["call", "doc_id"], "left_anti")
        new = grade(checkpointed(new.select("call", "qid", "sub", "question", "doc_id", "rank")), index).select("call", "qid", "sub", "doc_id", F.lit(r).alias("round"), F.col("rank").alias("place"), "grade")
        graded = checkpointed(new if graded is None else union(graded, new))
        if r == ROUNDS:
            break
        answered = graded.where("grade = 2").select("call").distinct()
        wider = F.array_sort(F.array_distinct(F.concat("years", F.transform("years", lambda y: y + 1))))
        years = F.when(F.col("first"), wider).otherwise(F.col("years"))
        open_ = open_.join(answered, "call", "left_anti").withColumn("first", F.lit(r == 0))
        open_ = checkpointed(open_.select("call", "qid", "sub", "question", "company", years.alias("years"), rewrite(F.col("query")).alias("query"), F.col("question").rlike(FIGURE).alias("tables"), "width"))
        tried = union(tried, open_.select("qid", "sub", F.lit(1).alias("tried")))
    done = graded.groupBy("qid", "sub").agg((F.max("grade") == 2).alias("answered"))
    per_sub = tried.groupBy("qid", "sub").agg(F.sum("tried").alias("tried")).join(done, ["qid", "sub"], "left").withColumn("answered", F.coalesce("answered", F.lit(False)))
    return Corrected(_answers(questions, subs, graded, docs), per_sub, graded.drop("call"))


def _answers(questions: DataFrame, subs: DataFrame, graded: DataFrame, docs: DataFrame) -> DataFrame:
    """A draft from the first passage; where the review fails, one from the next passage, which is the fix."""
    ranked = graded.withColumn("rank", F.col("round") * 1000 + F.col("place")).select("qid", "sub", "doc_id", "grade", "rank")
    chosen = checkpointed(agent.passage_order(ranked, PASSAGES).select("qid", "doc_id", "position"))
    listed = chosen.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "doc_id"))), lambda s: s["doc_id"]).alias("passages"))
    # Both drafts need the first two passages only; the review looks at the numbers of all.
    texts = checkpointed(docs.select("doc_id", "text").join(few(chosen.select("doc_id").distinct()), "doc_id", "left_semi"))
    shown = chosen.join(texts, "doc_id")
    numbers = shown.groupBy("qid").agg(F.collect_list("text").alias("texts"))  # PASSAGES for each sub-question at most

    def draft(position: int) -> DataFrame:
        rows = shown.where(F.col("position") == position).select("qid", F.col("text").alias("passage")).join(questions.select("qid", "question"), "qid")
        parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "sentence"))), lambda s: s["sentence"]), " ")
        written = guard.extractive_sentences(rows).groupBy("qid").agg(F.concat(parts, F.lit(f" [{position}]")).alias("answer"))
        return reviewed(written.join(questions.select("qid", "question"), "qid").join(numbers, "qid"))

    first, second = checkpointed(draft(1)), draft(2)
    mended = first.where("NOT ok").select("qid").join(second, "qid").select("qid", F.col("answer").alias("answer_2"), F.col("ok").alias("ok_2"))
    drafts = first.join(mended, "qid", "left")
    fixed = ~F.col("ok") & F.col("answer_2").isNotNull()
    drafts = drafts.select("qid", F.when(fixed, F.col("answer_2")).otherwise(F.col("answer")).alias("answer"), F.when(fixed, F.col("ok_2")).otherwise(F.col("ok")).alias("ok"), fixed.cast("int").alias("fixes"))
    planned = subs.select("qid").distinct().withColumn("planned", F.lit(True))
    whole = questions.select("qid").join(planned, "qid", "left").join(listed, "qid", "left").join(drafts, "qid", "left")
    refused = F.when(F.col("planned").isNull(), F.lit("plan")).when(F.col("passages").isNull(), F.lit("no relevant passages")).when(F.col("answer").isNull(), F.lit("no answer"))
    return whole.select("qid", refused.alias("refused_by"), "passages", "answer", "ok", F.coalesce("fixes", F.lit(0)).alias("fixes"))


def reviewed(answers: DataFrame) -> DataFrame:
    """qid, answer, ok: whether an answer (qid, question, answer, texts) shares a word with its question and has no number that its passages lack."""
    shared = F.size(F.array_intersect(T.question_words(F.col("question")), T.question_words(F.col("answer")))) > 0
    return answers.select("qid", "answer", (shared & (F.size(guard.ungrounded(F.col("answer"), F.col("texts"))) == 0)).alias("ok"))
