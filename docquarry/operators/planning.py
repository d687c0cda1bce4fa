"""Filters, access scope, and the rule-based planner, for batches of questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.text import expand_terms, tickers, years

# Wording that asks for advice, and wording that asks for an aggregate.
ADVICE = r"(?i)\b(should i|is it a good (time|idea) to)\s+(buy|sell|invest|hold)|\bprice target\b|\b(buy|sell) (the )?stock\b|\bgood investment\b"
AGGREGATE = r"(?i)\b(which of the (five|5)|rank|combined|total of|sum of|most|least|highest|lowest|fastest|by what percentage|how much more|grew more|partner|suppl|compet)\w*"


def metadata_predicate(wanted: dict[str, list] | None) -> Column:
    """Values of a key are alternatives, keys must all match; nothing wanted matches all. Null never matches a key."""
    return reduce(lambda a, b: a & b, (F.col(k).isin(*v) for k, v in (wanted or {}).items()), F.lit(True))


def scoped_filter(pairs: DataFrame, everything: list[str]) -> DataFrame:
    """asked, allowed -> tickers to search (null: no restriction), refused. An empty intersection is refused, never searched unfiltered."""
    want = F.array_intersect(F.when(F.size("asked") == 0, F.col("allowed")).otherwise(F.col("asked")), F.col("allowed"))
    scoped = pairs.withColumn("_want", want)
    n = F.size("_want")
    return scoped.withColumn("tickers", F.when((n > 0) & (n < len(everything)), F.array_sort("_want"))).withColumn("refused", n == 0).drop("_want")


def violations(hits: DataFrame) -> DataFrame:
    """Hits (ticker) that their user's list (allowed) does not have."""
    return hits.where(~F.array_contains("allowed", F.col("ticker")))


def _catalog(catalog: dict[str, list[int]]) -> Column:
    return F.create_map(*(x for k, v in catalog.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))


def sub_questions(questions: DataFrame, catalog: dict[str, list[int]]) -> DataFrame:
    """qid, ticker, question, filing_years, n: one row for each company named, or one without a company.

    A year is reported by its own filing and by the next one's comparative column, so year X asks for the
    filings of X and X + 1 that are there.
    """
    named = questions.withColumn("_t", tickers(F.col("question"))).withColumn("n", F.size("_t"))
    each = named.select("qid", F.col("question").alias("whole"), "n", F.explode_outer("_t").alias("ticker"))
    asked = years(F.col("whole"))
    both = F.array_distinct(F.concat(asked, F.transform(asked, lambda y: y + 1)))
    there = F.coalesce(F.try_element_at(_catalog(catalog), F.col("ticker")), F.array().cast("array<int>"))
    text = F.when(F.col("n") > 1, F.concat(F.col("ticker"), F.lit(": "), F.col("whole"))).otherwise(F.col("whole"))
    return each.select("qid", "ticker", "n", "whole", expand_terms(text, F.col("ticker")).alias("question"), F.array_sort(F.array_intersect(both, there)).alias("filing_years"))


def rule_plan(questions: DataFrame, catalog: dict[str, list[int]]) -> DataFrame:
    """route and sub-questions by rules alone. Questions for advice have one row without a sub-question."""
    subs = sub_questions(questions, catalog).withColumn("advice", F.col("whole").rlike(ADVICE))
    keep = lambda c: F.when(~F.col("advice"), F.col(c)).alias(c)
    return subs.select("qid", F.when(F.col("advice"), F.lit("investment_advice")).otherwise(F.lit("answer")).alias("route"), keep("ticker"), keep("question"), keep("filing_years")).distinct()


def route(questions: DataFrame, catalog: dict[str, list[int]]) -> DataFrame:
    """qid, path (react for three sub-questions or aggregate wording, else pipeline), why."""
    q = questions.withColumn("n", F.greatest(F.size(tickers(F.col("question"))), F.lit(1))).withColumn("advice", F.col("question").rlike(ADVICE))
    word, many = F.regexp_extract("question", AGGREGATE, 0), F.col("n") >= 3
    path = F.when(F.col("advice"), F.lit("pipeline")).when(many | (word != ""), F.lit("react")).otherwise(F.lit("pipeline"))
    why = (
        F.when(F.col("advice"), F.lit("router: investment_advice")).when(many, F.concat(F.col("n").cast("string"), F.lit(" sub-questions")))
        .when(word != "", F.concat(F.lit("aggregate wording: '"), word, F.lit("'"))).otherwise(F.concat(F.col("n").cast("string"), F.lit(" sub-question(s), no aggregation")))
    )
    return q.select("qid", path.alias("path"), why.alias("why"))


def plan_policy(proposed: DataFrame) -> DataFrame:
    """Corrects a proposed plan: a covered company that is named is never refused, and each one gets a sub-question."""
    both = proposed.withColumn("companies", F.array_distinct(F.concat("proposed", tickers(F.col("question")))))
    refused = F.col("proposed_route").isin("out_of_scope", "unsupported_company")
    fixed = both.withColumn("route", F.when((F.size("companies") > 0) & refused, F.lit("answer")).otherwise(F.col("proposed_route")))
    added = F.when(F.col("route") == "answer", F.size(F.array_except("companies", "proposed"))).otherwise(F.lit(0)).cast("long")
    return fixed.withColumn("rerouted", F.col("route") != F.col("proposed_route")).withColumn("added", added)


def refusal_text(route: Column, companies: Column) -> Column:
    return (
        F.when(route == "investment_advice", F.lit("I can describe what the filings say, but I do not give investment advice."))
        .when(route == "out_of_scope", F.lit("That question is not about the indexed filings."))
        .when(route == "unsupported_company", F.concat(F.lit("No filings are indexed for: "), F.array_join(companies, ", "), F.lit(".")))
    )
