"""Queries of reports on runs, requests, caches, golden items and traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.operators import agent, graph, reports, statistics, vectors
from docquarry.operators.telemetry import cost_usd
from docquarry.plans.q_operations import _DETECTOR, BASE, NOW, RULES
from docquarry.plans.q_retrieval import _E, _INDEX, _QUERIES, _bm25, _bm25_top, _questions, _ranked, _vec_queries
from docquarry.plans.q_text import tokens_sql
from docquarry.plans.registry import Fixture, query, table
from docquarry.session import scratch
from docquarry.sources import readers

# ---- Requests and caches --------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT *, epoch_us(ts) / 1e6 AS began, CASE WHEN k >= 6 THEN value / 4 END AS ttft FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))
SELECT event_type, count(*) AS n, count_if(value <= 100) AS ok, count_if(k < 6) AS cache_hits, round(count(*) / (max(began + value) - min(began)), 2) AS throughput_rps, round(quantile_cont(value, 0.5), 2) AS p50_s, round(quantile_cont(value, 0.95), 2) AS p95_s,
round(quantile_cont(ttft, 0.5), 2) AS ttft_p50_s, round(quantile_cont(ttft, 0.95), 2) AS ttft_p95_s FROM r GROUP BY event_type""")
def load_scenarios(spark, sf_dir):
    """Events as requests: value is the time taken, low k a cache hit, which sends no first token."""
    k = F.get_json_object("props", "$.k").cast("long")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(spark, sf_dir, "events").select("event_type", at.alias("at"), F.col("value").alias("total"), F.when(k >= 6, F.col("value") / 4).alias("ttft"), (F.col("value") <= 100).alias("ok"), F.when(k < 3, F.lit("exact")).when(k < 6, F.lit("semantic")).alias("cache"))
    return reports.load_report(e, "event_type")


@query("""SELECT * FROM (SELECT event_id, unnest([{'name': 'user', 'value': CAST(user_id AS VARCHAR)}, {'name': 'event_type', 'value': event_type}, {'name': 'late', 'value': CASE WHEN value > 100 THEN 'true' END}, {'name': 'props', 'value': '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}'}], recursive := true) FROM events) WHERE value IS NOT NULL""")
def exported_attributes(spark, sf_dir):
    """Events as attributes: a renamed scalar, a text, one that is null as a rule, and a struct."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.when(F.col("value") > 100, F.lit(True)).alias("late"), F.from_json("props", "k long").alias("props"))
    return reports.export_attributes(e, "event_id", {"user_id": "user"})


_PAIRS = f"{_E}, p AS (SELECT a.label AS kind, a.label = b.label AS same, round(list_cosine_similarity(a.v, b.v), 6) AS similarity, (a.v[1] > 0) = (b.v[1] > 0) AS agrees FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)"
_THRESHOLDS = [-0.2, 0.0, 0.1, 0.2, 0.4]


def _pairs(spark, sf_dir):
    """Each vector and the next one; the sign of the first place stands for the entities that a guard compares."""
    e = table(spark, sf_dir, "embeddings")
    a, b = e.select("vec_id", F.col("label").alias("kind"), F.col("embedding").alias("a")), e.select((F.col("vec_id") - 1).alias("vec_id"), "label", F.col("embedding").alias("b"))
    positive = lambda c: F.get(c, F.lit(0)) > 0
    return a.join(b, "vec_id").select("kind", (F.col("kind") == F.col("label")).alias("same"), F.round(vectors.cosine(F.col("a"), F.col("b")), 6).alias("similarity"), (positive(F.col("a")) == positive(F.col("b"))).alias("agrees"))


@query(f"""WITH {_PAIRS}, c AS (SELECT CAST(threshold AS DOUBLE) AS threshold, guarded, count_if(same AND similarity >= threshold AND (agrees OR NOT guarded)) AS rights, count_if(NOT same AND similarity >= threshold AND (agrees OR NOT guarded)) AS wrong FROM p, (VALUES {', '.join(f'({t})' for t in _THRESHOLDS)}) AS _t(threshold), (VALUES (true), (false)) AS _g(guarded) GROUP BY ALL)
SELECT threshold, guarded, rights AS "right", wrong, round(rights / nullif(rights + wrong, 0), 6) AS precision, round(rights / (SELECT nullif(count_if(same), 0) FROM p), 6) AS recall FROM c""")
def cache_guard_sweep(spark, sf_dir):
    return reports.threshold_sweep(_pairs(spark, sf_dir), _THRESHOLDS)


@query(f"WITH {_PAIRS} SELECT kind, same, count(*) AS n, round(quantile_cont(similarity, 0.5), 6) AS median, count_if(NOT agrees) AS blocked FROM p GROUP BY kind, same")
def cache_guard_blocks(spark, sf_dir):
    return reports.guard_blocks(_pairs(spark, sf_dir), "kind")


@query(f"WITH {_E}, p AS ({_ranked('SELECT eq.qid, e.vec_id, round(list_dot_product(eq.qvec, e.v), 6) AS score FROM eq, e WHERE e.vec_id <> eq.qid', 1, key='vec_id')}) SELECT CAST(threshold AS DOUBLE) AS threshold, count_if(score >= threshold) AS with_neighbour, count(*) AS questions FROM p, (VALUES (0.3), (0.4), (0.5)) AS _t(threshold) GROUP BY threshold")
def neighbour_counts(spark, sf_dir):
    """How many questions have another one at least so near."""
    found = vectors.exact_search(table(spark, sf_dir, "embeddings"), _vec_queries(spark, sf_dir), 2).where("vec_id != qid")
    best = found.groupBy("qid").agg(F.max("score").alias("score"))
    thresholds = (0.3, 0.4, 0.5)
    counts = best.agg(F.count("*").alias("questions"), *(F.count_if(F.col("score") >= t).alias(str(t)) for t in thresholds))
    return counts.select("questions", F.inline(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"`{t}`").alias("with_neighbour")) for t in thresholds))))


# ---- Verdicts -------------------------------------------------------------------------------------------------------


@query(f"WITH c AS (SELECT count_if(toxic = 1 AND {_DETECTOR}) AS rights, count_if(toxic = 0 AND {_DETECTOR}) AS wrong, count_if(toxic = 1 AND NOT {_DETECTOR}) AS missed FROM labels l JOIN documents d USING (doc_id)) SELECT rights AS \"right\", wrong AS false_refusals, missed, round(rights / nullif(rights + wrong, 0), 6) AS precision, round(rights / nullif(rights + missed, 0), 6) AS recall FROM c")
def refusal_scores(spark, sf_dir):
    """Labelled documents as requests: toxic ones should be refused, and a word list refuses."""
    hit = F.lower("text").rlike(r"\b(idiot|moron|stupid|scum|loser|clown|trash|pathetic|worthless|disgusting)\b")
    cases = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("should_refuse")).join(table(spark, sf_dir, "documents").select("doc_id", hit.alias("refused")), "doc_id")
    return reports.refusal_scores(cases)


_GRADED = "g AS (SELECT source AS pipeline, CASE WHEN quality = 1 AND toxic = 0 THEN 'correct' WHEN quality = 1 THEN 'partial' ELSE 'wrong' END AS verdict, CASE WHEN regexp_matches(text, '[0-9]') THEN n_chars > 400 END AS ok FROM labels JOIN documents USING (doc_id))"


@query(f"WITH {_GRADED} SELECT pipeline, verdict, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY pipeline), 6) AS share, count(ok) AS with_figures, count_if(coalesce(ok, false)) AS figures_present, count_if(coalesce(ok = (verdict = 'correct'), false)) AS agrees FROM g GROUP BY pipeline, verdict")
def verdict_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("pipeline"), F.when(F.col("text").rlike("[0-9]"), F.col("n_chars") > 400).alias("numbers_ok"))
    verdict = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit("correct")).when(F.col("quality") == 1, F.lit("partial")).otherwise(F.lit("wrong"))
    return reports.verdicts(table(spark, sf_dir, "labels").select("doc_id", verdict.alias("verdict")).join(d, "doc_id"))


@query(f"SELECT CAST(5 AS BIGINT) AS metrics, false AS passed, 'latency_p50_s, refused_ok' AS failed FROM {Fixture('x int', [(1,)]).sql}")
def gate_outcome(spark, sf_dir):
    """A metric that one run lacks is left out; one that fails is enough."""
    return reports.gate_outcome(statistics.regression_gate(BASE.df(spark), NOW.df(spark), RULES.df(spark)))


# ---- Behaviour and traces -------------------------------------------------------------------------------------------

_STEPS = "s AS (SELECT conv_id, turn, role, length(text) AS size FROM conversations)"


@query(f"WITH {_STEPS}, r AS (SELECT conv_id, count_if(role = 'assistant') AS calls, sum(CASE WHEN role <> 'assistant' THEN size END) AS tokens, sum((CASE WHEN role <> 'assistant' THEN size ELSE 0 END * 0.15 + CASE WHEN role = 'assistant' THEN size ELSE 0 END * 0.6) / 1e6) AS usd, count(*) AS turns, CAST(sum(size) AS DOUBLE) AS ms FROM s GROUP BY conv_id) SELECT turns, count(*) AS n, round(avg(calls), 6) AS calls, round(coalesce(avg(tokens), 0), 6) AS tokens, round(avg(usd), 6) AS usd, round(list_sort(list(ms))[len(list(ms)) // 2 + 1], 6) AS p50 FROM r GROUP BY turns")
def behaviour_costs(spark, sf_dir):
    """Conversations as runs, by their number of turns: what users say goes in, what the assistant says comes out."""
    said, size = F.col("role") == "assistant", F.length("text").cast("long")
    runs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.count_if(said).alias("llm_calls"), F.sum(F.when(~said, size)).alias("prompt_tokens"),
        F.sum(cost_usd(F.lit("gpt-4o-mini"), F.when(~said, size).otherwise(0), F.when(said, size).otherwise(0))).alias("cost_usd"), F.sum(size).cast("double").alias("latency_s"),
    )
    return reports.behaviour(runs, "turns")


@query(f"WITH s AS (SELECT conv_id, turn, count(*) OVER w AS step, sum(length(text)) OVER w AS used FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)), o AS (SELECT conv_id, CASE WHEN step >= 4 THEN 'max_steps' ELSE 'max_tokens' END AS reason FROM s WHERE step >= 4 OR used >= 900 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY step) = 1) SELECT coalesce(reason, 'answered') AS reason, count(*) AS runs FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN o USING (conv_id) GROUP BY ALL")
def stop_reasons(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("size"))
    return reports.stop_reasons(c, agent.budget_stop(c, "conv_id", "turn", "size", 4, 900), "conv_id")


@query(f"""WITH {_INDEX}, {_QUERIES}, h AS (SELECT r.qid, r.rank, t.source FROM ({_bm25(4)}) r JOIN t USING (doc_id)), c AS (SELECT h.*, (h.qid % 3 = 0 AND h.rank IN (1, 3)) OR (h.qid % 3 = 1 AND h.rank = 4) AS cited FROM h),
v AS (SELECT qid, count(*) AS n, string_agg(source, ', ' ORDER BY rank) AS every, string_agg(source, ', ' ORDER BY rank) FILTER (cited) AS some_ FROM c GROUP BY qid), sp AS (SELECT user_id AS qid, round(sum(k * 0.15 / 1e6), 9) AS cost_usd, CAST(sum(k) AS BIGINT) AS prompt_tokens, count_if(k > 0) AS llm_calls FROM (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY user_id)
SELECT q.qid AS run, coalesce(v.n, 0) AS n_evidence, coalesce(some_, every, '') AS passages, cost_usd, prompt_tokens, llm_calls FROM q LEFT JOIN v USING (qid) LEFT JOIN sp USING (qid)""")
def answer_runs(spark, sf_dir):
    """Answers that cite some, one or none of the passages found, with the cost of their traces; one number cited is of no passage."""
    q = _questions(spark, sf_dir)
    answer = F.when(F.col("qid") % 3 == 0, F.lit("Both say so [3][1], and [9].")).when(F.col("qid") % 3 == 1, F.lit("It is so [4], as [4] says.")).otherwise(F.lit("It is so."))
    hits = _bm25_top(spark, sf_dir, 4).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select(F.col("qid").alias("run"), F.col("rank").alias("n"), "source")
    k = F.get_json_object("props", "$.k").cast("long")
    spans = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), k.alias("input_tokens"), (k * 0.15 / 1e6).alias("cost_usd"))
    return reports.answer_runs(q.select(F.col("qid").alias("run"), answer.alias("answer")), hits, spans)


@query("SELECT 'batch' AS name, * FROM (SELECT 0 AS idx, 'tokens' AS stage, count(*) AS rows FROM documents UNION ALL SELECT 1, 'english', count(*) FROM documents WHERE lang = 'en' UNION ALL SELECT 2, 'none', 0)")
def trace_stages(spark, sf_dir):
    """Three stages of a batch, each written and counted on the way; their rows go to a day file and are read back."""
    path, trace = scratch(spark, "stages"), reports.Trace(spark, "t1", "batch")
    docs = trace.stage("tokens", table(spark, sf_dir, "documents").select("doc_id", "lang", T.tokens(F.col("text")).alias("toks")), f"{path}/tokens")
    english = trace.stage("english", docs.where("lang = 'en'"), f"{path}/english")
    trace.stage("none", english.where("lang = 'fr'"), f"{path}/none")
    readers.append_json_lines(trace.rows(), f"{path}/day.jsonl")
    return readers.read_json_lines(spark, f"{path}/day.jsonl", "name string, idx int, stage string, rows long")


@query(f"WITH x AS (SELECT role, length(text) / 4.0 AS estimate, len({tokens_sql('text')}) AS actual FROM conversations), e AS (SELECT *, (estimate - actual) / actual AS error FROM x WHERE actual > 0) SELECT role, count(*) AS n, round(list_sort(list(error))[len(list(error)) // 2 + 1], 6) AS error, round(min(error), 6) AS least, round(max(error), 6) AS most, list_sort(list(actual))[len(list(actual)) // 2 + 1] AS actual, round(quantile_cont(actual, 0.95), 6) AS p95, max(actual) AS longest FROM e GROUP BY role")
def estimate_errors(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("role", (F.length("text") / 4.0).alias("estimate"), F.size(T.tokens(F.col("text"))).cast("long").alias("actual"))
    return reports.estimate_errors(c, "role")


# ---- Golden items and relations -------------------------------------------------------------------------------------

GOLDEN = Fixture("item long, passage_id long, usable boolean, kind string, answer string, evidence string, text string, outcome string", [
    (1, 1, True, "numeric", "It was 416,161.", "net sales of $416,161 in 2025", "Apple had net  sales\nof $416,161 in 2025.", "kept"), (2, 2, False, "text", "x", "a quote that is long enough", "a quote that is long enough", "unusable"),
    (3, 3, True, "text", "x", "too short", "too short", "bad_evidence"), (4, 4, True, "text", "x", "a quote that is not in there", "another text altogether", "bad_evidence"), (5, 5, True, "numeric", "It was 17%.", "margin was 16% in that year", "The margin was 16% in that year.", "bad_numbers"),
    (6, 6, True, "numeric", "It rose.", "margin was 16% in that year", "The margin was 16% in that year.", "bad_numbers"), (7, 7, True, "text", "It rose.", "margin was 16% in that year", "The margin was 16% in that year.", "kept"), (8, 8, True, "text", None, None, None, "bad_evidence"),
])


@query(f"SELECT item, outcome FROM {GOLDEN.sql}")
def golden_outcomes(spark, sf_dir):
    g = GOLDEN.df(spark)
    return reports.golden_outcomes(g.drop("text", "outcome"), g.select("passage_id", "text"))


@query("SELECT doc_id AS item, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'unusable' WHEN length(quote) < 20 OR NOT contains(flat, quote) THEN 'bad_evidence' ELSE 'kept' END AS outcome FROM (SELECT doc_id, flat, trim(CASE lang WHEN 'en' THEN substr(flat, 31, 60) ELSE substr(flat, 31, 60) || ' zz' END) AS quote FROM (SELECT doc_id, lang, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents))")
def golden_evidence(spark, sf_dir):
    """A quote from every document, which is wrong outside English; documents labelled bad are not usable."""
    d = table(spark, sf_dir, "documents")
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    quote = F.substring(flat, 31, 60)
    bad = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct().withColumn("bad", F.lit(True))
    items = d.select("doc_id", F.when(F.col("lang") == "en", quote).otherwise(F.concat(quote, F.lit(" zz"))).alias("evidence")).join(bad, "doc_id", "left")
    items = items.select(F.col("doc_id").alias("item"), F.col("doc_id").alias("passage_id"), F.col("bad").isNull().alias("usable"), F.lit("text").alias("kind"), F.lit("x").alias("answer"), "evidence")
    return reports.golden_outcomes(items, d.select(F.col("doc_id").alias("passage_id"), "text"))


@query("WITH e AS (SELECT 's' || l_suppkey % 40 AS s, 's' || l_partkey % 40 AS o, l_returnflag AS source FROM lineitem WHERE l_suppkey % 40 <> l_partkey % 40), w AS (SELECT least(s, o) AS a, greatest(s, o) AS b, bool_or(s < o) AS f, bool_or(s > o) AS r FROM e GROUP BY ALL) SELECT DISTINCT a, b, CASE WHEN f AND r THEN 'both ways' WHEN f THEN a || ' names ' || b ELSE b || ' names ' || a END AS way, source FROM e JOIN w ON a = least(s, o) AND b = greatest(s, o)")
def mutual_sources(spark, sf_dir):
    name = lambda c: F.concat(F.lit("s"), (F.col(c) % 40).cast("string"))
    return graph.mutual_sources(table(spark, sf_dir, "lineitem").select(name("l_suppkey").alias("subject"), name("l_partkey").alias("object"), F.col("l_returnflag").alias("source")))
