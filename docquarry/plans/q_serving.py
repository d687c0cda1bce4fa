"""Queries of caches, limits, agents, sources, and question answering in batches."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.functions import text as T
from docquarry.operators import agent, sparse, vectors
from docquarry.plans.q_retrieval import _E, _INDEX, _QUERIES, _bm25, _questions
from docquarry.plans.q_text import _ASKED, QUESTIONS, asked, normalize_sql
from docquarry.plans.registry import Fixture, query, search_postings, table
from docquarry.session import scratch
from docquarry.sources import readers
from docquarry.streaming import folds

REQUESTS = Fixture("user_id string, seq int, t double, rpm double, allowed boolean, retry_after double", [
    ("a", 1, 0.0, 12.0, True, 0.0), ("a", 2, 0.1, 12.0, True, 0.0), ("a", 3, 0.2, 12.0, False, 4.8), ("a", 4, 5.2, 12.0, True, 0.0), ("a", 5, 6.0, 12.0, False, 4.0),
    ("slow", 1, 0.0, 2.0, True, 0.0), ("slow", 2, 1.0, 2.0, False, 29.0), ("slow", 3, 31.0, 2.0, True, 0.0),
])
SPENDS = Fixture("user_id string, seq int, day string, limit_usd double, estimate double, actual double, granted boolean, spent double", [
    ("u", 1, "d1", 1.0, 0.5, 0.3, True, 0.3), ("u", 2, "d1", 1.0, 0.7, 0.6, True, 0.9), ("u", 3, "d1", 1.0, 0.2, 0.1, False, 0.9), ("u", 4, "d2", 1.0, 0.2, 0.1, True, 0.1), ("v", 1, "d1", 0.1, 0.2, 0.1, False, 0.0),
])
CALLS = Fixture("name string, seq int, t double, failed boolean, state string", [
    ("embed", 1, 0.0, True, "closed"), ("embed", 2, 1.0, True, "closed"), ("embed", 3, 2.0, True, "closed"), ("embed", 4, 3.0, False, "open"), ("embed", 5, 40.0, True, "half_open"), ("embed", 6, 45.0, False, "open"), ("embed", 7, 80.0, False, "half_open"), ("embed", 8, 81.0, True, "closed"), ("plan", 1, 0.0, False, "closed"),
])
TOOL_CALLS = Fixture("run_id long, seq int, tool string, args string, query string, decision string", [
    (1, 1, "search", "{}", "apple net sales 2025", "admitted"), (1, 2, "search", "{}", "Apple net-sales, 2025", "repeat"), (1, 3, "search", "{}", "apple net sales 2025 total", "repeat"), (1, 4, "shell", "{}", "ls", "not allowed"), (1, 5, "search", "{}", "apple net sales of 2025 total", "admitted"),
    (1, 6, "search", "{\"year\": 2024}", "apple net sales 2025", "admitted"), (1, 7, "calculate", "{}", "1+1", "budget"), (2, 1, "calculate", "{}", "", "admitted"), (2, 2, "calculate", "{}", "", "repeat"),
])


#: Events as requests: their order among those of a user, and hours since the first day, which stand for seconds.
_EVENTS = "e AS (SELECT 'user' || user_id AS user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS seq, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 3600000000.0 AS t, user_id % 3 AS kind, event_type, value, strftime(ts, '%Y-%m-%d') AS day, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    since = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01 00:00:00").cast(e.schema["ts"].dataType), F.col("ts"))
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("user_id"), seq.alias("seq"), (since / 3600000000.0).alias("t"), (F.col("user_id") % 3).alias("kind"), "event_type", "value", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(f"""WITH RECURSIVE {_EVENTS}, r AS (SELECT user_id, seq, t, CASE WHEN kind = 0 THEN 2.0::DOUBLE ELSE 12.0::DOUBLE END AS rpm FROM e),
b AS (SELECT user_id, seq, t, rpm, greatest(1.0::DOUBLE, rpm / 6) AS was FROM r WHERE seq = 1
UNION ALL SELECT r.user_id, r.seq, r.t, r.rpm, least(greatest(1.0::DOUBLE, r.rpm / 6), b.was - CASE WHEN b.was >= 1 THEN 1 ELSE 0 END + (r.t - b.t) * (r.rpm / 60)) FROM b JOIN r ON r.user_id = b.user_id AND r.seq = b.seq + 1)
SELECT user_id, seq, was >= 1 AS allowed, round(CASE WHEN was >= 1 THEN 0.0 ELSE (1 - was) / (rpm / 60) END, 6) AS retry_after FROM b UNION ALL SELECT user_id, seq, allowed, round(retry_after, 6) FROM {REQUESTS.sql}""")
def token_bucket(spark, sf_dir):
    """The fixed requests, and every event as a request of its user."""
    requests = _events(spark, sf_dir).select("user_id", "seq", "t", F.when(F.col("kind") == 0, 2.0).otherwise(12.0).alias("rpm"))
    return folds.run(REQUESTS.df(spark).drop("allowed", "retry_after").unionByName(requests), folds.token_bucket(), "user_id", ["seq"]).select("user_id", "seq", "allowed", F.round("retry_after", 6).alias("retry_after"))


@query(f"""WITH RECURSIVE {_EVENTS}, r AS (SELECT user_id, seq, day, CAST(value AS DOUBLE) AS estimate, value * (k % 3) AS actual FROM e),
b AS (SELECT user_id, seq, day, 0.0 + estimate <= 60 + 1e-12 AS granted, CASE WHEN 0.0 + estimate <= 60 + 1e-12 THEN actual ELSE 0.0 END AS spent FROM r WHERE seq = 1
UNION ALL SELECT r.user_id, r.seq, r.day, x.old + r.estimate <= 60 + 1e-12, x.old + CASE WHEN x.old + r.estimate <= 60 + 1e-12 THEN r.actual ELSE 0.0 END FROM b JOIN r ON r.user_id = b.user_id AND r.seq = b.seq + 1, LATERAL (SELECT CASE WHEN r.day = b.day THEN b.spent ELSE 0.0::DOUBLE END AS old) x)
SELECT user_id, seq, granted, round(spent, 6) AS spent FROM b UNION ALL SELECT user_id, seq, granted, spent FROM {SPENDS.sql}""")
def spend_limit(spark, sf_dir):
    """The fixed requests, and every event as one that may cost its value."""
    wanted = _events(spark, sf_dir).select("user_id", "seq", "day", F.lit(60.0).alias("limit_usd"), F.col("value").alias("estimate"), (F.col("value") * (F.col("k") % 3)).alias("actual"))
    return folds.run(SPENDS.df(spark).drop("granted", "spent").unionByName(wanted), folds.spend_limit(), "user_id", ["seq"]).select("user_id", "seq", "granted", F.round("spent", 6).alias("spent"))


_OUT = "CASE WHEN opened IS NULL THEN 'closed' WHEN t - opened >= 30 THEN 'half_open' ELSE 'open' END"


@query(f"""WITH RECURSIVE {_EVENTS}, r AS (SELECT user_id AS name, seq, t, event_type IN ('error', 'click') AS failed FROM e),
b AS (SELECT name, seq, 'closed' AS state, CASE WHEN failed THEN 1 ELSE 0 END AS failures, CAST(NULL AS DOUBLE) AS opened FROM r WHERE seq = 1
UNION ALL SELECT name, seq, state, CASE WHEN state = 'open' THEN failures WHEN failed THEN failures + 1 ELSE 0 END, CASE WHEN state = 'open' THEN opened WHEN NOT failed THEN NULL WHEN failures + 1 >= 3 OR opened IS NOT NULL THEN t END
FROM (SELECT r.name, r.seq, r.t, r.failed, b.failures, b.opened, {_OUT.replace('opened', 'b.opened').replace('t -', 'r.t -')} AS state FROM b JOIN r ON r.name = b.name AND r.seq = b.seq + 1))
SELECT name, seq, state, state <> 'open' AS allowed FROM b UNION ALL SELECT name, seq, state, state <> 'open' FROM {CALLS.sql}""")
def circuit_breaker(spark, sf_dir):
    """The fixed calls, and every user's events as calls of a service of its own, errors and clicks failing."""
    calls = _events(spark, sf_dir).select(F.col("user_id").alias("name"), "seq", "t", F.col("event_type").isin("error", "click").alias("failed"))
    return folds.run(CALLS.df(spark).drop("state").unionByName(calls), folds.circuit_breaker(), "name", ["seq"]).select("name", "seq", "state", "allowed")


_CALL_WORDS = "list_sort(list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')))"


@query(f"""WITH RECURSIVE c AS (SELECT conv_id + 1000 AS run_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS seq, ['search', 'calculate', 'shell'][turn % 3 + 1] AS tool, CASE WHEN conv_id % 2 = 0 THEN first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) ELSE text END AS query FROM conversations),
w AS (SELECT run_id, seq, tool, {_CALL_WORDS} AS words FROM c),
b AS (SELECT DISTINCT run_id, 0 AS seq, CAST([] AS STRUCT(k VARCHAR, w VARCHAR[])[]) AS seen, '' AS decision FROM w
UNION ALL SELECT run_id, seq, CASE WHEN d = 'admitted' THEN list_append(seen, {{'k': tool, 'w': words}}) ELSE seen END, d
FROM (SELECT w.run_id, w.seq, w.tool, w.words, b.seen, CASE WHEN w.tool = 'shell' THEN 'not allowed' WHEN len(b.seen) >= 3 THEN 'budget' WHEN len(list_filter(b.seen, lambda s: s.k = w.tool AND (s.w = w.words OR (len(s.w) > 0 AND len(w.words) > 0 AND len(list_intersect(s.w, w.words)) / (len(s.w) + len(w.words) - len(list_intersect(s.w, w.words))) >= 0.8)))) > 0 THEN 'repeat' ELSE 'admitted' END AS d
FROM b JOIN w ON w.run_id = b.run_id AND w.seq = b.seq + 1))
SELECT run_id, seq, decision FROM b WHERE seq > 0 UNION ALL SELECT run_id, seq, decision FROM {TOOL_CALLS.sql}""")
def tool_admission(spark, sf_dir):
    """The fixed calls, and every conversation's turns as the calls of a run."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumns({"seq": F.row_number().over(w), "first": F.first("text").over(w)})
    tool = F.get(F.array(*map(F.lit, ("search", "calculate", "shell"))), (F.col("turn") % 3).cast("int"))
    turns = c.select((F.col("conv_id") + 1000).alias("run_id"), "seq", tool.alias("tool"), F.lit("{}").alias("args"), F.when(F.col("conv_id") % 2 == 0, F.col("first")).otherwise(F.col("text")).alias("query"))
    return folds.run(TOOL_CALLS.df(spark).drop("decision").unionByName(turns), folds.admission(["search", "calculate"], 3), "run_id", ["seq"]).select("run_id", "seq", "decision")


@query("SELECT user_id, count(*) AS requests, count_if(before IS NOT NULL AND date_diff('microsecond', before, ts) <= 86400000000) AS hits FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events) GROUP BY user_id")
def exact_cache_ttl(spark, sf_dir):
    """A request hits if the one before it with its key is at most a day old (refreshing cache)."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "ts", F.lag("ts").over(w).alias("before"))
    age = F.timestamp_diff("MICROSECOND", F.col("before"), F.col("ts"))
    return e.groupBy("user_id").agg(F.count("*").alias("requests"), F.count_if(F.col("before").isNotNull() & (age <= 86_400_000_000)).alias("hits"))


@query(f"SELECT qid, sha256('v1|AAPL,MSFT|' || {normalize_sql('question')}) AS key FROM {_ASKED}")
def cache_keys(spark, sf_dir):
    return asked(spark, sf_dir).select("qid", F.sha2(F.concat(F.lit("v1|AAPL,MSFT|"), T.normalize_question(F.col("question"))), 256).alias("key"))


_SEMANTIC = f"{_E}, p AS (SELECT eq.qid, e.vec_id, round(list_dot_product(eq.qvec, e.v), 6) AS score, row_number() OVER (PARTITION BY eq.qid ORDER BY round(list_dot_product(eq.qvec, e.v), 6) DESC, e.vec_id) AS r FROM eq JOIN e ON e.label = eq.label AND e.vec_id < eq.qid)"


def _semantic(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "label", F.col("embedding").alias("qvec"))
    return vectors.exact_search(e, q, 1, group="label", earlier=True)


@query(f"WITH {_SEMANTIC} SELECT qid, vec_id, score, score >= 0.5 AS hit FROM p WHERE r = 1")
def semantic_cache(spark, sf_dir):
    return _semantic(spark, sf_dir).select("qid", "vec_id", "score", (F.col("score") >= 0.5).alias("hit"))


@query(f"WITH {_SEMANTIC} SELECT CAST(threshold AS DOUBLE) AS threshold, count_if(score >= threshold) AS hits, count_if(score >= threshold AND vec_id % 2 = 0) AS right_hits, round(count_if(score >= threshold) / count(*), 6) AS rate FROM p, (VALUES (0.2), (0.4), (0.6), (0.8)) AS _t(threshold) WHERE r = 1 GROUP BY threshold")
def cache_threshold_sweep(spark, sf_dir):
    t = spark.createDataFrame([(0.2,), (0.4,), (0.6,), (0.8,)], "threshold double")
    hit = F.col("score") >= F.col("threshold")
    return _semantic(spark, sf_dir).crossJoin(F.broadcast(t)).groupBy("threshold").agg(F.count_if(hit).alias("hits"), F.count_if(hit & (F.col("vec_id") % 2 == 0)).alias("right_hits"), F.round(F.count_if(hit) / F.count("*"), 6).alias("rate"))


@query("SELECT event_type, count_if(k >= 10 AND value < 80 AND event_type <> 'error') AS stored, count(*) AS answers FROM (SELECT event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type")
def cache_admission(spark, sf_dir):
    """Only answers that passed, were not degraded and not refused are stored."""
    k = F.get_json_object("props", "$.k").cast("long")
    ok = (k >= 10) & (F.col("value") < 80) & (F.col("event_type") != "error")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(ok).alias("stored"), F.count("*").alias("answers"))


_NEAR_WORDS = "list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+'))"


@query(f"SELECT conv_id, turn, len(list_intersect(a, b)) / greatest(len(list_distinct(a || b)), 1) >= 0.8 OR len(list_distinct(a || b)) = 0 AS repeated FROM (SELECT conv_id, turn, {_NEAR_WORDS.format(c='text')} AS a, {_NEAR_WORDS.format(c='lag(text) OVER (PARTITION BY conv_id ORDER BY turn)')} AS b, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS NOT NULL")
def near_duplicate_turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before IS NOT NULL")
    return c.select("conv_id", "turn", (T.jaccard(T.word_set(F.col("text")), T.word_set(F.col("before"))) >= 0.8).alias("repeated"))


@query("WITH s AS (SELECT conv_id, turn, count(*) OVER w AS step, CAST(sum(length(text)) OVER w AS BIGINT) AS used FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) SELECT conv_id, step, CASE WHEN step >= 4 THEN 'max_steps' ELSE 'max_tokens' END AS reason, used AS tokens FROM s WHERE step >= 4 OR used >= 900 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY step) = 1")
def budget_stop(spark, sf_dir):
    return agent.budget_stop(table(spark, sf_dir, "conversations").withColumn("size", F.length("text").cast("long")), "conv_id", "turn", "size", 4, 900)


@query("WITH f AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, min(event_id) AS first FROM events GROUP BY ALL) SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY first, k) AS n FROM f")
def evidence_numbering(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.lit(0).alias("place"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    return agent.numbered_evidence(e, "user_id", "event_id", "place", "k")


@query(f"WITH {_INDEX}, {_QUERIES}, r AS ({_bm25(12)}), g AS (SELECT qid // 2 AS qid, qid % 2 AS sub, doc_id, doc_id % 3 AS grade, rank FROM r), o AS (SELECT * FROM g WHERE grade > 0 QUALIFY row_number() OVER (PARTITION BY qid, doc_id ORDER BY sub, rank) = 1), k AS (SELECT *, row_number() OVER (PARTITION BY qid, sub ORDER BY grade DESC, rank, doc_id) AS k FROM o QUALIFY k <= 4) SELECT qid, sub, doc_id, grade, rank, row_number() OVER (PARTITION BY qid ORDER BY sub, k) AS position FROM k")
def crag_passage_order(spark, sf_dir):
    hits = sparse.search(search_postings(spark, sf_dir), sparse.query_terms(_questions(spark, sf_dir)), 12)
    graded = hits.select(F.floor(F.col("qid") / 2).alias("qid"), (F.col("qid") % 2).alias("sub"), "doc_id", (F.col("doc_id") % 3).alias("grade"), "rank")
    return agent.passage_order(graded)


@query(None)
def corrective_retrieval(spark, sf_dir):
    return agent.corrective_retrieval(_questions(spark, sf_dir), search_postings(spark, sf_dir))


@query(None)
def ask_batch(spark, sf_dir):
    return agent.answer_batch(_questions(spark, sf_dir).unionByName(QUESTIONS.df(spark).select((F.col("qid") + 10_000).alias("qid"), "question")), table(spark, sf_dir, "documents"), index=search_postings(spark, sf_dir))


@query(None)
def ask_events(spark, sf_dir):
    return agent.answer_events(ask_batch(spark, sf_dir))


FILINGS = Fixture("id long, cik string, form string, filed string, period_end string", [(1, "a", "10-K", "2025-10-31", "2025-09-27"), (2, "a", "10-K/A", "2025-11-15", "2025-09-27"), (3, "a", "10-K", "2024-11-01", "2024-09-28"), (4, "a", "10-K", "2023-11-03", "2023-09-30"), (5, "b", "10-Q", "2025-05-01", "2025-03-31"), (6, "b", "10-K", "2025-01-30", "2024-12-31")])


@query(f"SELECT id, cik, place, CAST(fiscal_year AS INTEGER) AS fiscal_year FROM (SELECT *, year(CAST(period_end AS DATE)) AS fiscal_year, row_number() OVER (PARTITION BY cik ORDER BY filed DESC, id DESC) AS place FROM (SELECT * FROM {FILINGS.sql} UNION ALL SELECT o_orderkey + 1000, 'c' || o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN '10-Q' ELSE '10-K' END, strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate - INTERVAL 40 DAY, '%Y-%m-%d') FROM orders) WHERE form = '10-K') WHERE place <= 2")
def latest_filings(spark, sf_dir):
    """The fixed filings, and every order as one of its customer."""
    date = lambda c: F.date_format(c, "yyyy-MM-dd")
    orders = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1000).alias("id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("cik"), F.when(F.col("o_orderkey") % 4 == 0, F.lit("10-Q")).otherwise(F.lit("10-K")).alias("form"), date("o_orderdate").alias("filed"), date(F.date_sub("o_orderdate", 40)).alias("period_end"))
    return readers.latest_filings(FILINGS.df(spark).unionByName(orders), "cik", "filed", 2).select("id", "cik", "place", "fiscal_year")


@query("SELECT source, list_aggregate(list_sort(list_distinct(list(doc_id % 9 + 2017))), 'string_agg', ',') AS years FROM documents GROUP BY source")
def filing_catalog(spark, sf_dir):
    years = F.array_sort(F.collect_set(F.col("doc_id") % 9 + 2017))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.array_join(years.cast("array<string>"), ",").alias("years"))


_NS = readers.NAMESPACE.hex


@query(f"WITH h AS (SELECT vec_id, sha1(unhex('{_NS}') || encode(CAST(vec_id AS VARCHAR))) AS h FROM embeddings) SELECT vec_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', CAST('0x' || h[17] AS INTEGER) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS point_id FROM h")
def point_ids(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", readers.point_id(F.col("vec_id")).alias("point_id"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def windowed_latency(spark, sf_dir):
    found = folds.windowed_latency(table(spark, sf_dir, "events"))
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT doc_id, CASE WHEN n_chars % 5 = 0 THEN 'withheld' WHEN n_chars % 5 = 1 THEN 'sent, then marked' ELSE 'sent' END AS outcome FROM documents")
def guardrail_mode(spark, sf_dir):
    """Buffered answers that fail are withheld; answers sent as written are marked afterwards."""
    fails, buffered = F.col("n_chars") % 5 < 2, F.col("n_chars") % 5 == 0
    return table(spark, sf_dir, "documents").select("doc_id", F.when(fails & buffered, F.lit("withheld")).when(fails, F.lit("sent, then marked")).otherwise(F.lit("sent")).alias("outcome"))


@query("SELECT source || ' 10-K FY' || (2000 + doc_id % 25) || ', ' || lang AS line, doc_id, substr(text, 1, 1800) AS passage FROM documents")
def source_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.format_string("%s 10-K FY%d, %s", "source", 2000 + F.col("doc_id") % 25, "lang").alias("line"), "doc_id", F.substring("text", 1, 1800).alias("passage"))


MULTIHOP = Fixture("id long, evidence array<string>", [(1, ["AAPL_FY2025_Item7_001", "MSFT_FY2024_Item8_002", "AAPL_FY2024_Item1_000"]), (2, ["NVDA_FY2025_Item1A_010"])])


@query(f"SELECT id, list_aggregate(list_sort(list_distinct(list_transform(evidence, lambda e: string_split(e, '_')[1]))), 'string_agg', ',') AS tickers FROM {MULTIHOP.sql}")
def multihop_tickers(spark, sf_dir):
    return MULTIHOP.df(spark).select("id", F.array_join(F.array_sort(F.array_distinct(F.transform("evidence", lambda e: F.substring_index(e, "_", 1)))), ",").alias("tickers"))


@query("SELECT role, count_if(t.turn IS NOT NULL) AS with_before, count(*) AS n, round(avg(length(c.text) / 4.0), 6) AS estimate, round(quantile_cont(length(c.text), 0.95), 6) AS p95 FROM conversations c LEFT JOIN (SELECT conv_id, turn + 1 AS turn FROM conversations) t USING (conv_id, turn) GROUP BY role")
def token_estimates(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("size"))
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("had"))
    return c.join(before, ["conv_id", "turn"], "left").groupBy("role").agg(F.count_if(F.col("had").isNotNull()).alias("with_before"), F.count("*").alias("n"), F.round(F.avg(F.col("size") / 4.0), 6).alias("estimate"), F.round(F.percentile("size", F.lit(0.95)), 6).alias("p95"))


# ---- Sources and sinks ---------------------------------------------------------------------------------------------


@query("SELECT 'd' || doc_id AS id, md5(text) AS text, source AS section, CAST(n_chars % 9 + 2017 AS INTEGER) AS fiscal_year FROM documents")
def source_json_lines(spark, sf_dir):
    """Every document through a JSON-lines sink and back, by the schema of chunk rows."""
    path, year = scratch(spark, "chunks"), (F.col("n_chars") % 9 + 2017).cast("int")
    readers.append_json_lines(table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text", year.alias("fiscal_year"), F.col("source").alias("section")), path)
    return readers.read_json_lines(spark, path, readers.CHUNK).select("id", F.md5(F.col("text").cast("binary")).alias("text"), "section", "fiscal_year")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def source_json_array(spark, sf_dir):
    path = scratch(spark, "nations")
    readers.write_json_array(table(spark, sf_dir, "nation"), path)
    return readers.read_json_array(spark, path, "n_nationkey long, n_name string, n_regionkey long")


@query("SELECT event_type AS name, count(*) AS traces, count(DISTINCT CAST(ts AS DATE)) AS days, round(sum(value), 4) AS total FROM events WHERE event_type = 'click' GROUP BY event_type")
def source_traces(spark, sf_dir):
    """Events as day files of traces, read by name."""
    folder = scratch(spark, "traces")
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("trace_id"), F.col("event_type").alias("name"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("started_at"), F.col("value").alias("duration_ms"))
    for part in (0, 1):  # two runs append to their own files
        readers.append_json_lines(e.where(F.pmod(F.col("trace_id").cast("long"), F.lit(2)) == part), f"{folder}/part-{part}.jsonl")
    t = readers.read_traces(spark, folder, "click")
    return t.groupBy("name").agg(F.count("*").alias("traces"), F.count_distinct(F.to_date("started_at")).alias("days"), F.round(F.sum("duration_ms"), 4).alias("total"))


@query("SELECT 2 * count(*) AS appended, count(*) AS replaced, count(*) AS migrated, count(*) AS again, count(DISTINCT vec_id) AS ids FROM embeddings")
def source_vectors(spark, sf_dir):
    """A vector store that is extended, replaced, and moved to another one twice."""
    e, path, other = table(spark, sf_dir, "embeddings"), scratch(spark, "store"), scratch(spark, "other")
    readers.write_vectors(e, path, "vec_id")
    appended = readers.write_vectors(e, path, "vec_id", reset=False)
    replaced = readers.write_vectors(e, path, "vec_id")
    migrated, again = (readers.migrate_vectors(spark, path, other, "vec_id") for _ in range(2))
    counts = spark.createDataFrame([(appended, replaced, migrated, again)], "appended long, replaced long, migrated long, again long")
    return counts.crossJoin(F.broadcast(spark.read.parquet(other).agg(F.count_distinct("point_id").alias("ids"))))


@query("SELECT lang, 2 * count(*) AS rows FROM documents GROUP BY lang")
def source_append(spark, sf_dir):
    path, rows = scratch(spark, "log"), table(spark, sf_dir, "documents").select("doc_id", "lang")
    for _ in range(2):
        readers.append_json_lines(rows, path)
    return readers.read_json_lines(spark, path, "doc_id long, lang string").groupBy("lang").agg(F.count("*").alias("rows"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def source_stream(spark, sf_dir):
    """Events streamed to day files, a restart that finds nothing new, and its batch once more: every event is there once."""
    folder, events = scratch(spark, "stream"), table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select("event_id", "ts", "event_type", "value")
    for _ in range(2):
        readers.stream_day_files(stream, f"{folder}/days", f"{folder}/checkpoint")
    readers.write_batch(f"{folder}/days", "ts", events.select("event_id", "ts", "event_type", "value"), 0)  # one file is one batch
    return readers.read_day_files(spark, f"{folder}/days", "event_id long, event_type string, value double").groupBy("day", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


BUDGETS = Fixture("run_id long, seq int, size long, usd double, repeated boolean", [
    (1, 1, 10, 0.1, False), (1, 2, 10, 0.1, True), (1, 3, 99, 0.9, True), (2, 1, 10, 0.1, False), (2, 2, 10, 0.1, False), (2, 3, 10, 0.1, False), (2, 4, 10, 0.1, False), (3, 1, 60, 0.1, False), (3, 2, 60, 0.9, False), (4, 1, 5, 0.6, False), (4, 2, 5, 0.4, False), (5, 1, 1, 0.0, False),
])


@query(f"""SELECT * FROM {Fixture('run_id long, step long, reason string, tokens long', [(1, 3, 'loop', 119), (2, 4, 'max_steps', 40), (3, 2, 'max_tokens', 120), (4, 2, 'max_cost', 10)]).sql} UNION ALL SELECT run_id, step, reason, tokens FROM (
SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step) AS r FROM (SELECT run_id, step, tokens, CASE WHEN repeats >= 2 THEN 'loop' WHEN step >= 4 THEN 'max_steps' WHEN tokens >= 100 THEN 'max_tokens' WHEN cost >= 1000 THEN 'max_cost' END AS reason
FROM (SELECT run_id, row_number() OVER w AS step, CAST(sum(size) OVER w AS BIGINT) AS tokens, sum(usd) OVER w AS cost, count_if(again) OVER w AS repeats FROM (SELECT conv_id + 1000 AS run_id, turn, length(text) // 12 AS size, length(text) AS usd, length(text) % 5 = 0 AS again FROM conversations) WINDOW w AS (PARTITION BY run_id ORDER BY turn ROWS UNBOUNDED PRECEDING))) WHERE reason IS NOT NULL) WHERE r = 1""")
def budget_limits(spark, sf_dir):
    """Each limit by itself, and loops before all others."""
    size = F.length("text")
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") + 1000).alias("run_id"), F.col("turn").cast("int").alias("seq"), F.floor(size / 12).cast("long").alias("size"), (size / 1000.0).cast("double").alias("usd"), (size % 5 == 0).alias("repeated"))
    return agent.budget_stop(BUDGETS.df(spark).unionByName(turns), "run_id", "seq", "size", 4, 100, "usd", 1.0, "repeated", 2)


CACHED = Fixture("scope string, seq int, signature string, vector array<double>, item string, hit_item string, similarity double", [
    ("a", 1, "s", [1.0, 0.0], "q1", None, None), ("a", 2, "s", [0.96, 0.28], "q2", "q1", 0.96), ("a", 3, "t", [1.0, 0.0], "q3", None, None), ("a", 4, "s", [0.0, 1.0], "q4", None, None), ("a", 5, "s", [1.0, 0.0], "q5", None, None), ("a", 6, "s", [1.0, 0.0], "q6", "q5", 1.0),
    ("b", 1, "s", [1.0, 0.0], "r1", None, None), ("b", 2, "s", [0.6, 0.8], "r2", None, None), ("b", 3, "s", [0.6, 0.8], "r3", "r2", 1.0),
])


@query(f"SELECT scope, seq, hit_item, similarity FROM {CACHED.sql}")
def scoped_semantic_cache(spark, sf_dir):
    """Scope, signature, threshold 0.95, and two places: the first question of scope a has gone when it is asked again."""
    return folds.run(CACHED.df(spark).drop("hit_item", "similarity"), folds.semantic_cache(most=2), "scope", ["seq"]).select("scope", "seq", "hit_item", "similarity")
