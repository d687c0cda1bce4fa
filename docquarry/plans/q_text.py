"""Queries of text functions, filters and planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.operators import planning as P
from docquarry.plans.registry import Fixture, query, table

QUESTIONS = Fixture("qid long, question string", [
    (1, "What was Apple’s revenue in FY2025?"), (2, "How did Azure grow in fiscal year 2024 compared with AWS?"), (3, "In 2023, what were NVIDIA's risk factors?"),
    (4, "Should I buy the stock of Tesla now?"), (5, "Which of the five companies spent most on R&D, i.e. 12.5% or more?"), (6, "Latest headcount at Microsoft vs. previous fiscal 2023."),
    (7, "What is the capital of France?"), (8, "pineapple sales. Prior results at Amazon: FY 2024, FY2024"), (9, "Compare capex and buybacks of Apple, Amazon and Tesla revenue in 2024"), (10, ""),
])
#: Questions made of test items: wording about companies and years around each item's text.
_TEMPLATES = ["What was Apple’s {} in FY2024?", "How did Azure grow in fiscal year 2023 compared with AWS? {}", "Should I buy the stock of Tesla? {}", "Which of the five companies spent most on R&D in 2025? {}", "Compare capex of Apple, Amazon and NVIDIA in 2024. {}", "{}"]
_ASKED = f"(SELECT qid, question FROM {QUESTIONS.sql} UNION ALL SELECT item_id + 1000, replace({_TEMPLATES}[item_id % 6 + 1], '{{}}', text) FROM benchmark)"


def asked(spark, sf_dir):
    """The fixed questions, and one for each test item."""
    template = F.get(F.array(*map(F.lit, _TEMPLATES)), (F.col("item_id") % 6).cast("int"))
    items = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1000).alias("qid"), F.replace(template, F.lit("{}"), F.col("text")).alias("question"))
    return QUESTIONS.df(spark).unionByName(items)


CATALOG = {"AAPL": [2024, 2025], "AMZN": [2023, 2024], "MSFT": [2024, 2025], "NVDA": [2025], "TSLA": [2023, 2024]}
CATALOG_FIXTURE = Fixture("ticker string, catalog array<int>", sorted(CATALOG.items()))
USERS = Fixture("user_id string, allowed array<string>", [("all", ["AAPL", "AMZN", "MSFT", "NVDA", "TSLA"]), ("apple", ["AAPL"]), ("two", ["MSFT", "NVDA"]), ("none", [])])

_STOPS = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_QSTOPS = "[" + ", ".join(f"'{w}'" for w in T.QUESTION_STOP_WORDS) + "]"


def tokens_sql(c: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(lower(replace({c}, '’', '''')), '[a-z0-9]+(?:[.,\\-''][a-z0-9]+)*'), lambda t: regexp_replace(t, '''s$', '')), lambda t: NOT list_contains({_STOPS}, t))"


def normalize_sql(c: str) -> str:
    q = f"regexp_replace(lower(replace({c}, '’', '''')), '\\b(?:fy\\s?|fiscal\\s+(?:year\\s+)?)(20\\d\\d)\\b', 'fiscal \\1', 'g')"
    q = f"regexp_replace({q}, '[^\\p{{L}}\\p{{N}}_\\s%$.'']', ' ', 'g')"
    for _ in range(2):
        q = f"regexp_replace({q}, '([0-9])\\.([0-9])', '\\1¤\\2', 'g')"
    return f"trim(regexp_replace(replace(replace({q}, '.', ' '), '¤', '.'), '\\s+', ' ', 'g'))"


def tickers_sql(c: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower({c}), '\\b(?:{'|'.join(n)})\\b') THEN '{t}' END" for t, n in T.ALIASES.items()) + "], lambda t: t IS NOT NULL)"


def years_sql(c: str) -> str:
    return f"list_sort(list_distinct(list_transform(regexp_extract_all({c}, '\\b(20\\d\\d)\\b', 1), lambda y: CAST(y AS INTEGER))))"


_FY_SQL = "list_sort(list_distinct(list_transform(regexp_extract_all(question, '(?i)\\b(?:fy\\s?|fiscal\\s+(?:year\\s+)?)''?(20\\d\\d)\\b', 1), lambda y: CAST(y AS INTEGER))))"


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)")
def tokenize_docs(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


@query(f"SELECT qid, {normalize_sql('question')} AS normal FROM {QUESTIONS.sql} UNION ALL SELECT item_id + 1000, {normalize_sql('text')} FROM benchmark")
def normalize_question(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1000).alias("qid"), F.col("text").alias("question"))
    return QUESTIONS.df(spark).unionByName(items).select("qid", T.normalize_question(F.col("question")).alias("normal"))


_TEMPORAL_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.TEMPORAL.items()) + "}"


@query(f"""SELECT qid, array_to_string({tickers_sql('question')}, ',') AS tickers, array_to_string({years_sql(normalize_sql('question'))}, ',') AS years,
array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({normalize_sql('question')}, '[a-z]+'), lambda w: {_TEMPORAL_SQL}[w]), lambda x: x IS NOT NULL))), ',') AS times FROM {_ASKED}""")
def entity_signature(spark, sf_dir):
    q = F.col("question")
    return asked(spark, sf_dir).select("qid", F.array_join(T.tickers(q), ",").alias("tickers"), F.array_join(T.years(T.normalize_question(q)).cast("array<string>"), ",").alias("years"), F.array_join(T.temporal_words(q), ",").alias("times"))


@query(f"""SELECT conv_id, turn, round(CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(a) END, 6) AS overlap,
round(CASE WHEN len(list_distinct(a || b)) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b)) END, 6) AS jaccard
FROM (SELECT conv_id, turn, list_distinct({tokens_sql('text')}) AS a, list_distinct({tokens_sql('lag(text) OVER (PARTITION BY conv_id ORDER BY turn)')}) AS b, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS NOT NULL""")
def lexical_overlap(spark, sf_dir):
    from pyspark.sql.window import Window

    c = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before IS NOT NULL")
    a, b = F.array_distinct(T.tokens(F.col("text"))), F.array_distinct(T.tokens(F.col("before")))
    c = c.select("conv_id", "turn", a.alias("a"), b.alias("b"))
    return c.select("conv_id", "turn", F.round(T.coverage(F.col("a"), F.col("b")), 6).alias("overlap"), F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query(f"""SELECT item_id, CAST(len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')), lambda w: NOT list_contains({_QSTOPS}, w))) AS BIGINT) AS question_words,
CAST(len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS BIGINT) AS plain_words FROM benchmark""")
def word_sets(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(T.question_words(c)).cast("long").alias("question_words"), F.size(T.word_set(c)).cast("long").alias("plain_words"))


@query("SELECT source, lang, count(*) AS n, sum(n_chars) AS chars FROM documents WHERE source IN ('src1', 'src2', 'src3') AND lang IN ('en', 'fr') GROUP BY ALL")
def metadata_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(P.metadata_predicate({"source": ["src1", "src2", "src3"], "lang": ["en", "fr"]}))
    return docs.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").cast("decimal(38,0)").alias("chars"))


@query(f"SELECT qid, array_to_string({tickers_sql('question')}, ',') AS tickers, array_to_string({_FY_SQL}, ',') AS fiscal_years FROM {_ASKED}")
def extract_filters(spark, sf_dir):
    q = F.col("question")
    return asked(spark, sf_dir).select("qid", F.array_join(T.tickers(q), ",").alias("tickers"), F.array_join(T.fiscal_years(q).cast("array<string>"), ",").alias("fiscal_years"))


@query(f"""SELECT user_id, qid, CASE WHEN len(want) > 0 AND len(want) < 5 THEN array_to_string(list_sort(want), ',') END AS tickers, len(want) = 0 AS refused FROM
(SELECT user_id, qid, list_filter(CASE WHEN len(asked) = 0 THEN allowed ELSE asked END, lambda t: list_contains(allowed, t)) AS want FROM (SELECT u.user_id, u.allowed, q.qid, {tickers_sql('q.question')} AS asked FROM {USERS.sql} u, {_ASKED} q))""")
def scoped_filter(spark, sf_dir):
    pairs = USERS.df(spark).crossJoin(F.broadcast(asked(spark, sf_dir))).withColumn("asked", T.tickers(F.col("question")))
    return P.scoped_filter(pairs, list(T.ALIASES)).select("user_id", "qid", F.array_join("tickers", ",").alias("tickers"), "refused")


@query(f"""SELECT user_id, count(*) AS foreign_rows, min(vec_id) AS first_id FROM (SELECT u.user_id, e.vec_id FROM {USERS.sql} u, embeddings e
WHERE NOT list_contains(u.allowed, ['AAPL', 'AMZN', 'MSFT', 'NVDA', 'TSLA'][e.label % 5 + 1])) GROUP BY user_id""")
def access_violations(spark, sf_dir):
    names = F.array(*map(F.lit, ["AAPL", "AMZN", "MSFT", "NVDA", "TSLA"]))
    hits = table(spark, sf_dir, "embeddings").select("vec_id", F.element_at(names, F.col("label") % 5 + 1).alias("ticker")).crossJoin(F.broadcast(USERS.df(spark)))
    return P.violations(hits).groupBy("user_id").agg(F.count("*").alias("foreign_rows"), F.min("vec_id").alias("first_id"))


def _expand_sql(text: str, ticker: str) -> str:
    extra = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({text}, '(?i){p}') AND NOT contains(lower({text}), '{term}')" + (f" AND coalesce({ticker} = '{who}', false)" if who else "") + f" THEN '{term}' END" for who, p, term in T.VOCABULARY) + "], lambda t: t IS NOT NULL)"
    return f"CASE WHEN len({extra}) > 0 THEN {text} || ' (' || array_to_string({extra}, ', ') || ')' ELSE {text} END"


_SUBS = f"""SELECT q.qid, t.ticker, c.catalog, q.n, CASE WHEN q.n > 1 THEN t.ticker || ': ' || q.question ELSE q.question END AS text, q.question
FROM (SELECT qid, question, {tickers_sql('question')} AS ts, len({tickers_sql('question')}) AS n FROM {_ASKED}) q, unnest(CASE WHEN q.n = 0 THEN [NULL] ELSE q.ts END) AS t(ticker) LEFT JOIN {CATALOG_FIXTURE.sql} c ON c.ticker = t.ticker"""
_WANT = f"list_sort(list_filter(list_distinct(list_transform({years_sql('question')}, lambda y: y) || list_transform({years_sql('question')}, lambda y: y + 1)), lambda y: list_contains(coalesce(catalog, []), y)))"
_ADVICE_SQL = r"(?i)\b(should i|is it a good (time|idea) to)\s+(buy|sell|invest|hold)|\bprice target\b|\b(buy|sell) (the )?stock\b|\bgood investment\b"


@query(f"SELECT qid, ticker, {_expand_sql('text', 'ticker')} AS question FROM ({_SUBS})")
def expand_terms(spark, sf_dir):
    return P.sub_questions(asked(spark, sf_dir), CATALOG).select("qid", "ticker", "question")


@query(f"SELECT qid, ticker, array_to_string({_WANT}, ',') AS filing_years FROM ({_SUBS}) WHERE ticker IS NOT NULL")
def year_policy(spark, sf_dir):
    return P.sub_questions(asked(spark, sf_dir), CATALOG).where("ticker IS NOT NULL").select("qid", "ticker", F.array_join(F.col("filing_years").cast("array<string>"), ",").alias("filing_years"))


@query(f"""SELECT qid, CASE WHEN advice THEN 'investment_advice' ELSE 'answer' END AS route, CASE WHEN advice THEN NULL ELSE ticker END AS ticker, CASE WHEN advice THEN NULL ELSE {_expand_sql('text', 'ticker')} END AS question,
CASE WHEN advice THEN NULL ELSE array_to_string({_WANT}, ',') END AS filing_years FROM (SELECT *, regexp_matches(question, '{_ADVICE_SQL}') AS advice FROM ({_SUBS}))""")
def rule_plan(spark, sf_dir):
    return P.rule_plan(asked(spark, sf_dir), CATALOG).select("qid", "route", "ticker", "question", F.array_join(F.col("filing_years").cast("array<string>"), ",").alias("filing_years"))


_AGGREGATE_SQL = r"(?i)\b(which of the (five|5)|rank|combined|total of|sum of|most|least|highest|lowest|fastest|by what percentage|how much more|grew more|partner|suppl|compet)\w*"


@query(f"""SELECT qid, CASE WHEN advice THEN 'pipeline' WHEN n >= 3 OR regexp_matches(question, '{_AGGREGATE_SQL}') THEN 'react' ELSE 'pipeline' END AS path,
CASE WHEN advice THEN 'router: investment_advice' WHEN n >= 3 THEN n || ' sub-questions' WHEN regexp_matches(question, '{_AGGREGATE_SQL}') THEN 'aggregate wording: ''' || regexp_extract(question, '{_AGGREGATE_SQL}') || '''' ELSE n || ' sub-question(s), no aggregation' END AS why
FROM (SELECT qid, question, greatest(len({tickers_sql('question')}), 1) AS n, regexp_matches(question, '{_ADVICE_SQL}') AS advice FROM {_ASKED})""")
def route(spark, sf_dir):
    return P.route(asked(spark, sf_dir), CATALOG)


LABELLED = Fixture("qid long, companies array<string>, years array<int>, expected_route string", [
    (1, ["AAPL"], [2025], "answer"), (2, ["MSFT", "AMZN"], [2024], "answer"), (3, ["NVDA"], [2023], "answer"), (4, ["TSLA"], [], "investment_advice"), (5, [], [], "answer"),
    (6, ["MSFT"], [2023], "answer"), (7, [], [], "out_of_scope"), (8, ["AMZN"], [2024], "answer"), (9, ["AAPL", "AMZN", "TSLA"], [2024], "answer"), (10, [], [], "answer"),
])


#: What the wording of each template asks for: companies, years, route.
_EXPECTED = Fixture("kind int, companies array<string>, years array<int>, expected_route string", [(0, ["AAPL"], [2024], "answer"), (1, ["MSFT", "AMZN"], [2023], "answer"), (2, ["TSLA"], [], "investment_advice"), (3, [], [], "answer"), (4, ["AAPL", "AMZN", "NVDA"], [], "answer"), (5, [], [], "answer")])
_LABELS = f"(SELECT * FROM {LABELLED.sql} UNION ALL SELECT item_id + 1000, companies, years, expected_route FROM benchmark JOIN {_EXPECTED.sql} ON kind = item_id % 6)"


@query(f"""SELECT count(*) AS cases, count_if(list_sort(list_distinct(g.ts)) = list_sort(list_distinct(l.companies))) AS companies_right, count_if(len(list_filter(g.fy, lambda y: NOT list_contains(l.years, y))) = 0) AS years_subset,
count_if(g.r = l.expected_route) AS routes_right, count_if(g.r <> 'answer' AND l.expected_route <> 'answer') AS refused_right, count_if(g.r <> 'answer') AS refused, count_if(l.expected_route <> 'answer') AS to_refuse
FROM (SELECT qid, {tickers_sql('question')} AS ts, {_FY_SQL} AS fy, CASE WHEN regexp_matches(question, '{_ADVICE_SQL}') THEN 'investment_advice' ELSE 'answer' END AS r FROM {_ASKED}) g JOIN {_LABELS} l USING (qid)""")
def planner_scorecard(spark, sf_dir):
    q = F.col("question")
    got = asked(spark, sf_dir).select("qid", T.tickers(q).alias("ts"), T.fiscal_years(q).alias("fy"), F.when(q.rlike(P.ADVICE), F.lit("investment_advice")).otherwise(F.lit("answer")).alias("r"))
    items = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1000).alias("qid"), (F.col("item_id") % 6).cast("int").alias("kind"))
    both = got.join(LABELLED.df(spark).unionByName(items.join(F.broadcast(_EXPECTED.df(spark)), "kind").drop("kind")), "qid")
    same = F.array_sort(F.array_distinct("ts")) == F.array_sort(F.array_distinct("companies"))
    return both.agg(
        F.count("*").alias("cases"), F.count_if(same).alias("companies_right"), F.count_if(F.size(F.array_except("fy", "years")) == 0).alias("years_subset"), F.count_if(F.col("r") == F.col("expected_route")).alias("routes_right"),
        F.count_if((F.col("r") != "answer") & (F.col("expected_route") != "answer")).alias("refused_right"), F.count_if(F.col("r") != "answer").alias("refused"), F.count_if(F.col("expected_route") != "answer").alias("to_refuse"),
    )


PROPOSED = Fixture("qid long, question string, proposed_route string, proposed array<string>", [
    (1, "Did Activision matter in Microsoft’s 10-K of 2024?", "unsupported_company", []), (2, "Weather in Paris", "out_of_scope", []), (3, "Apple and Tesla staff in 2024", "answer", ["AAPL"]), (4, "Growth of the market", "answer", []),
])


_ROUTES = ["answer", "out_of_scope", "unsupported_company"]
_PROPOSALS = f"(SELECT * FROM {PROPOSED.sql} UNION ALL SELECT qid, question, {_ROUTES}[qid % 3 + 1], CASE WHEN qid % 2 = 0 THEN ['AAPL'] ELSE [] END FROM {_ASKED} WHERE qid >= 1000)"


@query(f"""WITH p AS (SELECT *, list_distinct(proposed || {tickers_sql('question')}) AS u FROM {_PROPOSALS}), r AS (SELECT *, CASE WHEN len(u) > 0 AND proposed_route IN ('out_of_scope', 'unsupported_company') THEN 'answer' ELSE proposed_route END AS route FROM p)
SELECT qid, route, array_to_string(list_sort(u), ',') AS companies, route <> proposed_route AS rerouted, CAST(CASE WHEN route = 'answer' THEN len(list_filter(u, lambda t: NOT list_contains(proposed, t))) ELSE 0 END AS BIGINT) AS added FROM r""")
def plan_policy(spark, sf_dir):
    route = F.get(F.array(*map(F.lit, _ROUTES)), (F.col("qid") % 3).cast("int"))
    proposed = F.when(F.col("qid") % 2 == 0, F.array(F.lit("AAPL"))).otherwise(F.array().cast("array<string>"))
    items = asked(spark, sf_dir).where("qid >= 1000").select("qid", "question", route.alias("proposed_route"), proposed.alias("proposed"))
    return P.plan_policy(PROPOSED.df(spark).unionByName(items)).select("qid", "route", F.array_join(F.array_sort("companies"), ",").alias("companies"), "rerouted", "added")


REFUSED = Fixture("qid long, route string, companies array<string>", [(1, "investment_advice", []), (2, "out_of_scope", []), (3, "unsupported_company", ["Ford", "Meta"]), (4, "answer", ["AAPL"])])


_REFUSALS = f"(SELECT * FROM {REFUSED.sql} UNION ALL SELECT qid, CASE WHEN regexp_matches(question, '{_ADVICE_SQL}') THEN 'investment_advice' ELSE {_ROUTES}[qid % 3 + 1] END, [string_split(question, ' ')[1], 'Ford'] FROM {_ASKED} WHERE qid >= 1000)"


@query(f"""SELECT qid, CASE route WHEN 'investment_advice' THEN 'I can describe what the filings say, but I do not give investment advice.' WHEN 'out_of_scope' THEN 'That question is not about the indexed filings.'
WHEN 'unsupported_company' THEN 'No filings are indexed for: ' || array_to_string(companies, ', ') || '.' END AS refusal FROM {_REFUSALS}""")
def refusal_templates(spark, sf_dir):
    route = F.when(F.col("question").rlike(P.ADVICE), F.lit("investment_advice")).otherwise(F.get(F.array(*map(F.lit, _ROUTES)), (F.col("qid") % 3).cast("int")))
    items = asked(spark, sf_dir).where("qid >= 1000").select("qid", route.alias("route"), F.array(F.element_at(F.split("question", " "), 1), F.lit("Ford")).alias("companies"))
    return REFUSED.df(spark).unionByName(items).select("qid", P.refusal_text(F.col("route"), F.col("companies")).alias("refusal"))
