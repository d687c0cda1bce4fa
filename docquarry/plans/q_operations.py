"""Queries of telemetry, statistics, graphs and evaluation reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.operators import graph, statistics, telemetry
from docquarry.plans.registry import Fixture, query, table

# ---- Telemetry over events: event_type is the stage, value the latency, user_id the client ------------------------


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS most, round(list_sort(list(value))[len(list(value)) // 2 + 1], 6) AS upper_median FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"), F.round(F.max("value"), 6).alias("most"), F.round(telemetry.upper_median("value"), 6).alias("upper_median")
    )


@query("SELECT event_type, round(avg(value), 6) AS mean, round(sum(value) / (SELECT sum(value) FROM events), 6) AS share FROM events GROUP BY event_type")
def stage_share(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    total = e.agg(F.sum("value").alias("total"))
    return e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.sum("value").alias("s")).crossJoin(F.broadcast(total)).select("event_type", "mean", F.round(F.col("s") / F.col("total"), 6).alias("share"))


_MODEL = "CASE event_type WHEN 'click' THEN 'gpt-4o-mini' WHEN 'view' THEN 'gpt-4.1' WHEN 'purchase' THEN 'gpt-4.1-mini' WHEN 'signup' THEN 'text-embedding-3-small' ELSE 'local' END"
_PRICES_SQL = "(VALUES " + ", ".join(f"('{m}', {a}, {b})" for m, (a, b) in telemetry.PRICES.items()) + ") AS _p(model, p_in, p_out)"


@query(f"SELECT e.model, count(*) AS n, round(sum((user_id * 10 * p_in + event_id % 100 * p_out) / 1e6), 6) AS usd FROM (SELECT *, {_MODEL} AS model FROM events) e LEFT JOIN {_PRICES_SQL} USING (model) GROUP BY e.model")
def cost_by_model(spark, sf_dir):
    model = F.expr(_MODEL)
    e = table(spark, sf_dir, "events").select(model.alias("model"), telemetry.cost_usd(model, F.col("user_id") * 10, F.col("event_id") % 100).alias("usd"))
    return e.groupBy("model").agg(F.count("*").alias("n"), F.round(F.sum("usd"), 6).alias("usd"))


@query("SELECT * FROM (SELECT user_id, event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M') || ' ' || event_type AS line, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 3")
def timeline(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(w)).where("n <= 3")
    return e.select("user_id", "event_id", "event_type", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit(" "), F.col("event_type")).alias("line"), "n")


SPANS = Fixture("trace_id string, idx int, name string, start_ms double, duration_ms double, parent_idx int", [
    ("a", 0, "embed", 1.0, 2.0, 2), ("a", 1, "search", 3.0, 4.0, 2), ("a", 2, "retrieve", 0.5, 8.0, 3), ("a", 3, "agent", 0.0, 20.0, None), ("b", 0, "plan", 0.0, 5.0, None), ("b", 1, "zero", 5.0, 0.0, None), ("b", 2, "late", 5.0, 3.0, None),
    ("c", 0, "x", 2.0, 1.0, 1), ("c", 1, "y", 1.0, 5.0, None), ("c", 2, "z", 1.0, 5.0, None),
])


#: A user's events of a day as spans, numbered as they end, as spans are recorded.
_DAYS = """days AS (SELECT 'u' || user_id || '/' || strftime(ts, '%Y-%m-%d') AS trace_id, date_diff('millisecond', date_trunc('day', ts), ts)::DOUBLE AS start_ms, floor(value * 400000) AS duration_ms, event_id FROM events),
numbered AS (SELECT trace_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY start_ms + duration_ms, event_id) - 1 AS INTEGER) AS idx, start_ms, duration_ms FROM days)"""


@query(f"WITH {_DAYS} SELECT trace_id, idx, parent_idx FROM {SPANS.sql} UNION ALL SELECT a.trace_id, a.idx, b.idx FROM numbered a LEFT JOIN numbered b ON b.trace_id = a.trace_id AND b.idx > a.idx AND b.start_ms < a.start_ms AND a.start_ms + a.duration_ms <= b.start_ms + b.duration_ms QUALIFY row_number() OVER (PARTITION BY a.trace_id, a.idx ORDER BY b.duration_ms, b.idx) = 1")
def span_tree(spark, sf_dir):
    """Parents of the fixed spans, and of all events as spans of each user's day."""
    day = F.date_trunc("day", F.col("ts"))
    start = F.timestamp_diff("MILLISECOND", day, F.col("ts")).cast("double")
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd")).alias("trace_id"), start.alias("start_ms"), F.floor(F.col("value") * 400_000).cast("double").alias("duration_ms"), "event_id")
    w = Window.partitionBy("trace_id").orderBy(F.col("start_ms") + F.col("duration_ms"), "event_id")
    days = e.select("trace_id", (F.row_number().over(w) - 1).cast("int").alias("idx"), F.lit("event").alias("name"), "start_ms", "duration_ms")
    return telemetry.span_parents(SPANS.df(spark).drop("parent_idx").unionByName(days))


@query("SELECT event_type, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days, true AS within FROM events GROUP BY event_type")
def latency_sketches(spark, sf_dir):
    """Quantile sketches of each day and type, merged over days; within: the exact ranks of the estimated quartiles and tails are at most 0.02 away."""
    e = table(spark, sf_dir, "events")
    merged = telemetry.merged_sketches(telemetry.daily_sketches(e, ["event_type"], F.to_date("ts"), "value"), ["event_type"])
    return telemetry.rank_errors(e, merged, ["event_type"], "value", [0.25, 0.5, 0.75, 0.95, 0.99]).groupBy("event_type").agg(F.first("n").alias("n"), F.first("days").alias("days"), (F.max("error") <= 0.02).alias("within"))


_EDGES = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0]


@query(f"SELECT event_type, CAST(edge AS DOUBLE) AS edge, count_if(value <= edge) AS n FROM events, (VALUES {', '.join(f'({e})' for e in _EDGES)}) AS _e(edge) GROUP BY ALL")
def histogram_buckets(spark, sf_dir):
    return telemetry.bucket_counts(table(spark, sf_dir, "events"), "value", _EDGES, ["event_type"])


@query("""WITH b AS (SELECT value AS v FROM events WHERE ts < TIMESTAMP '2024-01-15'), c AS (SELECT value AS v FROM events WHERE ts >= TIMESTAMP '2024-01-15'), e AS (SELECT list_distinct(quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM b), i AS (SELECT list_sort(e)[2:len(e) - 1] AS inner FROM e),
p AS (SELECT k.bin, greatest((SELECT count(*) FROM b WHERE len(list_filter(i.inner, lambda x: x <= b.v)) = k.bin) / (SELECT count(*) FROM b), 1e-4) AS pb, greatest((SELECT count(*) FROM c WHERE len(list_filter(i.inner, lambda x: x <= c.v)) = k.bin) / (SELECT count(*) FROM c), 1e-4) AS pc FROM i, range(0, 10) AS k(bin)) SELECT round(sum((pc - pb) * ln(pc / pb)), 6) AS psi FROM p""".replace(" AS inner ", " AS inr ").replace("i.inner", "i.inr"))
def psi(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    return telemetry.stability_index(e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut), "value")


@query("WITH s AS (SELECT floor(min(value)) AS lo, ceil(max(value)) AS hi FROM events) SELECT CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'before' ELSE 'after' END AS side, CAST(least(floor((value - lo) / ((hi - lo) / 12)) + 1, 12) AS INTEGER) AS bin, count(*) AS n FROM events, s GROUP BY ALL")
def two_histograms(spark, sf_dir):
    side = F.when(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"), F.lit("before")).otherwise(F.lit("after"))
    return telemetry.equal_bins(table(spark, sf_dir, "events").withColumn("side", side), "value", 12, ["side"])


@query("WITH q AS (SELECT event_id, event_type, user_id FROM events WHERE event_type IN ('view', 'click')), judged AS (SELECT DISTINCT event_id FROM events WHERE event_id % 3 = 0), o AS (SELECT * FROM q WHERE event_id NOT IN (SELECT event_id FROM judged) ORDER BY event_id LIMIT 50) SELECT event_type, count(*) AS queued, CAST(sum(user_id) AS BIGINT) AS tokens FROM o GROUP BY event_type")
def queue_antijoin(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    queue = e.where(F.col("event_type").isin("view", "click")).join(e.where("event_id % 3 = 0").select("event_id"), "event_id", "left_anti")
    return queue.orderBy("event_id").limit(50).groupBy("event_type").agg(F.count("*").alias("queued"), F.sum("user_id").alias("tokens"))


@query("SELECT f.event_id, t.event_type AS traced, round(t.value, 6) AS value FROM (SELECT event_id FROM events WHERE event_type = 'error') f LEFT JOIN (SELECT * FROM events WHERE event_id % 2 = 0) t USING (event_id)")
def thumbs_down_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    down, traces = e.where("event_type = 'error'").select("event_id"), e.where("event_id % 2 = 0")
    return down.join(traces.select("event_id", F.col("event_type").alias("traced"), F.round("value", 6).alias("value")), "event_id", "left")


@query("SELECT user_id, event_type, max(event_id) AS event_id, round(max_by(value, event_id), 6) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY user_id, event_type")
def latest_trace(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))
    return e.groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"), F.round(F.max_by("value", "event_id"), 6).alias("value"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS error_rate, round(quantile_cont(value, 0.95), 6) AS p95, count(DISTINCT user_id) AS users, count_if(event_type <> 'error' AND value > 50) AS passed FROM events GROUP BY ALL")
def ops_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return e.groupBy("day").agg(
        F.count("*").alias("n"), F.round(F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)), 6).alias("error_rate"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"), F.count_distinct("user_id").alias("users"), F.count_if((F.col("event_type") != "error") & (F.col("value") > 50)).alias("passed")
    )


@query("SELECT event_type, count(*) AS requests, round(count(*) / (date_diff('second', min(ts), max(ts)) + 1), 6) AS per_second, count_if(json_extract(props, '$.k') < 3) AS cache_hits FROM (SELECT event_type, ts, CAST(json_extract(props, '$.k') AS BIGINT) AS k, props FROM events) GROUP BY event_type".replace("json_extract(props, '$.k') < 3", "k < 3"))
def load_report(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.groupBy("event_type").agg(F.count("*").alias("requests"), F.round(F.count("*") / (F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")) + 1), 6).alias("per_second"), F.count_if(F.col("k") < 3).alias("cache_hits"))


@query("SELECT event_id, CASE WHEN k >= 50 THEN substr(v, 1, 4) END AS v, md5(event_type || '=' || k) AS attr FROM (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(CAST(user_id AS BIGINT) AS VARCHAR) AS v FROM events)")
def attribute_export(spark, sf_dir):
    """Nulls dropped, values cut, keys renamed: a map through map functions."""
    k = F.get_json_object("props", "$.k").cast("long")
    m = F.create_map(F.lit("user"), F.when(k >= 50, F.col("user_id").cast("string")), F.col("event_type"), k.cast("string"))
    out = F.transform_values(F.transform_keys(F.map_filter(m, lambda _, v: v.isNotNull()), lambda n, _: F.concat(F.lit("rag."), n)), lambda _, v: F.substring(v, 1, 4))
    e = table(spark, sf_dir, "events").select("event_id", "event_type", out.alias("m"))
    return e.select("event_id", F.try_element_at("m", F.lit("rag.user")).alias("v"), F.md5(F.concat_ws("=", "event_type", F.element_at("m", F.concat(F.lit("rag."), F.col("event_type")))).cast("binary")).alias("attr"))


# ---- Graphs: suppliers and parts as organisations, and named triples ------------------------------------------------

NAMES = Fixture("id long, raw string, resolved string", [
    (1, "Contemporary Amperex Technology Co., Limited (CATL)", "CATL"), (2, "Samsung Electronics Co., Ltd.", "Samsung"), (3, "Alphabet Inc.", "Google"), (4, "Acme Holdings, LLC", "Acme"), (5, "Intel Corporation", "Intel"), (6, "Company", "Company"), (7, "Foo (formerly Bar) Corp", "Foo"),
])
TRIPLES = Fixture("subject string, relation string, raw string, kind string, part_of_filer boolean", [
    ("Apple", "competes_with", "Google LLC", "company", False), ("Google", "competes_with", "Apple Inc.", "company", False), ("Microsoft", "partner_of", "OpenAI", "company", False), ("Microsoft", "competes_with", "Alphabet", "company", False), ("Microsoft", "owns", "LinkedIn", "company", True),
    ("Apple", "supplied_by", "various suppliers", "company", False), ("Tesla", "supplied_by", "Panasonic", "company", False), ("Apple", "supplied_by", "Apple Inc", "company", False), ("Tesla", "competes_with", "Google", "company", False), ("Tesla", "uses", "Lithium", "material", False),
])
_KEPT = Fixture("subject string, relation string, object string", [("Apple", "competes_with", "Google"), ("Google", "competes_with", "Apple"), ("Microsoft", "partner_of", "OpenAI"), ("Microsoft", "competes_with", "Google"), ("Tesla", "supplied_by", "Panasonic"), ("Tesla", "competes_with", "Google")])


def _edges(spark):
    return graph.usable_triples(TRIPLES.df(spark)).select("subject", "relation", "object")


@query(f"SELECT id, resolved FROM {NAMES.sql}")
def resolve_entities(spark, sf_dir):
    return NAMES.df(spark).select("id", graph.resolve(F.col("raw")).alias("resolved"))


@query(f"SELECT * FROM {_KEPT.sql}")
def usable_triples(spark, sf_dir):
    return _edges(spark)


@query(f"SELECT relation, count(*) AS edges, (SELECT count(*) FROM (SELECT subject FROM {_KEPT.sql} UNION SELECT object FROM {_KEPT.sql})) AS nodes FROM {_KEPT.sql} GROUP BY relation")
def graph_size(spark, sf_dir):
    e = _edges(spark)
    nodes = e.select(F.col("subject").alias("n")).union(e.select("object")).agg(F.count_distinct("n").alias("nodes"))
    return e.groupBy("relation").agg(F.count("*").alias("edges")).crossJoin(F.broadcast(nodes))


_STAR = "SELECT DISTINCT 's' || l_suppkey % 40 AS subject, 's' || l_partkey % 40 AS object FROM lineitem"


def _star(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("s"), (F.col("l_suppkey") % 40).cast("string")).alias("subject"), F.concat(F.lit("s"), (F.col("l_partkey") % 40).cast("string")).alias("object")).distinct()


@query(f"SELECT least(subject, object) AS a, greatest(subject, object) AS b, bool_or(subject < object) AND bool_or(subject > object) AS both_ways, count(*) AS links FROM ({_STAR}) WHERE subject <> object GROUP BY ALL")
def mutual_edges(spark, sf_dir):
    return graph.mutual(_star(spark, sf_dir))


@query("SELECT 'p' || l_partkey AS object, count(DISTINCT l_suppkey) AS n, md5(string_agg(DISTINCT 's' || l_suppkey, ',' ORDER BY 's' || l_suppkey)) AS subjects FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) >= 2")
def shared_neighbours(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("subject"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("object")).distinct()
    return graph.shared_neighbours(e).select("object", "n", F.md5(F.array_join("subjects", ",").cast("binary")).alias("subjects"))


@query("WITH e AS (SELECT DISTINCT l_suppkey, l_returnflag, l_partkey FROM lineitem WHERE l_suppkey = 3) SELECT l_returnflag AS relation, count(*) AS n, min(l_partkey) AS first FROM e GROUP BY ALL")
def relations_to_node(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").where("l_suppkey = 3").select("l_returnflag", "l_partkey").distinct()
    return e.groupBy(F.col("l_returnflag").alias("relation")).agg(F.count("*").alias("n"), F.min("l_partkey").alias("first"))


@query(f"WITH m AS (SELECT subject, 'x' AS relation, object FROM ({_STAR}) WHERE contains(lower(object), '1')) SELECT subject, relation, object, row_number() OVER (ORDER BY subject, relation, object) AS row, greatest((SELECT count(*) FROM m) - 25, 0) AS more FROM m QUALIFY row <= 25")
def edge_lookup(spark, sf_dir):
    e = _star(spark, sf_dir).select("subject", F.lit("x").alias("relation"), "object")
    return graph.lookup(e, None, "x", "1")


# ---- Statistics and evaluation reports over labels ------------------------------------------------------------------

_RUNS = "runs AS (SELECT doc_id, CAST(quality AS DOUBLE) AS a, CAST(1 - toxic AS DOUBLE) AS b FROM labels)"
_WEIGHT = "(" + " + ".join(f"CASE WHEN h >= {x} THEN 1 ELSE 0 END" for x in statistics.POISSON_STEPS) + ")"
_MEANS = f"m AS (SELECT replicate, sum(w * a) / sum(w) AS a, sum(w * (b - a)) / sum(w) AS d FROM (SELECT *, {_WEIGHT} AS w FROM (SELECT r.replicate, x.*, CAST('0x' || substr(md5(r.replicate || ':' || x.doc_id), 1, 8) AS BIGINT) AS h FROM range(0, 200) r(replicate), runs x)) GROUP BY replicate)"
_CUT = "round(list_sort(list({0}))[CAST(floor(0.025 * 200) AS INTEGER) + 1], 6) AS low, round(list_sort(list({0}))[CAST(floor(0.975 * 200) AS INTEGER) + 1], 6) AS high"


def _runs(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("a"), ((1 - F.col("toxic")) - F.col("quality")).cast("double").alias("d"))


@query(f"WITH {_RUNS}, {_MEANS} SELECT (SELECT round(avg(a), 6) FROM runs) AS mean, {_CUT.format('a')} FROM m")
def bootstrap_interval(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    i = statistics.replicate_interval(statistics.replicate_means(runs, "doc_id", ["a"], 200), "a", 200)
    return runs.agg(F.round(F.avg("a"), 6).alias("mean")).crossJoin(F.broadcast(i)).select("mean", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"WITH {_RUNS}, {_MEANS} SELECT (SELECT round(avg(b - a), 6) FROM runs) AS difference, {_CUT.format('d')}, round(avg(CASE WHEN round(d, 9) <= 0 THEN 1.0 ELSE 0.0 END), 6) AS p_not_better FROM m")
def paired_bootstrap(spark, sf_dir):
    """The difference of two runs over the same rows, its interval, and the share of replicates in which it is not over 0."""
    runs = _runs(spark, sf_dir)
    i = statistics.replicate_interval(statistics.replicate_means(runs, "doc_id", ["d"], 200), "d", 200)
    return runs.agg(F.round(F.avg("d"), 6).alias("difference")).crossJoin(F.broadcast(i)).select("difference", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round("not_over", 6).alias("p_not_better"))


@query(None)
def seeded_bootstrap(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select(F.concat(F.lit("quality"), (F.col("doc_id") % 2).cast("string")).alias("run"), "doc_id", F.col("quality").cast("double").alias("v"))
    return statistics.bootstrap_by_group(lab, "run", "doc_id", "v", 500)


_DETECTOR = r"regexp_matches(lower(d.text), '\b(idiot|moron|stupid|scum|loser|clown|trash|pathetic|worthless|disgusting)\b')"


@query(f"SELECT count(*) AS cases, count_if({_DETECTOR} AND toxic = 1) AS caught, count_if(toxic = 1) AS wrong, count_if({_DETECTOR} AND toxic = 0) AS false_alarms, round(count_if({_DETECTOR} = (toxic = 1)) / count(*), 6) AS accuracy FROM labels l JOIN documents d USING (doc_id)")
def checker_confusion(spark, sf_dir):
    hit = F.lower("text").rlike(r"\b(idiot|moron|stupid|scum|loser|clown|trash|pathetic|worthless|disgusting)\b")
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", hit.alias("hit")), "doc_id")
    bad = F.col("toxic") == 1
    return j.agg(F.count("*").alias("cases"), F.count_if(F.col("hit") & bad).alias("caught"), F.count_if(bad).alias("wrong"), F.count_if(F.col("hit") & ~bad).alias("false_alarms"), F.round(F.count_if(F.col("hit") == bad) / F.count("*"), 6).alias("accuracy"))


BASE = Fixture("metric string, value double", [("correct", 0.70), ("refused_ok", 1.0), ("false_refusals", 8.0), ("faithfulness", 0.85), ("latency_p50_s", 1.4), ("cost_per_q", None)])
NOW = Fixture("metric string, value double", [("correct", 0.66), ("refused_ok", 0.9), ("false_refusals", 9.0), ("faithfulness", 0.80), ("latency_p50_s", 2.2), ("cost_per_q", 0.1)])
RULES = Fixture("metric string, direction string, tolerance double", [("correct", "higher", 0.05), ("refused_ok", "higher", 0.0), ("false_refusals", "lower", 1.0), ("faithfulness", "higher", 0.05), ("latency_p50_s", "factor", 1.5), ("cost_per_q", "factor", 1.5)])


@query(f"SELECT metric, b.value AS baseline, c.value AS current, CASE direction WHEN 'higher' THEN c.value >= b.value - tolerance WHEN 'lower' THEN c.value <= b.value + tolerance ELSE c.value <= b.value * tolerance END AS ok FROM {RULES.sql} r JOIN {BASE.sql} b USING (metric) JOIN {NOW.sql} c USING (metric) WHERE b.value IS NOT NULL AND c.value IS NOT NULL")
def regression_gate(spark, sf_dir):
    return statistics.regression_gate(BASE.df(spark), NOW.df(spark), RULES.df(spark))


CLAIMS = Fixture("run string, claim long, value_matches boolean, entity_matches boolean, period_matches boolean, contradicted boolean", [("p1", 1, True, True, True, False), ("p1", 2, True, False, True, False), ("p1", 3, False, True, True, True), ("p2", 1, True, True, True, False), ("p2", 2, True, True, True, False)])
_VERDICT = "CASE WHEN contradicted THEN 'contradicted' WHEN NOT (value_matches AND entity_matches AND period_matches) THEN 'unsupported' ELSE 'supported' END"


@query(f"SELECT run, count(*) AS claims, round(avg(CASE WHEN {_VERDICT} = 'supported' THEN 1.0 ELSE 0.0 END), 6) AS faithfulness, string_agg({_VERDICT}, ',' ORDER BY claim) AS verdicts FROM {CLAIMS.sql} GROUP BY run")
def faithfulness_verdicts(spark, sf_dir):
    c = CLAIMS.df(spark).withColumn("v", F.expr(_VERDICT))
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim", "v"))), lambda s: s["v"]), ",")
    return c.groupBy("run").agg(F.count("*").alias("claims"), F.round(F.avg(F.when(F.col("v") == "supported", 1.0).otherwise(0.0)), 6).alias("faithfulness"), seq.alias("verdicts"))


_PIPES = "p AS (SELECT doc_id AS question, 'a' AS pipeline, quality AS verdict, doc_id % 4 AS type, n_chars AS ms FROM labels JOIN documents USING (doc_id) UNION ALL SELECT doc_id, 'b', 1 - toxic, doc_id % 4, n_chars * 2 FROM labels JOIN documents USING (doc_id))"


def _pipelines(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    a = j.select(F.col("doc_id").alias("question"), F.lit("a").alias("pipeline"), F.col("quality").alias("verdict"), (F.col("doc_id") % 4).alias("type"), F.col("n_chars").alias("ms"))
    return a.unionByName(j.select(F.col("doc_id").alias("question"), F.lit("b").alias("pipeline"), (1 - F.col("toxic")).alias("verdict"), (F.col("doc_id") % 4).alias("type"), (F.col("n_chars") * 2).alias("ms")))


@query(f"WITH {_PIPES} SELECT pipeline, round(avg(verdict), 6) AS correct, count_if(verdict = 0) AS failed, median(ms) AS p50, list_sort(list(ms))[len(list(ms)) // 2 + 1] AS upper_p50, CAST(sum(CASE WHEN type = 0 THEN 1 ELSE 0 END) AS BIGINT) AS unanswerable FROM p GROUP BY pipeline")
def pipeline_report(spark, sf_dir):
    return _pipelines(spark, sf_dir).groupBy("pipeline").agg(F.round(F.avg("verdict"), 6).alias("correct"), F.count_if(F.col("verdict") == 0).alias("failed"), F.percentile("ms", F.lit(0.5)).alias("p50"), telemetry.upper_median("ms").cast("long").alias("upper_p50"), F.sum(F.when(F.col("type") == 0, 1).otherwise(0)).alias("unanswerable"))


@query(f"WITH {_PIPES} SELECT a.question, a.verdict AS was, b.verdict AS now FROM p a JOIN p b USING (question) WHERE a.pipeline = 'a' AND b.pipeline = 'b' AND a.verdict <> b.verdict")
def flips(spark, sf_dir):
    p = _pipelines(spark, sf_dir)
    a, b = (p.where(F.col("pipeline") == x).select("question", F.col("verdict").alias(n)) for x, n in (("a", "was"), ("b", "now")))
    return a.join(b, "question").where("was != now")


@query(f"WITH {_PIPES} SELECT question, pipeline, verdict FROM p WHERE pipeline = CASE WHEN type >= 2 THEN 'b' ELSE 'a' END")
def composite_run(spark, sf_dir):
    return _pipelines(spark, sf_dir).where(F.col("pipeline") == F.when(F.col("type") >= 2, "b").otherwise("a")).select("question", "pipeline", "verdict")


@query(f"WITH {_PIPES} SELECT pipeline, type, count(*) AS n, CAST(sum(ms) AS BIGINT) AS tokens, median(ms) AS p50 FROM p GROUP BY ALL")
def behaviour_by_type(spark, sf_dir):
    return _pipelines(spark, sf_dir).groupBy("pipeline", "type").agg(F.count("*").alias("n"), F.sum("ms").alias("tokens"), F.percentile("ms", F.lit(0.5)).alias("p50"))


PATTERNS = Fixture("pattern_id long, source string, pattern string", [(1, "src1", "the"), (2, "src2", "zzzz"), (3, "src99", "the"), (4, "src3", r"\bof\b.*\bof\b")])


@query(f"SELECT p.pattern_id, count(d.doc_id) AS matches, count(d.doc_id) = 0 AS missing FROM {PATTERNS.sql} p LEFT JOIN documents d ON d.source = p.source AND regexp_matches(d.text, p.pattern) GROUP BY p.pattern_id")
def evidence_audit(spark, sf_dir):
    p, d = PATTERNS.df(spark), table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    j = p.join(F.broadcast(p.select("source").distinct()), "source").join(d, "source", "left").where("doc_id IS NULL OR regexp_like(text, pattern)")
    found = j.groupBy("pattern_id").agg(F.count("doc_id").alias("matches"))
    return p.join(found, "pattern_id", "left").select("pattern_id", F.coalesce("matches", F.lit(0)).alias("matches"), (F.coalesce("matches", F.lit(0)) == 0).alias("missing"))


@query("WITH e AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents WHERE n_chars > 800 AND doc_id NOT IN (SELECT doc_id FROM labels)) SELECT source, lang, doc_id FROM e WHERE r <= 2")
def golden_sample(spark, sf_dir):
    w = Window.partitionBy("source", "lang").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")
    free = table(spark, sf_dir, "documents").where("n_chars > 800").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return free.withColumn("r", F.row_number().over(w)).where("r <= 2").select("source", "lang", "doc_id")


REFERENCE_ANSWERS = Fixture("case_id long, reference string, answer string, matches boolean", [(1, "416,161", "It was $416.2 billion [1].", True), (2, "12.5%", "about 12.46% [2]", False), (3, "7", "it is 7.2", False), (4, "7", "7 [3]", True), (5, "1,500", "1.5 billion", True)])


@query(f"SELECT case_id, matches FROM {REFERENCE_ANSWERS.sql}")
def number_matches(spark, sf_dir):
    from docquarry.functions import text as T

    raw = r"(?i)\$?\d[\d,]*(?:\.\d+)?"
    said = F.regexp_extract_all(T.without_citations(F.col("answer")), F.lit(raw + r"\s*(?:billion|million|%)?"), F.lit(0))
    ref = T.norm_number(F.col("reference")).cast("double")

    def same(m):
        n = T.norm_number(F.regexp_extract(m, raw, 0))
        dec = F.when(n.contains("."), F.length(F.substring_index(n, ".", -1))).otherwise(F.lit(0))
        x, tol = n.cast("double"), 0.5 * F.pow(F.lit(10.0), -dec)
        return (F.abs(x - ref) <= F.greatest(tol, F.lit(1e-9))) | (F.lower(m).endswith("billion") & (F.abs(x - ref / 1000) <= tol + 1e-9))

    return REFERENCE_ANSWERS.df(spark).select("case_id", F.exists(said, same).alias("matches"))
