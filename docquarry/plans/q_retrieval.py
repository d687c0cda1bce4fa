"""Queries of sparse and dense retrieval, fusion, reranking and metrics over documents, benchmark and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.functions import text as T
from docquarry.operators import fusion, graphs, metrics, quantized, rerank, retriever, sparse, statistics, vectors
from docquarry.plans.q_text import tokens_sql
from docquarry.plans.registry import Fixture, query, search_index, search_postings, table
from docquarry.session import checkpointed, scratch, union

# ---- SQL pieces -------------------------------------------------------------------------------------------------

_INDEX = f"""t AS (SELECT doc_id, lang, source, {tokens_sql('text')} AS toks FROM documents), l AS (SELECT doc_id, len(toks) AS dl FROM t), n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM t) GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT p.doc_id, p.term, p.tf, d.df, ln(1 + (n.n - d.df + 0.5) / (d.df + 0.5)) AS idf, ln(1 + (n.n - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * l.dl / n.avgdl)) AS part FROM p JOIN d USING (term) JOIN l USING (doc_id), n)"""
_QUERIES = f"q AS (SELECT item_id AS qid, text AS question FROM benchmark), qt AS (SELECT qid, unnest(list_distinct({tokens_sql('question')})) AS term FROM q)"


def _ranked(scored: str, k: int, score: str = "score", key: str = "doc_id", by: str = "qid") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {score} DESC, {key}) AS rank FROM ({scored}) QUALIFY rank <= {k}"


def _bm25(k: int, where: str = "true", terms: str = "qt") -> str:
    return _ranked(f"SELECT {terms}.qid, s.doc_id, round(sum(s.part), 6) AS score FROM s JOIN {terms} USING (term) JOIN t USING (doc_id) WHERE {where} GROUP BY ALL HAVING round(sum(s.part), 6) > 0", k)


def _unit(v: str) -> str:
    return f"CASE WHEN list_dot_product({v}, {v}) > 0 THEN list_transform({v}, lambda x: x / sqrt(list_dot_product({v}, {v}))) ELSE {v} END"


def _embed_sql(name: str, key: str, source: str, toks: str, vec: str) -> str:
    """A table `name` of hashed token counts of unit length."""
    return f"""{name}_c AS (SELECT {key}, CAST('0x' || substr(md5(w), 1, 6) AS INTEGER) % 64 AS place, count(*) AS n FROM (SELECT {key}, unnest({toks}) AS w FROM {source}) GROUP BY ALL),
{name}_l AS (SELECT {key}, sqrt(sum(n * n)) AS length FROM {name}_c GROUP BY {key}),
{name} AS (SELECT x.{key}, list(coalesce(c.n / l.length, 0.0) ORDER BY i.i) AS {vec} FROM {source} x CROSS JOIN range(64) i(i) LEFT JOIN {name}_c c ON c.{key} = x.{key} AND c.place = i.i LEFT JOIN {name}_l l ON l.{key} = x.{key} GROUP BY x.{key})"""


_Q_EMBED = _embed_sql("qv", "qid", "q", tokens_sql("question"), "qvec")
_DENSE = f"""{_Q_EMBED}, {_embed_sql("dv", "doc_id", "t", "toks", "vec")}"""
_DENSE_TOP = "SELECT * FROM (" + _ranked("SELECT qid, doc_id, round(list_dot_product(qvec, vec), 6) AS score FROM qv, dv", 50) + ")"
_LISTS = f"lists AS (SELECT 'bm25' AS list, * FROM ({_bm25(50)}) UNION ALL SELECT 'dense' AS list, * FROM ({_DENSE_TOP}))"
_LABELS = r"labels_ AS (SELECT b.item_id AS qid, d.doc_id, CASE WHEN d.source = 'src' || (b.item_id % 20) THEN 2 ELSE 1 END AS grade FROM benchmark b JOIN documents d ON contains(lower(regexp_replace(d.text, '\s+', ' ', 'g')), lower(regexp_replace(b.text, '\s+', ' ', 'g'))))"


_RERANK_SQL = f"round(8.0 * len(list_intersect(list_distinct({tokens_sql('q.question')}), list_distinct(t.toks))) / greatest(len(list_distinct({tokens_sql('q.question')})), 1) - 4.0 - ln(1 + len(t.toks)) / 10, 6)"


def _rrf_sql(lists: str, k: int) -> str:
    return _ranked(f"SELECT qid, doc_id, round(sum(1.0 / (60 + rank)), 6) AS rrf_score FROM {lists} GROUP BY ALL", k, "rrf_score")


# ---- Shared frames ----------------------------------------------------------------------------------------------


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def _bm25_top(spark, sf_dir, k=50, where=None):
    return sparse.search(search_postings(spark, sf_dir), sparse.query_terms(_questions(spark, sf_dir)), k, where)


def _dense_top(spark, sf_dir, k=50):
    qs = _questions(spark, sf_dir).select("qid", T.tokens(F.col("question")).alias("t"))
    return vectors.exact_search(_vectors(spark, sf_dir), vectors.embed(qs, "qid", "t", "qvec"), k, key="doc_id")


def _both(spark, sf_dir):
    return union(_bm25_top(spark, sf_dir).withColumn("list", F.lit("bm25")), _dense_top(spark, sf_dir).withColumn("list", F.lit("dense")))


def _labels(spark, sf_dir):
    return rerank.relevance_labels(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


# ---- BM25 -------------------------------------------------------------------------------------------------------


@query(f"WITH {_INDEX} SELECT term, df, round(any_value(idf), 6) AS idf, sum(tf) AS cf FROM s GROUP BY term, df")
def bm25_index_stats(spark, sf_dir):
    index = search_postings(spark, sf_dir)
    return index.terms.select("term", "df", F.round(sparse.idf(F.lit(index.n), F.col("df")), 6).alias("idf"), F.col("cf").cast("decimal(38,0)").alias("cf"))


@query(f"WITH {_INDEX}, {_QUERIES} {_bm25(10)}")
def bm25_topk(spark, sf_dir):
    return _bm25_top(spark, sf_dir, 10)


@query(f"WITH {_INDEX}, {_QUERIES} " + _bm25(10, "t.lang = 'en' AND t.source IN ('src1', 'src2', 'src3', 'src4')"))
def bm25_filtered_topk(spark, sf_dir):
    return _bm25_top(spark, sf_dir, 10, (F.col("lang") == "en") & F.col("source").isin("src1", "src2", "src3", "src4"))


@query(f"WITH {_INDEX}, {_QUERIES}, best AS (SELECT qid, doc_id FROM ({_bm25(1)})) SELECT best.qid, best.doc_id, s.term, s.tf, s.df, round(s.idf, 6) AS idf, round(s.part, 6) AS part FROM best JOIN s USING (doc_id) JOIN qt ON qt.qid = best.qid AND qt.term = s.term")
def bm25_explain(spark, sf_dir):
    index, terms = search_postings(spark, sf_dir), sparse.query_terms(_questions(spark, sf_dir))
    return sparse.contributions(index, terms, sparse.search(index, terms, 1)).select("qid", "doc_id", "term", "tf", "df", F.round("idf", 6).alias("idf"), F.round("part", 6).alias("part"))


# ---- Vectors ----------------------------------------------------------------------------------------------------

_E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), eq AS (SELECT vec_id AS qid, label, v AS qvec FROM e WHERE vec_id % 20 = 0)"


def _vec_queries(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "label", F.col("embedding").alias("qvec"))


@query(f"WITH {_E} SELECT a.vec_id, round(list_dot_product(a.v, b.v), 6) AS dot, round(list_cosine_similarity(a.v, b.v), 6) AS cosine, round(list_distance(a.v, b.v), 5) AS distance, abs(list_distance(a.v, b.v) ** 2 - (2 - 2 * list_cosine_similarity(a.v, b.v))) < 1e-5 AS identity FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def vector_measures(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    pairs = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    a, b = F.col("a"), F.col("b")
    p = pairs.select("vec_id", vectors.dot(a, b).alias("d"), vectors.cosine(a, b).alias("c"), vectors.euclidean(a, b).alias("e"))
    return p.select("vec_id", F.round("d", 6).alias("dot"), F.round("c", 6).alias("cosine"), F.round("e", 5).alias("distance"), (F.abs(F.col("e") * F.col("e") - (2 - 2 * F.col("c"))) < 1e-5).alias("identity"))


@query(f"WITH {_E}, s AS (SELECT * FROM e) SELECT a.label, round(avg(list_cosine_similarity(a.v, b.v)), 6) AS mean, round(stddev_pop(list_cosine_similarity(a.v, b.v)), 6) AS deviation, count(*) AS pairs FROM s a JOIN s b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label")
def pairwise_cosine_stats(spark, sf_dir):
    m = vectors.pairwise_moments(table(spark, sf_dir, "embeddings"))
    return m.select("label", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"))


@query(f"WITH {_E} " + _ranked("SELECT eq.qid, e.vec_id, round(list_dot_product(eq.qvec, e.v), 6) AS score FROM eq, e", 10, key="vec_id"))
def knn_exact(spark, sf_dir):
    return vectors.exact_search(table(spark, sf_dir, "embeddings"), _vec_queries(spark, sf_dir), 10)


@query(f"WITH {_E} " + _ranked("SELECT eq.qid, e.vec_id, round(list_dot_product(eq.qvec, e.v), 6) AS score FROM eq JOIN e USING (label)", 10, key="vec_id"))
def knn_filtered(spark, sf_dir):
    return vectors.exact_search(table(spark, sf_dir, "embeddings"), _vec_queries(spark, sf_dir), 10, group="label")


def _ivf(spark, sf_dir, group=None):
    e, q = table(spark, sf_dir, "embeddings"), _vec_queries(spark, sf_dir)
    return vectors.inverted_file_search(e, q if group else q.drop("label"), vectors.fit_cells(e), 10, group=group)


@query(None)
def ivf_search(spark, sf_dir):
    """Cells are fitted, which SQL cannot do; the tests compare with a search of the same cells by plain loops, and recall with exact search."""
    return _ivf(spark, sf_dir)


@query(None)
def ann_recall(spark, sf_dir):
    """Recall at 10 of the inverted file against exact search, of all rows and within a label."""
    e, q = table(spark, sf_dir, "embeddings"), _vec_queries(spark, sf_dir)

    def of(group):
        exact = vectors.exact_search(e, q if group else q.drop("label"), 10, group=group).select("qid", "vec_id")
        met = exact.join(_ivf(spark, sf_dir, group).select("qid", "vec_id", F.lit(1).alias("hit")), ["qid", "vec_id"], "left")
        return met.groupBy("qid").agg((F.count("hit") / F.count("*")).alias("recall")).withColumn("filtered", F.lit(group is not None))

    r = union(of(None), of("label"))
    return r.groupBy("filtered").agg(F.round(F.avg("recall"), 6).alias("mean_recall"), F.round(F.min("recall"), 6).alias("least_recall"), F.count_if(F.col("recall") == 1).alias("perfect"), F.count("*").alias("queries"))


def _graph(spark, sf_dir):
    return graphs.Navigable.write(table(spark, sf_dir, "embeddings"), scratch(spark, "graph"), group="label")


@query(None)
def graph_search(spark, sf_dir):
    """Nearest rows by walking in stored graphs. Which rows are met follows from the graphs, so there is no SQL; recall is in graph_recall and in the tests."""
    return _graph(spark, sf_dir).search(_vec_queries(spark, sf_dir), 10).withColumnRenamed("key", "vec_id")


@query(None)
def graph_recall(spark, sf_dir):
    """Recall at 10 of the graphs against exact search, of all rows and within a label, and the share of rows that a query was compared with."""
    e, q = table(spark, sf_dir, "embeddings"), _vec_queries(spark, sf_dir)
    graph, n = _graph(spark, sf_dir), e.agg(F.count("*").alias("rows"))

    def of(group):
        asked = q if group else q.drop("label")
        walked = checkpointed(graph.walk(asked, 10, group=group))
        found = sparse.top(walked.where("key IS NOT NULL").select("qid", "key", F.round("score", 6).alias("score")), 10, key="key")
        exact = vectors.exact_search(e, asked, 10, group=group).select("qid", F.col("vec_id").alias("key"))
        recall = exact.join(found.select("qid", "key", F.lit(1).alias("hit")), ["qid", "key"], "left").groupBy("qid").agg((F.count("hit") / F.count("*")).alias("recall"))
        seen = walked.groupBy("qid").agg(F.sum("computed").alias("computed"))
        return recall.join(seen, "qid").withColumn("filtered", F.lit(group is not None))

    r = union(of(None), of("label")).groupBy("filtered").agg(F.round(F.avg("recall"), 6).alias("mean_recall"), F.round(F.min("recall"), 6).alias("least_recall"), F.avg("computed").alias("compared"), F.count("*").alias("queries"))
    return r.crossJoin(F.broadcast(n)).select("filtered", "mean_recall", "least_recall", F.round(F.col("compared") / F.col("rows"), 6).alias("compared_share"), "queries")


@query(None)
def store_overlap(spark, sf_dir):
    """Two stores of the same vectors, exact and product-quantised: rows that both return among their ten, over all rows and within a label, and the bytes of a vector in each."""
    e, q = table(spark, sf_dir, "embeddings"), _vec_queries(spark, sf_dir)
    store = quantized.Quantized.write(e, scratch(spark, "codes"), group="label")

    def of(group):
        asked = q if group else q.drop("label")
        exact = vectors.exact_search(e, asked, 10, group=group).select("qid", F.col("vec_id").alias("key"))
        both = exact.join(store.search(asked, 10, group).select("qid", "key", F.lit(1).alias("hit")), ["qid", "key"], "left")
        return both.groupBy("qid").agg(F.count("hit").alias("shared"), (F.count("hit") / F.count("*")).alias("overlap")).withColumn("filtered", F.lit(group is not None))

    sizes = e.where("embedding IS NOT NULL").agg(F.max(F.size("embedding") * 4).alias("exact_bytes")).crossJoin(F.broadcast(store.codes.agg(F.max(F.octet_length("code")).alias("code_bytes"))))
    each = union(of(None), of("label")).groupBy("filtered").agg(F.round(F.avg("overlap"), 6).alias("mean_overlap"), F.min("shared").alias("least_shared"), F.count("*").alias("queries"))
    return each.crossJoin(F.broadcast(sizes))


@query(f"WITH q AS (SELECT item_id AS qid, text AS question FROM benchmark), {_Q_EMBED} SELECT qid, CAST(len(qvec) AS BIGINT) AS dims, round(list_dot_product(qvec, list_transform(range(64), lambda i: CAST(i AS DOUBLE))), 6) AS moment, round(list_dot_product(qvec, qvec), 6) AS norm FROM qv")
def embed_text(spark, sf_dir):
    v = vectors.embed(_questions(spark, sf_dir).select("qid", T.tokens(F.col("question")).alias("t")), "qid", "t", "v")
    ramp = F.sequence(F.lit(0), F.lit(63))
    return v.select("qid", F.size("v").cast("long").alias("dims"), F.round(vectors.dot(F.col("v"), ramp), 6).alias("moment"), F.round(vectors.dot(F.col("v"), F.col("v")), 6).alias("norm"))


@query("WITH c AS (SELECT doc_id, md5('hash64::' || text) AS k FROM documents), kept AS (SELECT DISTINCT k FROM c WHERE doc_id % 3 = 0) SELECT count(*) AS rows, count(DISTINCT k) AS to_embed FROM c WHERE k NOT IN (SELECT k FROM kept)")
def embedding_cache_misses(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.concat(F.lit("hash64::"), F.col("text")).cast("binary")).alias("k"))
    return c.join(c.where("doc_id % 3 = 0").select("k").distinct(), "k", "left_anti").agg(F.count("*").alias("rows"), F.count_distinct("k").alias("to_embed"))


@query("SELECT item_id, md5('Represent this sentence for searching relevant passages: ' || text) AS prefixed FROM benchmark")
def query_prefix(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(F.concat(F.lit("Represent this sentence for searching relevant passages: "), F.col("text")).cast("binary")).alias("prefixed"))


@query(f"WITH {_E}, m AS (SELECT vec_id, {_unit('v[1:16]')} AS w FROM e) " + _ranked("SELECT a.vec_id AS qid, b.vec_id, round(list_dot_product(a.w, b.w), 6) AS score FROM m a, m b WHERE a.vec_id % 20 = 0", 5, key="vec_id"))
def matryoshka_topk(spark, sf_dir):
    short = table(spark, sf_dir, "embeddings").select("vec_id", vectors.unit(F.slice("embedding", 1, 16)).alias("embedding"))
    return vectors.exact_search(short, short.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")), 5)


@query(f"WITH {_E}, p AS ({_ranked('SELECT eq.qid, e.vec_id, round(list_dot_product(eq.qvec, e.v), 6) AS score FROM eq, e WHERE e.vec_id <> eq.qid', 1, key='vec_id')}) SELECT qid, vec_id, score, score >= 0.5 AS near FROM p")
def near_pairs(spark, sf_dir):
    found = vectors.exact_search(table(spark, sf_dir, "embeddings"), _vec_queries(spark, sf_dir), 2).where("vec_id != qid")
    return sparse.top(found.drop("rank"), 1, key="vec_id").select("qid", "vec_id", "score", (F.col("score") >= 0.5).alias("near"))


# ---- Fusion -----------------------------------------------------------------------------------------------------

_HYBRID = f"WITH {_INDEX}, {_QUERIES}, {_DENSE}, {_LISTS}"


@query(f"{_HYBRID}, f AS ({_rrf_sql('lists', 10)}) SELECT f.qid, f.doc_id, f.rrf_score, f.rank, max(CASE WHEN list = 'bm25' THEN lists.rank END) AS bm25_rank, max(CASE WHEN list = 'dense' THEN lists.rank END) AS dense_rank FROM f JOIN lists USING (qid, doc_id) GROUP BY ALL")
def rrf_hybrid(spark, sf_dir):
    lists = _both(spark, sf_dir)
    w = Window.partitionBy("qid").orderBy(F.desc("rrf_score"), "doc_id")
    each = lambda name: F.max(F.when(F.col("list") == name, F.col("rank"))).alias(f"{name}_rank")
    fused = lists.groupBy("qid", "doc_id").agg(F.round(F.sum(1.0 / (fusion.RANK_OFFSET + F.col("rank"))), 6).alias("rrf_score"), each("bm25"), each("dense"))
    return fused.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("qid", "doc_id", "rrf_score", "rank", "bm25_rank", "dense_rank")


@query(f"{_HYBRID} SELECT qid, doc_id, list, rank, '1/(60+' || rank || ')' AS part FROM lists WHERE rank <= 3")
def rrf_worked_example(spark, sf_dir):
    return _both(spark, sf_dir).where("rank <= 3").select("qid", "doc_id", "list", "rank", F.concat(F.lit("1/(60+"), F.col("rank").cast("string"), F.lit(")")).alias("part"))


@query(f"{_HYBRID}, m AS (SELECT *, min(score) OVER (PARTITION BY qid, list) AS lo, max(score) OVER (PARTITION BY qid, list) AS hi FROM lists) " + _ranked("SELECT qid, doc_id, round(sum((CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END) * (CASE list WHEN 'bm25' THEN 0.4 ELSE 0.6 END)), 6) AS fused FROM m GROUP BY ALL", 10, "fused"))
def score_fusion(spark, sf_dir):
    return fusion.weighted_scores(_both(spark, sf_dir), {"bm25": 0.4, "dense": 0.6}, 10)


_HALF = f"CAST(len({tokens_sql('question')}) // 2 AS BIGINT)"
_VARIANTS = f"""qt2 AS (SELECT qid * 10 + i AS qid, unnest(list_distinct(CASE i WHEN 0 THEN {tokens_sql('question')} WHEN 1 THEN {tokens_sql('question')}[1:{_HALF}] ELSE {tokens_sql('question')}[{_HALF} + 1:] END)) AS term FROM q, (VALUES (0), (1), (2)) AS _i(i))"""


def _variants(spark, sf_dir):
    """qid * 10 + variant, t: the whole question and its halves, which stand for a rewriter's variants."""
    toks = T.tokens(F.col("question"))
    half = F.floor(F.size(toks) / 2).cast("int")
    parts = F.array(toks, F.slice(toks, F.lit(1), half), F.slice(toks, half + 1, F.size(toks)))
    return _questions(spark, sf_dir).select("qid", F.posexplode(parts).alias("v", "t")).select((F.col("qid") * 10 + F.col("v")).alias("qid"), "t")


@query(f"WITH {_INDEX}, {_QUERIES}, {_VARIANTS}, v AS (SELECT qid // 10 AS qid, doc_id, rank FROM ({_bm25(20, terms='qt2')})), cand AS ({_rrf_sql('v', 20)}), rr AS (SELECT c.qid, c.doc_id, c.rank AS first_rank, {{RERANK}} AS rerank_score FROM cand c JOIN q USING (qid) JOIN t USING (doc_id)) ".replace("{RERANK}", _RERANK_SQL) + _ranked("SELECT qid, doc_id, first_rank, rerank_score FROM rr", 10, "rerank_score"))
def multi_query_fusion(spark, sf_dir):
    """Each variant is searched without reranking, the lists are fused, and one rerank is against the original question."""
    terms = _variants(spark, sf_dir).select("qid", F.explode(F.array_distinct("t")).alias("term"))
    found = sparse.search(search_postings(spark, sf_dir), terms, 20).select(F.floor(F.col("qid") / 10).alias("qid"), "doc_id", "rank")
    fused = fusion.reciprocal_rank(found, 20).select("qid", "doc_id", F.col("rank").alias("first_rank"))
    return sparse.top(rerank.cross_scores(fused, _questions(spark, sf_dir), search_index(spark, sf_dir)), 10, "rerank_score")


_FAN = f"""fan AS (SELECT *, row_number() OVER (PARTITION BY qid, lang ORDER BY score DESC, doc_id) AS rank FROM (SELECT qt.qid, t.lang, s.doc_id, round(sum(s.part), 6) AS score FROM s JOIN qt USING (term) JOIN t USING (doc_id) GROUP BY ALL HAVING round(sum(s.part), 6) > 0) QUALIFY rank <= 4)"""


def _fan(spark, sf_dir):
    return sparse.search(search_postings(spark, sf_dir), sparse.query_terms(_questions(spark, sf_dir)), 4, group="lang")


@query(f"WITH {_INDEX}, {_QUERIES}, {_FAN}, g AS (SELECT qid, min(n) AS even FROM (SELECT qid, lang, max(rank) AS n FROM fan GROUP BY ALL) GROUP BY qid) SELECT qid, doc_id, lang, rank, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN rank <= even THEN 0 ELSE 1 END, CASE WHEN rank <= even THEN rank ELSE 0 END, lang, rank) AS position FROM fan JOIN g USING (qid)")
def fanout_interleave(spark, sf_dir):
    return fusion.interleave_then_tails(_fan(spark, sf_dir), "lang").select("qid", "doc_id", "lang", "rank", "position")


@query(f"WITH {_INDEX}, {_QUERIES}, {_FAN} SELECT qid, doc_id, lang, rank, row_number() OVER (PARTITION BY qid ORDER BY rank, lang) AS position FROM fan")
def round_robin(spark, sf_dir):
    return fusion.interleave(_fan(spark, sf_dir), "lang").select("qid", "doc_id", "lang", "rank", "position")


@query(f"WITH {_INDEX}, {_QUERIES}, {_VARIANTS}, want AS (SELECT * FROM (VALUES (0, NULL), (1, 'en'), (2, 'fr')) AS _w(sub, lang)), r AS ({_ranked('SELECT qt2.qid, s.doc_id, round(sum(s.part), 6) AS score FROM s JOIN qt2 USING (term) JOIN t USING (doc_id) JOIN want ON want.sub = qt2.qid % 10 WHERE want.lang IS NULL OR t.lang = want.lang GROUP BY ALL HAVING round(sum(s.part), 6) > 0', 20)}), f AS (SELECT * FROM (SELECT a.qid // 10 AS qid, a.qid % 10 AS sub, a.doc_id, round(1.0 / (60 + a.rank) + coalesce(1.0 / (60 + b.rank), 0), 6) AS rrf_score FROM r a LEFT JOIN r b ON b.qid = a.qid // 10 * 10 AND b.doc_id = a.doc_id WHERE a.qid % 10 > 0) QUALIFY row_number() OVER (PARTITION BY qid, sub ORDER BY rrf_score DESC, doc_id) <= 3) SELECT qid, sub, doc_id, rrf_score, row_number() OVER (PARTITION BY qid, sub ORDER BY rrf_score DESC, doc_id) AS rank FROM f")
def plan_retrieval(spark, sf_dir):
    """max(2, 6 // 2) passages for each of two sub-questions with its own filter; a sub-question's list is fused with that of the original question, among what passes the filter."""
    index, variants = search_postings(spark, sf_dir), _variants(spark, sf_dir)
    terms = variants.select("qid", F.explode(F.array_distinct("t")).alias("term"))
    whole = sparse.search(index, terms.where("qid % 10 = 0"), 20).select((F.col("qid") / 10).cast("long").alias("qid"), "doc_id", F.col("rank").alias("whole"))
    want = F.when(F.col("qid") % 10 == 1, F.lit("en")).otherwise(F.lit("fr"))
    subs = sparse.search(index, terms.where("qid % 10 > 0"), 20, group="lang").where(F.col("lang") == want)
    each = subs.select(F.floor(F.col("qid") / 10).alias("qid"), (F.col("qid") % 10).alias("sub"), "doc_id", "rank").join(whole, ["qid", "doc_id"], "left")
    fused = each.withColumn("rrf_score", F.round(1.0 / (fusion.RANK_OFFSET + F.col("rank")) + F.coalesce(1.0 / (fusion.RANK_OFFSET + F.col("whole")), F.lit(0.0)), 6))
    return sparse.top(fused.drop("rank", "whole"), max(2, 6 // 2), "rrf_score", ("qid", "sub")).select("qid", "sub", "doc_id", "rrf_score", "rank")


@query(f"WITH {_INDEX}, q AS (SELECT item_id AS qid, text || ' ' || text AS question FROM benchmark), {_DENSE} " + _ranked("SELECT qid, doc_id, round(list_dot_product(qvec, vec), 6) AS score FROM qv, dv", 5))
def hyde_dense(spark, sf_dir):
    """The dense side gets a drafted passage in place of the question; here the item's text twice stands for the draft."""
    draft = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), T.tokens(F.concat_ws(" ", "text", "text")).alias("t"))
    return vectors.exact_search(_vectors(spark, sf_dir), vectors.embed(draft, "qid", "t", "qvec"), 5, key="doc_id")


@query(f"WITH {_INDEX}, {_QUERIES}, v AS (SELECT qid, doc_id, rank FROM ({_bm25(50)})) SELECT *, 'dense retrieval failed' AS degraded FROM ({_rrf_sql('v', 5)})")
def degraded_to_sparse(spark, sf_dir):
    """Without the dense side the sparse list alone is fused, and the rows say so."""
    return fusion.reciprocal_rank(_bm25_top(spark, sf_dir), 5).withColumn("degraded", F.lit("dense retrieval failed"))


# ---- Reranking --------------------------------------------------------------------------------------------------

_CROSS = f"""cand AS (SELECT qid, doc_id, rank AS first_rank FROM ({_bm25(50)})), rr AS (SELECT c.qid, c.doc_id, c.first_rank, {_RERANK_SQL} AS rerank_score FROM cand c JOIN q USING (qid) JOIN t USING (doc_id))"""
_RERANK = f"WITH {_INDEX}, {_QUERIES}, {_CROSS}"


def _reranked(spark, sf_dir):
    cand = _bm25_top(spark, sf_dir).select("qid", "doc_id", F.col("rank").alias("first_rank"))
    return rerank.cross_scores(cand, _questions(spark, sf_dir), search_index(spark, sf_dir))


@query(f"{_RERANK} " + _ranked("SELECT qid, doc_id, first_rank, rerank_score FROM rr", 5, "rerank_score"))
def rerank_topk(spark, sf_dir):
    return sparse.top(_reranked(spark, sf_dir), 5, "rerank_score")


@query(f"{_RERANK} SELECT q.qid, round(max(rerank_score), 6) AS best, coalesce(max(rerank_score) < -3.0, true) AS refused FROM q LEFT JOIN rr USING (qid) GROUP BY q.qid")
def relevance_floor(spark, sf_dir):
    return rerank.below_floor(_questions(spark, sf_dir).select("qid"), _reranked(spark, sf_dir), -3.0)


@query(f"{_RERANK}, b AS (SELECT qid, max(rerank_score) AS best FROM rr GROUP BY qid) SELECT CAST(floor AS DOUBLE) AS floor, count_if(qid % 2 = 0 AND best >= floor) AS kept, count_if(qid % 2 = 1 AND best < floor) AS blocked FROM b, (VALUES (-4.0), (-3.0), (-2.0), (0.0), (2.0)) AS _f(floor) GROUP BY floor")
def floor_sweep(spark, sf_dir):
    best = _reranked(spark, sf_dir).groupBy("qid").agg(F.max("rerank_score").alias("best"))
    floors = spark.createDataFrame([(x,) for x in (-4.0, -3.0, -2.0, 0.0, 2.0)], "floor double")
    inside = F.col("qid") % 2 == 0
    return best.crossJoin(F.broadcast(floors)).groupBy("floor").agg(F.count_if(inside & (F.col("best") >= F.col("floor"))).alias("kept"), F.count_if(~inside & (F.col("best") < F.col("floor"))).alias("blocked"))


@query(f"{_RERANK}, {_LABELS}, dep AS (SELECT * FROM (VALUES (5), (10), (50)) AS _n(depth)), o AS (SELECT depth, qid, doc_id, row_number() OVER (PARTITION BY depth, qid ORDER BY rerank_score DESC, doc_id) AS r FROM rr, dep WHERE first_rank <= depth), f AS (SELECT depth, qid, min(r) AS first FROM o JOIN labels_ USING (qid, doc_id) WHERE r <= 5 GROUP BY ALL) SELECT dep.depth, count(f.qid) AS hits, round(coalesce(sum(1.0 / f.first), 0) / (SELECT count(*) FROM benchmark), 6) AS mrr FROM dep LEFT JOIN f USING (depth) GROUP BY dep.depth")
def depth_sweep(spark, sf_dir):
    depths = spark.createDataFrame([(5,), (10,), (50,)], "depth int")
    ranked = sparse.top(_reranked(spark, sf_dir).crossJoin(F.broadcast(depths)).where("first_rank <= depth"), 5, "rerank_score", ("depth", "qid"))
    first = ranked.join(_labels(spark, sf_dir), ["qid", "doc_id"]).groupBy("depth", "qid").agg(F.min("rank").alias("first"))
    n = _questions(spark, sf_dir).agg(F.count("*").alias("n"))
    sums = depths.join(first.groupBy("depth").agg(F.count("*").alias("hits"), F.sum(1.0 / F.col("first")).alias("s")), "depth", "left").crossJoin(F.broadcast(n))
    return sums.select("depth", F.coalesce("hits", F.lit(0)).alias("hits"), F.round(F.coalesce("s", F.lit(0.0)) / F.col("n"), 6).alias("mrr"))


# ---- The whole retriever ------------------------------------------------------------------------------------------


def _vectors(spark, sf_dir):
    """Every document's tokens, which a search embeds as it reads them; a null text has none, and the vector of none."""
    return search_index(spark, sf_dir).select("doc_id", F.coalesce("words", F.lit("")).alias("embedding"))


def _retrieved_sql(where: str, k: int) -> str:
    """found(qid, doc_id, bm25_rank, dense_rank, rrf_score, fused_rank, rerank_score, rank)."""
    lists = f"hl AS (SELECT 'bm25' AS list, qid, doc_id, rank FROM ({_bm25(50, where)}) UNION ALL SELECT 'dense', qid, doc_id, rank FROM ({_ranked(f'SELECT qid, doc_id, round(list_dot_product(qvec, vec), 6) AS score FROM qv, dv JOIN t USING (doc_id) WHERE {where}', 50)}))"
    return f"""{lists}, hf AS ({_rrf_sql('hl', 50)}), hr AS (SELECT f.qid, f.doc_id, f.rrf_score, f.rank AS fused_rank, {_RERANK_SQL} AS rerank_score FROM hf f JOIN q USING (qid) JOIN t USING (doc_id)),
found AS (SELECT r.*, (SELECT max(rank) FROM hl WHERE hl.list = 'bm25' AND hl.qid = r.qid AND hl.doc_id = r.doc_id) AS bm25_rank, (SELECT max(rank) FROM hl WHERE hl.list = 'dense' AND hl.qid = r.qid AND hl.doc_id = r.doc_id) AS dense_rank FROM ({_ranked('SELECT * FROM hr', k, 'rerank_score')}) r)"""


@query(f"WITH {_INDEX}, {_QUERIES}, {_DENSE}, {_retrieved_sql(chr(39) + 'en' + chr(39) + ' = t.lang', 5)} SELECT qid, doc_id, bm25_rank, dense_rank, rrf_score, fused_rank, rerank_score, rank, CAST(NULL AS VARCHAR) AS degraded FROM found")
def hybrid_retrieval(spark, sf_dir):
    """Filter, BM25 beside dense, fusion, cut at 50, rerank, five passages, with the rank of every stage."""
    return retriever.retrieve(search_postings(spark, sf_dir), None, _questions(spark, sf_dir), 5, where=F.col("lang") == "en")


@query(f"WITH {_INDEX}, {_QUERIES}, v AS (SELECT qid, doc_id, rank FROM ({_bm25(50)})), f AS ({_rrf_sql('v', 5)}) SELECT qid, doc_id, rank AS bm25_rank, CAST(NULL AS INTEGER) AS dense_rank, rrf_score, rank AS fused_rank, CAST(NULL AS DOUBLE) AS rerank_score, rank, 'dense retrieval failed: ConnectionError' AS degraded FROM f")
def degraded_retrieval(spark, sf_dir):
    """The embedder raises: the sparse list alone is fused, and the rows say why."""

    def refuses(_):
        raise ConnectionError("no embedder")

    return retriever.retrieve(search_postings(spark, sf_dir), None, _questions(spark, sf_dir), 5, reranked=False, embedder=refuses)


@query(None)
def hybrid_variants(spark, sf_dir):
    """Halves of each question beside the whole one, both kinds of search for each, and one rerank against the whole question."""
    named = _variants_text(spark, sf_dir)
    return retriever.retrieve_variants(search_postings(spark, sf_dir), None, named, _questions(spark, sf_dir), 5)


@query(None)
def hybrid_plan(spark, sf_dir):
    """Two sub-questions with a language each: max(2, 6 // 2) passages for each, fused with the original question's."""
    subs = _variants_text(spark, sf_dir).where("variant > 0").select("qid", F.col("variant").alias("sub"), "question", F.when(F.col("variant") == 1, F.lit("en")).otherwise(F.lit("fr")).alias("lang"))
    return retriever.retrieve_plan(search_postings(spark, sf_dir), None, subs, _questions(spark, sf_dir), 6, filters=("lang",))


def _variants_text(spark, sf_dir):
    words = F.split("question", " ")
    half = F.floor(F.size(words) / 2).cast("int")
    parts = F.array(F.col("question"), F.array_join(F.slice(words, F.lit(1), half), " "), F.array_join(F.slice(words, half + 1, F.size(words)), " "))
    return _questions(spark, sf_dir).select("qid", F.posexplode(parts).alias("variant", "question"))


# ---- Labels and metrics -----------------------------------------------------------------------------------------


@query(f"WITH {_LABELS} SELECT * FROM labels_")
def relevance_labels(spark, sf_dir):
    return _labels(spark, sf_dir)


def _metrics_sql(k: int, ranked: str, labels: str = "labels_") -> str:
    return f"""best AS (SELECT qid, doc_id, min(rank) AS rank FROM ({ranked}) WHERE rank <= {k} GROUP BY ALL), h AS (SELECT qid, count(*) AS found, min(rank) AS first, sum((2 ** grade - 1) / log2(rank + 1)) AS dcg FROM best JOIN {labels} USING (qid, doc_id) GROUP BY qid),
i AS (SELECT qid, count(*) AS relevant, sum(CASE WHEN r <= {k} THEN (2 ** grade - 1) / log2(r + 1) END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, doc_id) AS r FROM {labels}) GROUP BY qid),
m AS (SELECT q.qid, round(coalesce(found / relevant, 0), 6) AS recall, round(coalesce(found / {k}.0, 0), 6) AS precision, CASE WHEN found > 0 THEN 1.0 ELSE 0.0 END AS hit, round(coalesce(1.0 / first, 0), 6) AS mrr, round(coalesce(dcg / idcg, 0), 6) AS ndcg FROM q LEFT JOIN i USING (qid) LEFT JOIN h USING (qid))"""


def _metrics(spark, sf_dir):
    return metrics.per_query(_bm25_top(spark, sf_dir, 10), _labels(spark, sf_dir), 10, _questions(spark, sf_dir).select("qid"))


@query(f"WITH {_INDEX}, {_QUERIES}, {_LABELS}, {_metrics_sql(10, _bm25(10))} SELECT * FROM m")
def retrieval_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir)


CASES = Fixture("qid long, doc_id long, rank int", [(1, 5, 1), (1, 6, 2), (1, 5, 3), (2, 7, 1), (2, 8, 2), (3, 9, 1)])
CASE_LABELS = Fixture("qid long, doc_id long, grade int", [(1, 6, 1), (1, 5, 2), (2, 99, 1), (3, 9, 1), (3, 10, 2), (3, 11, 1), (4, 1, 1)])


@query(f"WITH q AS (SELECT * FROM (VALUES (1), (2), (3), (4), (5)) AS _q(qid)), cl AS (SELECT * FROM {CASE_LABELS.sql}), {_metrics_sql(3, f'SELECT * FROM {CASES.sql}', 'cl')} SELECT CAST(qid AS BIGINT) AS qid, recall, precision, hit, mrr, ndcg FROM m")
def metric_cases(spark, sf_dir):
    return metrics.per_query(CASES.df(spark), CASE_LABELS.df(spark), 3, spark.range(1, 6).withColumnRenamed("id", "qid"))


@query(f"WITH {_INDEX}, {_QUERIES}, {_LABELS} SELECT qid, count(DISTINCT CASE WHEN rank <= 10 THEN source END) AS covered, count(DISTINCT source) AS wanted FROM (SELECT labels_.qid, d.source, r.rank FROM labels_ JOIN documents d USING (doc_id) LEFT JOIN ({_bm25(10)}) r ON r.qid = labels_.qid AND r.doc_id = labels_.doc_id) GROUP BY qid")
def entity_coverage(spark, sf_dir):
    found = _bm25_top(spark, sf_dir, 10).select("qid", "doc_id", "rank")
    rel = _labels(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").join(found, ["qid", "doc_id"], "left")
    return rel.groupBy("qid").agg(F.count_distinct(F.when(F.col("rank") <= 10, F.col("source"))).alias("covered"), F.count_distinct("source").alias("wanted"))


@query(f"WITH {_INDEX}, {_QUERIES}, {_LABELS}, {_metrics_sql(10, _bm25(10))} SELECT 'bm25' AS config, CASE WHEN grouping(kind) = 1 THEN 'all' ELSE kind END AS kind, count(*) AS queries, round(avg(ndcg), 6) AS ndcg, round(avg(hit), 6) AS hit FROM (SELECT *, CASE qid % 3 WHEN 0 THEN 'numeric' WHEN 1 THEN 'text' ELSE 'comparison' END AS kind FROM m) GROUP BY GROUPING SETS ((), (kind))")
def metrics_by_type(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("numeric"), F.lit("text"), F.lit("comparison")), (F.col("qid") % 3 + 1).cast("int"))
    m = _metrics(spark, sf_dir).withColumn("kind", kind)
    return m.groupingSets([[], ["kind"]], "kind").agg(F.when(F.grouping("kind") == 1, F.lit("all")).otherwise(F.col("kind")).alias("type"), F.count("*").alias("queries"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg("hit"), 6).alias("hit")).select(F.lit("bm25").alias("config"), F.col("type").alias("kind"), "queries", "ndcg", "hit")


@query(f"{_HYBRID}, {_LABELS}, s2 AS (SELECT 'bm25' AS strategy, qid, doc_id, rank FROM lists WHERE list = 'bm25' UNION ALL SELECT 'dense', qid, doc_id, rank FROM lists WHERE list = 'dense' UNION ALL SELECT 'rrf', qid, doc_id, rank FROM ({_rrf_sql('lists', 50)})), f AS (SELECT strategy, qid, min(rank) AS first FROM s2 JOIN labels_ USING (qid, doc_id) GROUP BY ALL), lq AS (SELECT DISTINCT qid FROM labels_) SELECT x.strategy, count(*) AS probes, count_if(first <= 5) AS hit5, count_if(first <= 50) AS hit50, round(sum(CASE WHEN first <= 5 THEN 1.0 / first ELSE 0 END) / count(*), 6) AS mrr5 FROM (SELECT DISTINCT strategy FROM s2) x CROSS JOIN lq LEFT JOIN f ON f.strategy = x.strategy AND f.qid = lq.qid GROUP BY x.strategy")
def probe_runner(spark, sf_dir):
    lists = _both(spark, sf_dir)
    runs = union(lists.select(F.col("list").alias("strategy"), "qid", "doc_id", "rank"), fusion.reciprocal_rank(lists, 50).select(F.lit("rrf").alias("strategy"), "qid", "doc_id", "rank"))
    labels = _labels(spark, sf_dir)
    first = runs.join(labels, ["qid", "doc_id"]).groupBy("strategy", "qid").agg(F.min("rank").alias("first"))
    each = labels.select("qid").distinct().crossJoin(F.broadcast(spark.createDataFrame([("bm25",), ("dense",), ("rrf",)], "strategy string")))
    return each.join(first, ["strategy", "qid"], "left").groupBy("strategy").agg(
        F.count("*").alias("probes"), F.count_if(F.col("first") <= 5).alias("hit5"), F.count_if(F.col("first") <= 50).alias("hit50"), F.round(F.sum(F.when(F.col("first") <= 5, 1.0 / F.col("first")).otherwise(0.0)) / F.count("*"), 6).alias("mrr5")
    )


@query(None)
def config_table(spark, sf_dir):
    """Mean nDCG of each configuration with its interval, and its difference from BM25 with the share of resamples that are not better."""
    lists, labels, asked = _both(spark, sf_dir), _labels(spark, sf_dir), _questions(spark, sf_dir).select("qid")
    runs = {"bm25": lists.where("list = 'bm25'"), "dense": lists.where("list = 'dense'"), "rrf": fusion.reciprocal_rank(lists, 50)}
    each = union(*(metrics.per_query(r.select("qid", "doc_id", "rank"), labels, 10, asked).select(F.lit(name).alias("config"), "qid", "ndcg") for name, r in runs.items()))
    paired = each.join(each.where("config = 'bm25'").select("qid", F.col("ndcg").alias("base")), "qid")
    return statistics.compared_by_group(paired, "config", "qid", "ndcg", "base", 500)
