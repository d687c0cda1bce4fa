"""The hybrid retriever over a batch of questions: filter, BM25 beside dense, fusion, cut, rerank; every stage's rank is kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.functions.text import tokens
from docquarry.operators import fusion, rerank, sparse, vectors
from docquarry.session import checkpointed, union

#: Places of each list that are fused, and fused places that are reranked.
POOL = 50


def embed_questions(questions: DataFrame) -> DataFrame:
    """qid, qvec by the default embedder."""
    return vectors.embed(questions.select("qid", tokens(F.col("question")).alias("t")), "qid", "t", "qvec")


def _own_tokens(docs: DataFrame) -> Column:
    """The tokens of an index's documents as one string, none for a null text."""
    return F.coalesce(F.col("words") if "words" in docs.columns else F.array_join("toks", " "), F.lit(""))


def lists(index: DataFrame, embedded: DataFrame | None, questions: DataFrame, pool: int = POOL, where: Column | None = None, embedder: Callable[[DataFrame], DataFrame] = embed_questions) -> tuple[DataFrame, str | None]:
    """list (bm25, dense), qid, doc_id, score, rank; and why the dense side is missing, if it is.

    index and embedded (doc_id, embedding) are of the same documents; the filter is on columns of the index. Without
    embedded the search embeds the index's tokens as it reads them, so that no vectors are joined with a filter. An
    embedder that fails costs the dense list only: the search goes on without it and says so.
    """
    sparse_list = sparse.search(index, sparse.query_terms(questions), pool, where).withColumn("list", F.lit("bm25"))
    try:
        asked = embedder(questions)
    except Exception as e:  # whatever a remote embedder raises, and nothing else
        return sparse_list, f"dense retrieval failed: {type(e).__name__}"
    docs = sparse.documents_of(index)
    inside = docs if where is None else docs.where(where)
    inside = inside.select("doc_id", _own_tokens(docs).alias("embedding")) if embedded is None else embedded if where is None else embedded.join(inside.select("doc_id"), "doc_id", "left_semi")
    dense_list = vectors.exact_search(inside, asked, pool, key="doc_id").withColumn("list", F.lit("dense"))
    return union(sparse_list, dense_list), None


def fused(found: DataFrame, pool: int = POOL) -> DataFrame:
    """qid, doc_id, bm25_rank, dense_rank, rrf_score, fused_rank of the best `pool` of each question."""
    each = [F.max(F.when(F.col("list") == name, F.col("rank"))).alias(f"{name}_rank") for name in ("bm25", "dense")]
    scored = found.groupBy("qid", "doc_id").agg(F.round(F.sum(1.0 / (fusion.RANK_OFFSET + F.col("rank"))), 6).alias("rrf_score"), *each)
    return sparse.top(scored, pool, "rrf_score").withColumnRenamed("rank", "fused_rank")


def retrieve(index: DataFrame, embedded: DataFrame | None, questions: DataFrame, k: int = 5, pool: int = POOL, where: Column | None = None, reranked: bool = True, embedder: Callable[[DataFrame], DataFrame] = embed_questions) -> DataFrame:
    """qid, doc_id, bm25_rank, dense_rank, rrf_score, fused_rank, rerank_score, rank, degraded: the k passages of each question (qid, question)."""
    found, degraded = lists(index, embedded, questions, pool, where, embedder)
    cut = fused(found, pool)
    if reranked:
        best = sparse.top(rerank.cross_scores(cut, questions, index), k, "rerank_score")
    else:
        best = cut.where(F.col("fused_rank") <= k).withColumns({"rerank_score": F.lit(None).cast("double"), "rank": F.col("fused_rank")})
    return best.withColumn("degraded", F.lit(degraded).cast("string"))


def retrieve_variants(index: DataFrame, embedded: DataFrame | None, variants: DataFrame, questions: DataFrame, k: int = 5, pool: int = POOL, where: Column | None = None) -> DataFrame:
    """variants: qid, variant, question. Each variant is retrieved without reranking, the fused lists are fused again, and one rerank is against the original question."""
    named = variants.withColumn("whole", F.struct("qid", "variant")).withColumn("n", F.xxhash64("qid", "variant"))
    found, _ = lists(index, embedded, named.select(F.col("n").alias("qid"), "question"), pool, where)
    each = fused(found, pool).withColumnRenamed("qid", "n").join(named.select("n", "qid"), "n").select("qid", "doc_id", F.col("fused_rank").alias("rank"))
    cut = fusion.reciprocal_rank(each, pool).withColumnRenamed("rank", "fused_rank")
    return sparse.top(rerank.cross_scores(cut, questions, index), k, "rerank_score")


def retrieve_plan(
    index: DataFrame, embedded: DataFrame | None, subs: DataFrame, questions: DataFrame, k: int = 6, pool: int = POOL, filters: tuple[str, ...] | dict[str, Column] = (), reranked: bool = False,
) -> DataFrame:
    """qid, sub, doc_id, rrf_score, rank (and rerank_score): for each sub-question max(2, k // n) passages that pass its own filter.

    subs: qid, sub, question and the columns of `filters`, each a value, or an array of values any of which will do, of
    the index's column of that name, or of the column given for it (null, or none: any). The fused list of a
    sub-question that is not the original question itself is fused with that of the original, among what passes the
    filter. reranked: the passages are the best of the fused ones for the sub-question, and in that order.
    """
    values = filters if isinstance(filters, dict) else {c: F.col(c) for c in filters}
    several = [c for c in values if subs.schema[c].dataType.typeName() == "array"]
    named = checkpointed(subs.join(questions.select("qid", F.col("question").alias("_whole")), "qid", "left").withColumn("n", F.xxhash64("qid", "sub")))
    each = named
    for c in several:
        each = each.withColumn(c, F.explode_outer(F.when(F.size(c) > 0, F.array_distinct(c))))
    each = checkpointed(each.withColumn("m", F.xxhash64("n", *several) if several else F.col("n")))
    # Searches by which columns are filtered on at all: as many as there are subsets, whatever the plan; those of no sub-question are left out.
    out = []
    for chosen in [c for size in range(len(values) + 1) for c in combinations(values, size)]:
        own = F.lit(True)
        for c in values:
            own = own & (F.col(c).isNotNull() if c in chosen else F.col(c).isNull())
        asked = each.where(own).withColumn(FILTER, _filter_value([F.col(c) for c in chosen]))
        whole = asked.where(F.col("_whole").isNotNull() & ~F.col("_whole").eqNullSafe(F.col("question"))).withColumn("question", F.col("_whole"))
        for one in (asked, whole):
            if not one.isEmpty():
                found = _filtered_lists(index, embedded, one.select(F.col("m").alias("qid"), "question", FILTER), pool, [values[c] for c in chosen])
                if several:
                    found = sparse.top(found.drop("rank").withColumnRenamed("qid", "m").join(one.select("m", F.col("n").alias("qid")), "m").drop("m"), pool, by=("list", "qid"))
                out.append(fused(found, pool).withColumnRenamed("qid", "n").select("n", "doc_id", F.col("fused_rank").alias("rank")))
    none = named.select("n", F.lit(None).cast(sparse.documents_of(index).schema["doc_id"].dataType).alias("doc_id"), F.lit(0).alias("rank")).limit(0)
    ranked = fusion.reciprocal_rank(union(*out, none), pool, ("n",))
    if reranked:
        scored = rerank.cross_scores(ranked.drop("rank").withColumnRenamed("n", "qid"), named.select(F.col("n").alias("qid"), "question"), index)
        ranked = sparse.top(scored, pool, "rerank_score").withColumnRenamed("qid", "n")
    share = F.greatest(F.lit(2), F.floor(F.lit(k) / F.count("*").over(Window.partitionBy("qid"))))
    shares = named.select("n", "qid", "sub", share.alias("_share"))
    kept = ranked.join(shares, "n").where(F.col("rank") <= F.col("_share"))
    return kept.select("qid", "sub", "doc_id", "rrf_score", "rank", *(["rerank_score"] if reranked else []))


#: The column that holds the values of several filters as one.
FILTER = "_filter"


def _filter_value(columns: list[Column]) -> Column:
    """The values of some columns as one string; null if one of them is."""
    return F.when(~reduce(Column.__or__, [c.isNull() for c in columns], F.lit(False)), F.to_json(F.array(*(c.cast("string") for c in columns))))


def _filtered_lists(index, embedded: DataFrame | None, asked: DataFrame, pool: int, columns: list[Column]) -> DataFrame:
    """Both lists of each question among documents with its own value of FILTER: one search of each kind for all."""
    if not columns:
        return lists(index, embedded, asked.drop(FILTER), pool)[0]
    docs = sparse.documents_of(index)
    terms = sparse.query_terms(asked).join(asked.select("qid", FILTER), "qid")
    value = _filter_value(columns)
    found = index.search(terms, pool, group=FILTER, value=value) if docs is not index else sparse.search(docs.withColumn(FILTER, value), terms, pool, group=FILTER)
    inside = docs.select("doc_id", _own_tokens(docs).alias("embedding"), value.alias(FILTER)) if embedded is None else embedded.join(docs.select("doc_id", value.alias(FILTER)), "doc_id")
    dense = vectors.exact_search(inside, embed_questions(asked).join(asked.select("qid", FILTER), "qid"), pool, key="doc_id", group=FILTER)
    return union(found.withColumn("list", F.lit("bm25")), dense.withColumn("list", F.lit("dense")))
