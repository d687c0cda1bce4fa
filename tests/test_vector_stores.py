"""Stored neighbour graphs and product-quantised codes, against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.operators import graphs, quantized, vectors
from docquarry.plans import QUERIES


def rows(n, seed=1, dims=16):
    v = np.random.default_rng(seed).normal(size=(n, dims))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    v = rows(1500)
    path = str(tmp_path_factory.mktemp("vectors") / "table")
    data = [(k, x.tolist(), f"g{k % 7}" if k % 11 else None, "extra") for k, x in enumerate(v)]
    odd = [(None, v[0].tolist(), "g1", ""), (9001, None, "g1", ""), (3, v[3].tolist(), "g3", ""), (9002, v[4].tolist(), "rare", "")]
    spark.createDataFrame(data + odd, "vec_id long, embedding array<float>, label string, key string").write.parquet(path)
    return spark.read.parquet(path)


def asked(spark, corpus):
    q = corpus.where("vec_id % 30 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), "label")
    return q.unionByName(spark.createDataFrame([(-1, None, "g1"), (-2, rows(1, 5)[0].tolist(), "rare"), (-3, rows(1, 6)[0].tolist(), "no such")], "qid long, qvec array<float>, label string"))


def recall(exact, found):
    by = lambda df, key: {q: {r[key] for r in df if r.qid == q} for q in {r.qid for r in df}}
    e, f = by(exact.collect(), "vec_id"), by(found.collect(), "key")
    return np.mean([len(e[q] & f.get(q, set())) / len(e[q]) for q in e]), e, f


@pytest.mark.parametrize("shard_rows", [5000, 200])
def test_graph(spark, corpus, tmp_path, shard_rows):
    graph, q = graphs.Navigable.write(corpus, str(tmp_path / "graph"), group="label", shard_rows=shard_rows), asked(spark, corpus)
    assert graph.shards.count() > 1 or shard_rows == 5000
    assert sum(len(r["keys"]) for r in graph.shards.collect()) == 1502
    mean, e, f = recall(vectors.exact_search(corpus, q.drop("label"), 5), graph.search(q.drop("label"), 5))
    assert mean > 0.95 and e.keys() == f.keys() and -1 not in f
    mean, e, f = recall(vectors.exact_search(corpus, q.where("label IS NOT NULL"), 5, group="label"), graph.search(q, 5, group="label"))
    assert mean > 0.95 and f[-2] == {9002} and -3 not in f and set(f) == set(e)
    if shard_rows == 5000:
        computed = graph.walk(q.drop("label"), 5).groupBy("qid").agg(F.sum("computed").alias("n")).agg(F.avg("n")).first()[0]
        assert computed < 0.2 * 1502


def test_codes(spark, corpus, tmp_path):
    store, q = quantized.Quantized.write(corpus, str(tmp_path / "codes"), parts=8, group="label"), asked(spark, corpus)
    assert store.codes.count() == 1502 and {len(r.code) for r in store.codes.collect()} == {8}
    mean, e, f = recall(vectors.exact_search(corpus, q.drop("label"), 5), store.search(q.drop("label"), 5))
    assert mean > 0.9 and e.keys() == f.keys()
    mean, e, f = recall(vectors.exact_search(corpus, q.where("label IS NOT NULL"), 5, group="label"), store.search(q, 5, group="label"))
    assert mean > 0.9 and f[-2] == {9002} and -3 not in f
    # Distances by table are those of the decoded rows.
    one = q.where("qid = 30")
    books, qv = store.books, np.array(one.first().qvec, float)
    decoded = {r.key: np.concatenate([b[c] for b, c in zip(books, r.code)]) @ qv for r in store.codes.collect()}
    for r in store.candidates(one.drop("label"), 20).collect():
        assert abs(decoded[r.key] - r.score) < 1e-6
    assert r.rank == 20


def test_empty(spark, corpus, tmp_path):
    none, q = corpus.where("vec_id = -7"), asked(spark, corpus)
    assert graphs.Navigable.write(none, str(tmp_path / "g")).search(q.drop("label"), 3).collect() == []
    assert quantized.Quantized.write(none, str(tmp_path / "c")).search(q.drop("label"), 3).collect() == []
    assert graphs.Navigable.write(corpus, str(tmp_path / "h")).search(q.limit(0).drop("label"), 3).collect() == []


def test_queries_at_sf01(spark):
    sf = "/root/testdata/sf0.1"
    for r in QUERIES["graph_recall"](spark, sf).collect():
        assert r.mean_recall >= 0.95 and r.compared_share < 0.2 and r.queries == 100
    for r in QUERIES["store_overlap"](spark, sf).collect():
        assert r.mean_overlap >= 0.9 and (r.exact_bytes, r.code_bytes) == (256, 16)
