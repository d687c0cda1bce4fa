"""Stored postings against a search of all tokens, and what is read of them."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docquarry.operators import postings as ps
from docquarry.operators import sparse
from tests.oracle import SF

ROWS = [(5, "aa bb cc dd", "x"), (1, "aa aa aa ee", "y"), (9, None, "x"), (2, "", None), (7, "bb  cc\nCC", "y"), (3, "ww " * 400 + "aa", "x"), (4, "zz", "y"), (5, "aa bb cc dd", "x"), (None, "aa", "x"), (8, "aa bb", None)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return ps.Postings.write(docs, str(tmp_path_factory.mktemp("postings")), keep=("lang", "source"), buckets=16)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").repartition(3)
    return ps.Postings.write(docs, str(tmp_path_factory.mktemp("small")), keep=("lang",), buckets=4)


def slow(queries, k, keep=lambda lang: True):
    """Top lists of a few rows by the formula."""
    docs = [(i, Counter((t or "").lower().split()), lang) for i, t, lang in ROWS if i is not None]
    mean = sum(sum(c.values()) for _, c, _ in docs) / len(docs)
    out = []
    for q, terms in queries.items():
        scored = []
        for i, c, lang in docs:
            score = 0.0
            for t in set(terms):
                df = sum(t in x for _, x, _ in docs)
                norm = sparse.K1 * (1 - sparse.B + sparse.B * sum(c.values()) / mean)
                score += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * c[t] * (sparse.K1 + 1) / (c[t] + norm)
            if round(score, 6) > 0 and keep(lang):
                scored.append((-round(score, 6), i))
        out += [(q, i, -s, r) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def asked(spark, queries, extra=None):
    rows = [(q, t, *([extra[q]] if extra else [])) for q, terms in queries.items() for t in terms]
    return spark.createDataFrame(rows, "qid long, term string" + (", lang string" if extra else ""))


QUERIES = {1: ["aa", "bb"], 2: ["cc", "nothing"], 3: ["ee"], 4: ["ww", "zz", "aa"], 5: ["nothing"]}


def test_odd_rows(spark, small):
    found = small.search(asked(spark, QUERIES), 3)
    assert sorted(map(tuple, found.select("qid", "doc_id", "score", "rank").collect())) == slow(QUERIES, 3)
    kept = small.search(asked(spark, QUERIES), 3, where=F.col("lang") == "x")
    assert sorted(map(tuple, kept.select("qid", "doc_id", "score", "rank").collect())) == slow(QUERIES, 3, lambda x: x == "x")


def test_each_value_and_own_value(spark, small):
    by = defaultdict(list)
    for r in small.search(asked(spark, QUERIES), 2, group="lang").collect():
        by[r.lang].append((r.qid, r.doc_id, r.score, r.rank))
    for value in ("x", "y", None):
        assert sorted(by[value]) == slow(QUERIES, 2, lambda x, v=value: x == v)
    own = {1: "x", 2: "y", 3: "y", 4: None, 5: "x"}
    expected = sorted(r for q, v in own.items() if v for r in slow({q: QUERIES[q]}, 2, lambda x, v=v: x == v))
    for index in (small, small.docs):
        found = sparse.search(index, asked(spark, QUERIES, own), 2, group="lang")
        assert sorted(map(tuple, found.select("qid", "doc_id", "score", "rank").collect())) == expected


def test_same_as_a_search_of_all_tokens(spark, stored, monkeypatch):
    monkeypatch.setattr(ps, "ADDED_AT_A_TIME", 999)
    questions = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    terms = sparse.query_terms(questions)
    rows = lambda df: sorted(map(tuple, df.select("qid", "doc_id", "score", "rank").collect()))
    assert rows(stored.search(terms, 7)) == rows(sparse.search(stored.docs, terms, 7))
    monkeypatch.setattr(ps, "QUERIES_AT_A_TIME", 9)
    assert rows(stored.search(terms, 7)) == rows(sparse.search(stored.docs, terms, 7))


def read_bytes(df):
    """Bytes of the postings' files that the plan selects."""
    files = [f for f in df.inputFiles() if "/postings/" in f]
    import os

    return sum(os.path.getsize(f.removeprefix("file://")) for f in files), len(files)


def test_what_is_read_falls_with_the_terms(spark, stored):
    terms = [r.term for r in stored.terms.orderBy("term").limit(40).collect()]
    plan = lambda ts: stored.of_terms(stored.postings, ts)
    one, some, whole = plan(terms[:1]), plan(terms[:5]), stored.postings
    text = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "bucket" in text.split("PartitionFilters")[1][:80] and "EqualTo(term" in text
    buckets = lambda df: df.select("bucket").distinct().count()
    assert buckets(one) == 1 and buckets(some) <= 5 < buckets(whole) == 16
    search = stored.search(asked(spark, {1: terms[:2]}), 3)._jdf.queryExecution().executedPlan().toString()
    assert "toks" not in search.split("ReadSchema", 1)[1]


def test_blocks_without_a_chance_are_passed_over():
    import numpy as np
    import pyarrow as pa

    scorer = ps._Scorer(1, 1, pa.array(["a"]), np.array([1.0]), 10.0, np.array([0]), np.array([0, 1]), False)

    def block(n, tf, length):
        kinds = {"kind": pa.int32(), "term": pa.string(), "gaps": pa.list_(pa.int32()), "tfs": pa.list_(pa.int32()), "max_tf": pa.int32(), "min_length": pa.int32(), "ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int32()), "owns": pa.list_(pa.string())}
        rows = [{"kind": 0, "gaps": [0], "ids": [n], "lengths": [length]}, {"kind": 1, "term": "a", "gaps": [0], "tfs": [tf], "max_tf": tf, "min_length": length}]
        return [pa.RecordBatch.from_pylist(rows, pa.schema(list(kinds.items())))]

    scorer.add(block(1, 5, 10))
    scorer.add(block(2, 1, 50))
    assert scorer.passed == 1
    scorer.add(block(3, 9, 10))
    assert scorer.passed == 1 and scorer.best[None].key.tolist() == [3]


def test_empty(spark, tmp_path):
    index = ps.Postings.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"))
    assert index.search(asked(spark, QUERIES), 3).collect() == []


def test_an_overlay_is_one_index_of_all(spark, tmp_path):
    docs = spark.createDataFrame([r for r in ROWS if r[0] != 5], "doc_id long, text string, lang string")
    whole = ps.Postings.write(docs, str(tmp_path / "whole"), keep=("lang",))
    few = F.coalesce(F.col("doc_id"), F.lit(0)).isin(1, 3, 8)
    both = ps.Overlay(ps.Postings.write(docs.where(~few), str(tmp_path / "a"), keep=("lang",)), ps.Postings.write(docs.where(few), str(tmp_path / "b"), keep=("lang",), buckets=2))
    rows = lambda df: sorted(map(tuple, df.select("qid", "doc_id", "score", "rank").collect()))
    terms = asked(spark, QUERIES)
    assert rows(both.search(terms, 3)) == rows(whole.search(terms, 3)) and both.docs.count() == whole.docs.count()
    assert rows(both.search(terms, 2, where=F.col("lang") == "x")) == rows(whole.search(terms, 2, where=F.col("lang") == "x"))
    assert rows(both.search(terms, 2, group="lang")) == rows(whole.search(terms, 2, group="lang"))
    assert rows(sparse.search(both, terms, 3)) == rows(whole.search(terms, 3))
