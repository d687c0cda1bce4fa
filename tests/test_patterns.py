import random

import pytest

from docquarry.operators import patterns as pt


def slow(docs, items):
    return list((q, i) for i, t in docs for q, p in items if t is not None and p is not None and p in t)


@pytest.mark.parametrize("texts, characters", [(50_000, 4_000_000), (3, 4_000_000), (50_000, 5)])
def test_against_plain_search(spark, monkeypatch, texts, characters):
    monkeypatch.setattr(pt, "PART_TEXTS", texts)
    monkeypatch.setattr(pt, "PART_CHARACTERS", characters)
    rng = random.Random(3)
    docs = [(k, "".join(rng.choices("abé \U0001f600", k=rng.randint(0, 40)))) for k in range(60)] + [(60, None), (61, ""), (7, "abab"), (None, "ab"), (62, "ab" * 20_000)]
    items = [(k, "".join(rng.choices("abé \U0001f600", k=rng.randint(1, 4)))) for k in range(20)] + [(20, "ab"), (21, "ab"), (22, ""), (23, None), (24, "abab"), (24, "b"), (25, "bab" * 3000)]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, qid int").repartition(3)
    found = pt.containing(d, spark.createDataFrame(items, "qid long, pattern string"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(slow(docs, items), key=str)


def test_empty(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "qid long, pattern string")
    assert pt.containing(docs, items.limit(0)).collect() == [] and pt.containing(docs.limit(0), items).collect() == []
