import random

import numpy as np

from docquarry.llm import toxicity as tx

BAD = ["vile", "rotten", "grubbing", "grubful", "grubster"]


def corpus(n, seed=0):
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}o" for _ in range(rng.randrange(20, 80))]
        toxic, crude = rng.random() < 0.3, rng.random() < 0.4
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        if crude:
            words += ["###"] * 3 + ["junk"] * 3
        rows.append((i, " ".join(words), int(crude), int(toxic)))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, 0.5, True) for i, t, _, _ in rows], "doc_id long, text string, p_toxic double, rejected boolean")
    return docs, spark.createDataFrame([(i, c, x) for i, _, c, x in rows], "doc_id long, crude int, toxic int")


def test_held_out_documents_and_odd_rows(spark):
    rows = corpus(900)
    docs, labels = frames(spark, rows)
    extra = spark.createDataFrame([(None, "vile rotten vile grubbing", 0.1, None), (5000, None, None, None), (5001, "", None, None), (5002, "wabo " * 30_000, None, None), (3, rows[3][1], None, None)], docs.schema)
    labels = labels.where("doc_id < 600").unionByName(spark.createDataFrame([(None, 1, 1), (700, None, 1), (3, 0, 0)], labels.schema))
    all_docs = docs.unionByName(extra)
    out = tx.score(all_docs, labels, ("crude", "toxic")).collect()
    assert len(out) == len(rows) + 5
    by_id = {r.doc_id: r for r in out}
    held = [(by_id[i].rejected, by_id[i].p_crude > 0.5, bool(x), bool(c)) for i, _, c, x in rows[600:]]
    assert np.mean([a == x for a, _, x, _ in held]) > 0.97 and np.mean([b == c for _, b, _, c in held]) > 0.97
    assert by_id[None].rejected and not by_id[5000].rejected and not by_id[5001].rejected and not by_id[5002].rejected
    kept = tx.without_toxic(all_docs, labels, ("crude", "toxic"))
    assert kept.columns == all_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(r.doc_id for r in out if not r.rejected and r.doc_id is not None)
    assert tx.score(all_docs.where("doc_id < 0"), labels, ("crude", "toxic")).collect() == []


def test_three_categories_and_one_class(spark):
    rows = corpus(400, 5)
    docs, labels = frames(spark, rows)
    three = labels.selectExpr("doc_id", "crude", "toxic", "crude * toxic AS both")
    out = {r.doc_id: r for r in tx.score(docs, three, ("crude", "toxic", "both")).collect()}
    assert np.mean([out[i].rejected == bool(c and x) for i, _, c, x in rows]) > 0.95
    none = tx.score(docs, labels.where("toxic = 0"), ("crude", "toxic")).collect()
    assert not any(r.rejected for r in none) and all(r.p_toxic is None for r in none)
    assert tx.score(docs, labels.where("doc_id < 0"), ("toxic",)).count() == 400


def test_later_models_use_earlier_ones():
    """A category that is the opposite of an earlier one's prediction can only be learnt through the chain."""
    rng = np.random.default_rng(0)
    n = 600
    first = rng.random(n) < 0.5
    x = tx.Rows(np.arange(n + 1), first.astype(np.int64), np.ones(n), 2)
    chain = tx.fit_chain(["a", "b"], ["f", "g"], x, np.full(n, 10), np.stack([first, ~first], 1).astype(int))
    assert len(chain.dense[1]) == 3 and chain.dense[1][2] < 0


def test_fast_scores_equal_plain_ones():
    rows = corpus(60, 3)
    features = sorted({f for _, t, _, _ in rows for f in tx.counts_of(t)})[::3]
    rng = np.random.default_rng(1)
    chain = tx.Chain(["toxic"], {f: k for k, f in enumerate(features)}, [rng.normal(size=len(features))], [np.array([0.3, -0.2])], [0.0])
    fast = tx.Scorer(chain)([t for _, t, _, _ in rows])[:, 0]
    for (_, t, _, _), s in zip(rows, fast):
        own = tx.counts_of(t)
        plain = sum(chain.sparse[0][k] * np.log1p(own[f]) for f, k in chain.features.items()) + 0.3 - 0.2 * np.log1p(len(tx._WORD.findall(t)))
        assert abs(plain - s) < 1e-9


def test_scores_of_a_table_equal_brute_force(spark):
    """The fitted chain applied to every document by plain sums, one category after the other."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    chain = tx.fit_on_labels(docs, labels, list(tx.LOW_QUALITY_THEN_TOXIC), tx.LOW_QUALITY_THEN_TOXIC)
    out = {r.doc_id: r for r in tx.op8_chain_toxicity(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert out.keys() == texts.keys() and any(r.rejected for r in out.values())
    for i, t in texts.items():
        own, dense, odds = tx.counts_of(t or ""), [1.0, float(np.log1p(len(tx._WORD.findall(t or ""))))], []
        for sparse, weights in zip(chain.sparse, chain.dense):
            odds.append(sum(sparse[k] * np.log1p(own[f]) for f, k in chain.features.items() if f in own) + float(np.dot(weights, dense)))
            dense.append(min(12.0, max(-12.0, odds[-1])))
        r = out[i]
        assert np.allclose([r.p_low_quality, r.p_toxic], 1 / (1 + np.exp(-np.array(odds))), atol=1e-9) and r.rejected == (odds[-1] > chain.thresholds[-1])
