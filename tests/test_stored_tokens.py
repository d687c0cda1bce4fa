"""Tokens that the index makes in Python and packs, against the columns of Spark, and the size of what is sent to workers."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.operators import blocks, sparse, vectors
from docquarry.operators import postings as ps
from tests.oracle import SF

TEXTS = [None, "", " ", "the of", "John's dog's's it's 'S's", "a-b.c,d'e- f", "İI K ſ ﬁ Éé x’s y’", "3.14, 1,000 -5", "q" * 70_000, "a'b" * 100, "\U0001d400x\x00y"]


def test_joined_tokens_are_the_columns_tokens(spark):
    docs = spark.createDataFrame([(t,) for t in TEXTS + ["".join(f"a{chr(c)}b " for c in range(at, at + 4096) if not 0xD800 <= c < 0xE000) for at in range(0, 0x30000, 4096)]], "text string")
    docs = docs.unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("text"))
    both = docs.select(T.tokens(F.col("text")).alias("a"), ps._joined(F.col("text")).alias("j")).select("a", T.apart(F.col("j.words")).alias("b"), F.col("j.length").alias("n"))
    assert both.where("NOT (a <=> b) OR greatest(size(a), 0) != n").count() == 0


def test_packed_lists_come_back():
    values, at = np.array([5, 0, 2047, 1, 70_000]), np.array([0, 2, 2, 5])
    packed = ps._packed(values, at, ps.COUNT)
    assert ps._unpacked(packed, ps.COUNT).to_pylist() == [[5, 0], [], [2047, 1, 70_000]]
    assert ps._unpacked(pa.concat_arrays([packed, pa.array([None], pa.binary())]).slice(2), ps.COUNT).to_pylist() == [[2047, 1, 70_000], []]


def test_a_block_in_several_batches_has_one_row_a_term(spark, tmp_path):
    docs = spark.range(1500).coalesce(1).select(F.col("id").alias("doc_id"), F.concat(F.lit("same "), F.repeat(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" ")), F.lit(900))).alias("text"))
    index = ps.Postings.write(docs, str(tmp_path), buckets=4)
    assert index.terms.where("term = 'same'").select("df", "cf").collect() == [(1500, 1500)] and index.terms.count() == 1501
    assert index.postings.where("term = 'same'").count() == 1 and index.postings.count() <= 1 + 4


def test_rare_terms_share_rows_and_are_found(spark, tmp_path):
    docs = [(i, f"often w{i} {'twice ' * 2 if i in (3, 40) else ''}" + ("half " if i % 2 else "")) for i in range(60)]
    index = ps.Postings.write(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), str(tmp_path), buckets=3)
    assert sorted(r.term for r in index.postings.where("term IS NOT NULL").collect()) == ["half", "often"]
    counts = {r.term: (r.df, r.cf) for r in index.terms.collect()}
    assert counts["twice"] == (2, 4) and counts["half"] == (30, 30) and counts["w7"] == (1, 1) and len(counts) == 63
    terms = spark.createDataFrame([(1, "twice"), (1, "w40"), (2, "half"), (2, "w7"), (3, "w59"), (3, "none")] + [(4, f"w{i}") for i in range(150)], "qid long, term string")
    rows = lambda df: sorted(map(tuple, df.select("qid", "doc_id", "score", "rank").collect()))
    assert rows(index.search(terms, 5)) == rows(sparse.search(index.docs, terms, 5)) and rows(index.search(terms.where("qid < 4"), 5))[:2] == rows(sparse.search(index.docs, terms.where("qid = 1"), 5))


def test_workers_get_small_batches(spark):
    docs = spark.range(4000).coalesce(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.lit(5000)).alias("text"))
    sizes = blocks.in_arrow(docs, lambda batches: (pa.record_batch([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").agg(F.max("n"), F.count("*"), F.sum("n")).first()
    assert sizes[0] < blocks.BATCH_BYTES * 1.1 and sizes[1] >= 4 and sizes[2] > 20_000_000


def test_the_tokens_of_an_index_are_made_in_small_batches(spark, tmp_path, monkeypatch):
    """Also in a fresh session, where writing the index is the first Python step."""

    @F.arrow_udf(returnType=ps._joined.returnType)
    def measured(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array([""] * len(texts)), pa.array([texts.nbytes] * len(texts), pa.int32())], ["words", "length"])

    spark.conf.unset(blocks._BATCH)
    monkeypatch.setattr(ps, "_joined", measured)
    docs = spark.range(4000).coalesce(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.lit(5000)).alias("text"))
    written = ps.Postings.write(docs, str(tmp_path), buckets=2).docs
    assert written.count() == 4000 and written.agg(F.max("length")).first()[0] < blocks.BATCH_BYTES * 1.1


def test_tokens_are_embedded_as_they_are_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", T.tokens(F.col("text")).alias("t"))
    asked = vectors.embed(docs.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "qid"), "qid", "t", "qvec")
    joined = docs.select("doc_id", F.coalesce(F.array_join("t", " "), F.lit("")).alias("embedding"))
    rows = [sorted(map(tuple, vectors.exact_search(x, asked, 5, key="doc_id").select("qid", "doc_id", "score", "rank").collect())) for x in (vectors.embed(docs, "doc_id", "t", "embedding"), joined)]
    assert rows[0] == rows[1] and len(rows[0]) > 5


def test_a_long_token_of_parts_needs_no_stack(spark, tmp_path):
    """Spark's own pattern overflows the stack of a task on it."""
    index = ps.Postings.write(spark.createDataFrame([(1, "a'b" * 30_000)], "doc_id long, text string"), str(tmp_path), buckets=2)
    assert index.terms.select(F.length("term"), "df", "cf").collect() == [(90_000, 1, 1)]


def test_slices_are_split_like_the_whole():
    joined = pa.array(["aa bb", "", "é c", None, "d", "", "ee ff gg"] * 3)
    for at in range(len(joined)):
        some = joined.slice(at, 5)
        assert T.split_tokens(some).to_pylist() in ([(x or "").split() for x in some.to_pylist()], [x.split() if x is not None else None for x in some.to_pylist()])


def test_joined_tokens_of_slices():
    texts = pa.array(["the", "Ab's-c", None, "of it's", "x’s\u212a", ".z.", "", "b"] * 2)
    whole, number = T.joined_tokens(texts)
    assert whole.to_pylist()[:8] == ["", "ab's-c", None, "", "x'sk", "z", "", "b"] and number.tolist()[:8] == [0, 1, 0, 0, 1, 1, 0, 1]
    for at in range(len(texts)):
        some, n = T.joined_tokens(texts.slice(at, 5))
        assert some.to_pylist() == whole.to_pylist()[at : at + 5] and n.tolist() == number.tolist()[at : at + 5]


def test_a_groups_queries_are_compared_with_its_rows_only(spark):
    import random

    rng = random.Random(1)
    rows = [(i, [rng.random() for _ in range(4)], rng.choice(["a", "b", None])) for i in range(300)]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(2)
    asked = corpus.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), F.coalesce("label", F.lit("c")).alias("label"))
    got = sorted(map(tuple, vectors.exact_search(corpus, asked, 4, group="label").select("qid", "vec_id", "rank").collect()))
    want = []
    for q, v, label in [r for r in rows if r[0] % 20 == 0 and r[2]]:
        scored = sorted((-round(sum(a * b for a, b in zip(v, w)), 6), i) for i, w, own in rows if own == label)
        want += [(q, i, n) for n, (_, i) in enumerate(scored[:4], 1)]
    assert got == sorted(want)
