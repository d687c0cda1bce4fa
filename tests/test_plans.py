"""Plans: filters and columns reach the scan, and nothing runs row by row in Python."""

from pyspark.sql import functions as F

from docquarry.operators import planning, sparse
from docquarry.plans import QUERIES
from docquarry.plans.registry import table
from tests.oracle import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_metadata_filters_are_pushed_to_the_scan(spark):
    df = table(spark, SF, "documents").where(planning.metadata_predicate({"lang": ["en"], "source": ["src1", "src2"]})).select("doc_id")
    text = plan(df)
    assert "PushedFilters: [" in text and "EqualTo(lang,en)" in text and "In(source" in text
    assert "text" not in text.split("ReadSchema")[1]


def test_only_wanted_columns_are_read(spark):
    for name, unread in (("metadata_filter", "text"), ("latency_percentiles", "props"), ("mutual_edges", "l_comment")):
        text = plan(QUERIES[name](spark, SF))
        assert all(unread not in part.split("\n")[0] for part in text.split("ReadSchema")[1:])


def test_top_lists_are_cut_before_the_shuffle(spark):
    docs = table(spark, SF, "documents")
    text = plan(sparse.top(docs.select("lang", "doc_id", F.col("n_chars").alias("score")), 3, by=("lang",)))
    assert text.count("WindowGroupLimit") == 2


def test_no_row_by_row_python(spark):
    for name in ("tokenize_docs", "bm25_topk", "knn_exact", "pages_to_text", "redact", "token_bucket", "safe_arithmetic"):
        assert "BatchEvalPython" not in plan(QUERIES[name](spark, SF))
