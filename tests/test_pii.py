"""Counts of personal data by pattern, and spans without overlaps."""

import hashlib

import pyarrow as pa

from docquarry.functions import pii
from docquarry.operators.blocks import bounded
from docquarry.plans import ORACLES, QUERIES
from tests.oracle import connection, rows

TEXTS = [(1, "he 4495589438270767 42.73.240.87 the"), (2, "éa@b.org, ١a@b.org"), (3, None), (4, ""), (5, "a@b.org a@b.org 1.2.3.4 256.1.1.1")]


def test_counts_are_those_of_the_sql_where_kinds_overlap(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES["pii_counts"](spark, str(tmp_path))
    con = connection()
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(ORACLES["pii_counts"])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in cur.description], cur.fetchall())
    assert "CARD" in pii.redact(TEXTS[0][1])[1] and "IP" not in pii.redact(TEXTS[0][1])[1]  # a span has one kind


def test_batches_are_cut_by_their_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["x" * 1000 * (i == 4) + "y" * 100 for i in range(9)])], ["k", "t"])
    cut = list(bounded(iter([batch, batch.slice(0, 0)]), 500))
    assert pa.Table.from_batches(cut).column("k").to_pylist() == list(range(9)) and len(cut) > 3
    assert all(b.nbytes <= 500 or b.num_rows == 1 for b in cut)


def test_redact_gives_texts_and_types(spark, tmp_path):
    """What comes out of every row: the text with its spans replaced, their types in order with repeats, and the digest of that text; null texts stay null."""
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.text, r.kinds, r.redacted) for r in QUERIES["redact"](spark, str(tmp_path)).collect()}
    expected = {3: (None, "", None)}
    for i, text in TEXTS:
        if text is not None:
            out, kinds = pii.redact(text)
            expected[i] = (out, ",".join(kinds), hashlib.md5(out.encode()).hexdigest())
    assert got == expected and got[5][:2] == ("[EMAIL] [EMAIL] [IP] 256.1.1.1", "EMAIL,EMAIL,IP")
