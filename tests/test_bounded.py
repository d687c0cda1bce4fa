"""What Python makes of a batch is bounded by bytes: a large batch comes out in several, with the same rows."""

import pyarrow as pa
import pytest

from docquarry.functions import pii
from docquarry.operators import chunk, parse, vectors
from docquarry.operators.parse import BLOCK

N = 1000
TEXT = pa.array([f"<p>row {i} " + "word " * 1000 + "</p>" for i in range(N)])
BLOCKS = pa.array([[{"kind": "text", "text": f"row {i} " + "word " * 1000, "caption": None, "header": None, "rows": None}] for i in range(N)])
TOKS = pa.array([["word", str(i)] * 400 for i in range(N)])
CASES = {
    "chunk_sets": ("k long, blocks array<%s>, header string" % BLOCK, lambda df: chunk.chunk_sets(df, "k"), [BLOCKS, pa.array(["h"] * N)]),
    "chunked": ("k long, t string", lambda df: chunk.chunked(df, "k", "t", chunk.recursive_chunks), [TEXT]),
    "redact": ("k long, t string", lambda df: pii.redacted(df, "k", "t"), [TEXT]),
    "pages_to_text": ("k long, html string", lambda df: parse.pages_to_text(df, "k"), [TEXT]),
    "embed": ("k long, toks array<string>", lambda df: vectors.embed(df, "k", "toks", "v"), [TOKS]),
}


@pytest.mark.parametrize("name", CASES)
def test_a_large_batch_is_worked_on_in_parts(spark, monkeypatch, name):
    schema, call, columns = CASES[name]
    df, taken = spark.createDataFrame([], schema), []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *_: taken.append(f) or self)
    call(df)
    batch = pa.RecordBatch.from_arrays([pa.array(range(N)), *columns], ["k", *(f"c{i}" for i in range(len(columns)))])
    out = list(taken[0](iter([batch])))
    assert len(out) >= batch.nbytes >> 20 > 1
    keys = [k for b in out for k in b.column(0).to_pylist()]
    assert sorted(keys) == keys and set(keys) == set(range(N))
    (whole,) = (pa.Table.from_batches(list(taken[0](iter([batch.slice(at, 1)])))) for at in (N // 2,))
    assert pa.Table.from_batches([b for b in out if N // 2 in b.column(0).to_pylist()]).filter(pa.compute.field("k") == N // 2).equals(whole)
