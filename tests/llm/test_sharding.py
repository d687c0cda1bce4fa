import zlib
from collections import defaultdict

import pytest

from docquarry.llm.sharding import shard_documents

SCHEMA = "doc_id long, text string, lang string, shard int, slot string"


def jump(key: int, shards: int) -> int:
    """The published loop, in plain integers."""
    at, ahead, key = -1, 0, key % 2**64
    while ahead < shards:
        at = ahead
        key = (key * 2862933555777941757 + 1) % 2**64
        ahead = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 7, "x") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_equals_the_published_loop(spark, shards):
    keys = [*range(200), 2**63 - 1, -(2**63), -1, 10**12]
    out = {r.doc_id: r for r in shard_documents(docs(spark, [(k, "t") for k in keys]), shards, buckets=16).collect()}
    for k in keys:
        assert (out[k].shard, out[k].grown_shard) == (jump(k, shards), jump(k, shards + 1))


def test_columns_slots_nulls_and_repeats(spark):
    rows = [(i, f"é{i}" * i) for i in range(60)] + [(5, "é5" * 5)] * 3 + [(None, "a"), (None, None), (70, None), (71, ""), (72, "x" * 200_000)]
    out = shard_documents(docs(spark, rows), 5, buckets=8).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in out) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows
    )
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 5)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_empty_table(spark):
    assert shard_documents(docs(spark, []), 40).collect() == []
