import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from docquarry.llm import dac
from docquarry.llm.tokens import tokenizer_path


@pytest.mark.parametrize("top", [1, 2, 256, 257, 49408, 2**24, 2**32])
@pytest.mark.parametrize("n", [0, 1, 7, 512, 513, 5000])
def test_round_trip_and_random_access(top, n):
    ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    seg = dac.Segment(dac.encode(ids))
    assert len(seg) == n and (seg.slice(0, n) == ids).all()
    for i in [*range(min(n, 40)), *range(max(0, n - 9), n)]:
        assert seg.access(i) == ids[i]
    for a, b in [(0, n // 2), (n // 3, n), (n // 2, n // 2), (max(0, n - 5), n)]:
        assert (seg.slice(a, b) == ids[a:b]).all()
    with pytest.raises(IndexError):
        seg.access(n)


def test_files(spark, tmp_path):
    path = tokenizer_path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = [(i * 7 % 101, f"Text no {i}, with é{i} *** words " * (i % 9)) for i in range(101)] + [(None, "x"), (200, None), (201, ""), (5, "again"), (5, "again"), (-3, "w " * 20_000)]
    docs = spark.createDataFrame([(i, t, 0, "c") for i, t in rows], "doc_id long, text string, start int, part string").repartition(5)
    dac.write(docs, path, str(tmp_path / "files"), segment_ids=300, segment_docs=4)
    expected, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, dac.read(spark, str(tmp_path / "files")).collect()), key=lambda r: r[1]) == expected
    dac.write(docs.where("doc_id = 999"), path, str(tmp_path / "none"))
    assert dac.read(spark, str(tmp_path / "none")).collect() == []
