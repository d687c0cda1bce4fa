import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from docquarry.llm.packing import cut, pack, plan_bins
from docquarry.llm.tokens import Encoder, tokenizer_path

TEXTS = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n b", "a\n\n  b ", "don't we'll X's", "Hello,world! 12 345é", "É Àß ñandú, élan*** x### y|z |", "<|endoftext|> a<|endoftext|>b", "foo<|", " x  y",
    "naïve café ﬁ Ⅳ ½ 中文 字 🙂🙂 a🙂", "tab\tx \ty", "x\x1cy \x85z", "µ ª º", "İ ǅ Σς", "a_b __c 'twas 'S", "word " * 50, "line\r\nnext \r\n", "a b.\nC d,\nx y\n\nz q\n w|\n#e r\n", "k \n", "a b\n\n", " a.\nb.\nc d",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_ids_equal_the_tokenizer(name):
    plain, own = Tokenizer.from_file(tokenizer_path(name)), Encoder(tokenizer_path(name), entries=20)
    rng = random.Random(5)
    parts = [*"aé.,'*#|9 \n\t", "  ", "the", " Ré", "ion,", "***", " 'll", "́", "中"]
    texts = TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    for t in texts * 2:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_cut():
    assert [cut(n, 10) for n in (1, 10, 11, 20, 25)] == [[1], [10], [1, 10], [10, 10], [5, 10, 10]]


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_all_and_is_tight(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(65, np.int64)
    lengths = rng.integers(1, 65, 3000) if seed % 2 else np.minimum(rng.geometric(0.08, 3000), 64)
    np.add.at(counts, lengths, 1)
    if seed == 5:
        counts[:] = 0
        counts[33] = 1000
        counts[31] = 1000
    plan, used = plan_bins(counts, 64), defaultdict(list)
    for n in np.nonzero(counts)[0]:
        seq, off = plan.place(np.full(counts[n], n), np.arange(counts[n]))
        for s, o in zip(seq.tolist(), off.tolist()):
            used[s].append((o, int(n)))
    assert len(used) == plan.sequences
    for places in used.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 64
    least = -(-int((counts * np.arange(65)).sum()) // 64)
    assert plan.sequences <= least * 1.02 + 1


def test_two_replace_the_smallest():
    counts = np.zeros(11, np.int64)
    counts[[6, 3, 2]] = [1, 1, 2]  # greedy: 6+3, gap 1; 2+2 fills the expanded gap of 4
    plan = plan_bins(counts, 10)
    assert plan.place(np.array([6, 2, 2, 3]), np.array([0, 0, 1, 0]))[0].tolist() == [0, 0, 0, 1]


def test_documents(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    rows = list(enumerate(TEXTS)) + [(100, None), (None, "no id"), (3, "a"), (3, "a"), (101, "many words here " * 2000)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, piece int, length int").repartition(3)
    out = pack(docs, path).collect()
    plain = Tokenizer.from_file(path)
    expected = []
    for i, t in rows:
        ids, at = plain.encode(t or "", add_special_tokens=False).ids + [2], 0
        for k, n in enumerate(cut(len(ids), 1024)):
            expected.append((i, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at += n
    assert sorted([tuple(r)[:5] for r in out], key=str) == sorted(expected, key=str)
    used = defaultdict(list)
    for r in out:
        used[r.sequence_id].append((r.offset, r.length))
    for places in used.values():
        assert [o for o, _ in sorted(places)] == np.concatenate(([0], np.cumsum([n for _, n in sorted(places)])[:-1])).tolist()
        assert sum(n for _, n in places) <= 1024
    assert pack(docs.where("doc_id < 0"), path).collect() == []


def best_fit_decreasing(counts, capacity):
    gaps, bins = np.zeros(capacity + 1, np.int64), 0
    for n in range(capacity, 0, -1):
        for _ in range(int(counts[n])):
            if len(fitting := np.nonzero(gaps[n:])[0]):
                gap = n + fitting[0]
                gaps[gap] -= 1
                gaps[gap - n] += 1
            else:
                bins += 1
                gaps[capacity - n] += 1
    return bins


def test_no_more_sequences_than_best_fit_decreasing(spark):
    rng = np.random.default_rng(0)
    for lengths in (rng.integers(1, 1025, 3000), np.minimum(rng.geometric(0.004, 5000), 1024), rng.integers(200, 700, 4000), rng.integers(300, 360, 2000)):
        counts = np.bincount(lengths, minlength=1025)
        assert plan_bins(counts, 1024).sequences <= best_fit_decreasing(counts, 1024)
    encoder, counts = Encoder(tokenizer_path("byte_bpe_50k.json")), np.zeros(1025, np.int64)
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        for n in cut(len(encoder.encode(r.text or "")) // 4 + 1, 1024):
            counts[n] += 1
    assert plan_bins(counts, 1024).sequences <= best_fit_decreasing(counts, 1024)
