import hashlib
import random
from collections import Counter

import pytest

from docquarry.llm import alignment
from docquarry.llm.tokens import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def slow(texts):
    """Rows of n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 by walking along both token lists."""
    one, two = alignment.ByteLevel(A), alignment.Pieces(B)
    found = []
    for t in texts:
        a = one.tokenizer.encode(" " + t, add_special_tokens=False).ids if t else []
        b = two.model.encode(t) if t else []
        if any(b"".join(x.bytes[i] for i in ids) != b" " + t.encode() for x, ids in ((one, a), (two, b))):
            a = b = []
        links, groups, i, j, ends = [], [], 0, 0, [0, 0]
        while i < len(a):
            first, start = (i, j), len(links)
            links.append((a[i], b[j]))
            ends = [ends[0] + len(one.bytes[a[i]]), ends[1] + len(two.bytes[b[j]])]
            while ends[0] != ends[1]:
                k = int(ends[0] > ends[1])
                i, j = i + (k == 0), j + (k == 1)
                ends[k] += len((one, two)[k].bytes[(a[i], b[j])[k]])
                links.append((a[i], b[j]))
            i, j = i + 1, j + 1
            assert len(links) > start
            groups.append(",".join(map(str, a[first[0] : i])) + "|" + ",".join(map(str, b[first[1] : j])))
        found.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    count = Counter(x for f in found for x in f[3])
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(na, nb, ng, len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), sha) for na, nb, ng, x, sha in found]


ODD = [None, "", " ", "  x", "x ", "a  b", "a\n b", "a \nb\n", "<|endoftext|> </s> <unk>", "▁", "x ▁y", "\x00", "é" * 50, "é", "\U0001f600中文 ß", "1234 56.7", "word " * 3000, "x" * 5000, "\t", "a b", "same", "same"]


@pytest.mark.parametrize("heavy", [1, 5, 10**6])
def test_against_walking(spark, tmp_path, heavy):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 40").collect()]
    rows = [(None if k == 20 else k, t, "x", 7) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, links string, row int").repartition(3)
    out = alignment.cross_align(docs, A, B, str(tmp_path / "files"), heavy=heavy)
    expected = [(r[0], *x) for r, x in zip(rows, slow([t or "" for t in texts]))]
    assert out.columns == ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(expected, key=str)


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert alignment.cross_align(docs, A, B, str(tmp_path / "files")).collect() == []


def test_words_apart_are_as_whole_texts():
    both, rng = alignment.Both(A, B), random.Random(1)
    parts = ["a", "B", "é", "ß", "\n", "\t", " ", "  ", "1", ".", "<|endoftext|>", "'s", "中", "\U0001f600", "<s>", "́", "\x1c", "\x85", "\r"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(1500)] + [" ".join("".join(rng.choices(parts[:6] + parts[8:], k=rng.randint(1, 4))) for _ in range(9)) for _ in range(1500)]
    for _ in range(2):
        for t, (a, b) in zip(texts, both.encode(texts)):
            assert a.tolist() == (both.a.tokenizer.encode(" " + t, add_special_tokens=False).ids if t else [])
            assert b.tolist() == (both.b.model.encode(t) if t else [])


def test_sets_of_ends_are_compiled(spark):
    tokens = alignment.tokenised(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), A, B)
    plan = alignment.aligned(tokens)._jdf.queryExecution().executedPlan().toString()
    sets = [line for line in plan.splitlines() if "array_intersect" in line or "array_except" in line]
    assert sets and all("*(" in line.split("Project")[0] for line in sets)  # Spark marks with a star what it compiles
