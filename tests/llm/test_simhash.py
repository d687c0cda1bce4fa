import random
import re

import numpy as np
import pytest
import xxhash

from docquarry.llm import simhash
from docquarry.llm.components import connected_components


def slow_fingerprint(text: str) -> int:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, fps, bound=4):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            if bin(fps[x] ^ fps[y]).count("1") <= bound:
                a, b = sorted((root(ids[x]), root(ids[y])))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_fingerprints_equal_the_plain_form():
    rng = random.Random(1)
    texts = ["", " \t\n", "One", "a b c", "a b c d", "É A\x0bb\x1cc d e F g", "word " * 3000]
    texts += [" ".join(rng.choice(["Ab", "cd", "é", "x-y", "##"]) for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    for t in texts:
        assert simhash.fingerprint(t.encode()) == slow_fingerprint(t)


@pytest.mark.parametrize("segments,rows", [(simhash.SEGMENTS, 8192), (simhash.SEGMENTS, 16), (simhash.LONG_SEGMENTS, 8192), (((16, 0),) * 3 + ((16, 1),), 64)])
def test_links_connect_what_brute_force_connects(spark, segments, rows):
    rng = np.random.default_rng(3)
    fps = list(rng.integers(0, 2**63, 150, dtype=np.uint64))
    for _ in range(250):  # flips of 1 to 6 bits, and one dense group
        base = fps[0] if rng.random() < 0.5 else fps[rng.integers(len(fps))]
        fps.append(np.uint64(base) ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 7), replace=False))))
    fps = sorted({int(x) for x in fps})
    if segments == (((16, 0),) * 3 + ((16, 1),)):
        segments = ((16, 0), (16, 1), (16, 0), (16, 1))
    ids = list(range(100, 100 + len(fps)))
    frame = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for f, i in zip(fps, ids)], "fp long, id long")
    found = {r.node: r.component for r in connected_components(simhash.links(frame, 4, segments, rows)).collect()}
    expected = slow_components(ids, fps)
    assert {i: found.get(i, i) for i in ids} == expected


def test_documents_with_nulls_copies_and_extra_columns(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(9, base), (3, base), (4, base + " tail"), (5, "another thing entirely, quite short"), (6, None), (7, ""), (8, " \n"), (None, base), (3, base), (11, "q " * 20_000)]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, fp string, component_id int, count int")
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    fps = [(r.doc_id, r.fp % 2**64) for r in out]
    assert sorted(fps, key=str) == sorted([(i, slow_fingerprint(t or "")) for i, t in rows], key=str)
    named = [x for x in fps if x[0] is not None]
    expected = slow_components(sorted({i for i, _ in named}), [dict(named)[i] for i in sorted({i for i, _ in named})])
    for r in out:
        assert r.component_id == (None if r.doc_id is None else expected[r.doc_id])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({i for i, c in expected.items() if i == c})
    assert simhash.near_duplicates(docs.where("doc_id < 0")).collect() == []


def test_components_of_a_long_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(1000, 1200)] + [(1, x) for x in range(2, 300)] + [(5000, 5000), (None, 3)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {**{i: 1000 for i in range(1000, 1201)}, **{i: 1 for i in range(1, 300)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("most", [500_000, 0])
def test_one_of_each_group_stays_whatever_the_ids_and_names(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "BROADCAST_CLASSES", most)
    rng = random.Random(5)
    say = lambda: " ".join(f"w{rng.randrange(4000)}" for _ in range(200))
    a, b, c = say(), say(), say()
    rows = [
        (1, a, "x", 1), (1, b, "x", 1),  # one id, two texts: both stay
        (2, a, "x", 1), (3, b + " end", "x", 1), (4, c, "x", 1), (4, c, "x", 1),  # equal rows: one stays
        (4, c, "y", 1), (5, None, "x", 1), (6, "", "x", 1), (None, a, "x", 1), (None, a, "x", 1), (7, say(), "x", None),
    ]
    docs = spark.createDataFrame(rows, "a long, b string, c string, d int").toDF("doc_id", "text", "_gone", "odd `fp`").repartition(3)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    out = sorted(((r[0], r[1]) for r in kept.collect()), key=str)
    assert out == sorted([(1, a), (1, b), (4, c), (5, None), (None, a), (None, a), (7, rows[-1][1])], key=str)
    assert sorted(map(tuple, simhash.keep_one(docs.repartition(1)).collect()), key=str) == sorted(map(tuple, kept.collect()), key=str)
    assert simhash.keep_one(docs.where("doc_id < 0")).collect() == []
