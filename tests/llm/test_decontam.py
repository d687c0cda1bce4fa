import random

import numpy as np
import pytest

from docquarry.llm import decontam


def items(n, seed=0, vocabulary=400):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % vocabulary}"
    return [(i, " ".join(word() for _ in range(rng.randrange(6, 40))).capitalize() + ". " + " ".join(word() for _ in range(rng.randrange(2, 9))) + ".") for i in range(n)]


def brute(index, terms):
    total = np.zeros(len(index.items))
    for t in terms:
        rows = slice(index.first[t], index.first[t + 1])
        total[index.item[rows]] += index.score[rows]
    return total


@pytest.mark.parametrize("threshold", [0.1, 0.25, 0.5, 0.9])
def test_search_returns_all_above_the_threshold(threshold):
    index, rng = decontam.build_index(items(300)), random.Random(1)
    for _ in range(60):
        terms = sorted(rng.sample(range(1, len(index.terms) + 1), rng.randrange(1, 60)))
        total = brute(index, terms)
        assert sorted(i for i, _ in index.search(terms, threshold)) == np.nonzero(total >= threshold - 1e-9)[0].tolist()
        for i, s in index.search(terms, threshold):
            assert abs(s - total[i]) < 1e-9


def test_longest_common():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 14))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + [0] * 0 + _next(row, x, b)
        assert decontam.longest_common(a, b) == row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[-1]))
    return out[1:]


def test_passages_are_bounded_from_above():
    """No passage that reaches the threshold is left out by the first bound."""
    index, rng = decontam.build_index(items(100)), random.Random(5)
    half = max(32, index.longest)
    for _ in range(30):
        ids = np.array([rng.randrange(0, len(index.terms) + 1) for _ in range(rng.randrange(1, 400))])
        over = set(decontam._halves_over(index, ids, half, 0.3).tolist())
        for h in range(-(-len(ids) // half)):
            passage = ids[h * half : (h + 2) * half]
            if (brute(index, np.unique(passage[passage > 0])) >= 0.3).any():
                assert h in over


def test_leaks(spark):
    bench = items(80) + [(900, None), (901, ""), (902, "!!"), (None, "Only one unusual sentence stands here in this item"), (3, items(80)[3][1])]
    benchmark = spark.createDataFrame([(i, t, "s") for i, t in bench], "item_id long, text string, score string")
    rng = random.Random(9)
    noise = lambda n: " ".join(f"n{rng.randrange(900)}" for _ in range(n))
    by_id = dict(items(80))
    w = by_id[11].split()
    docs = [
        (1, noise(500) + " " + by_id[7] + " " + noise(90)), (2, by_id[7].upper().replace(" ", ",  ")), (3, noise(700)), (4, None), (5, ""),
        (6, noise(20) + " ".join(w[: len(w) // 2])), (7, "x " * 30_000 + by_id[5] + " y" * 30_000), (8, by_id[11] + " and " + by_id[12]), (None, by_id[20]), (8, by_id[11]),
        (9, noise(64) + " only one UNUSUAL sentence stands here in this item"), (10, " ".join(reversed(by_id[30].split()))), (12, by_id[3]),
    ]
    frame = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, item_id string").repartition(3)
    out = sorted(((r.doc_id, r.item_id) for r in decontam.leaks(frame, benchmark).collect()), key=str)
    assert out == sorted([(1, 7), (2, 7), (7, 5), (8, 11), (8, 12), (8, 11), (None, 20), (9, None), (12, 3), (12, 3)], key=str)
    split = decontam.leaks(frame, benchmark, index_words=100)
    assert sorted(((r.doc_id, r.item_id) for r in split.collect()), key=str) == out
    kept = decontam.without_leaks(frame, benchmark)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 10]
    assert decontam.leaks(frame.where("doc_id < 0"), benchmark).collect() == []
    assert decontam.leaks(frame, benchmark.where("item_id = 901")).collect() == []


def test_one_index_and_many_agree_on_partial_copies(spark):
    """The statistics are those of all items: scores and verdicts are the same however they are split."""
    bench, rng = items(200, seed=4, vocabulary=900), random.Random(10)
    docs = []
    for n in range(600):
        w = bench[rng.randrange(len(bench))][1].split()
        share = rng.uniform(0.5, 1)
        docs.append((n, " ".join(x if rng.random() < share else f"n{rng.randrange(50)}" for x in w)))
    benchmark, frame = spark.createDataFrame(bench, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    one = sorted(map(tuple, decontam.leaks(frame, benchmark).collect()))
    assert sum(1 for _ in decontam._indexes(benchmark, 400)) >= 2 * decontam.INDEXES_AT_A_TIME
    many = sorted(map(tuple, decontam.leaks(frame, benchmark, index_words=400).collect()))
    assert 100 < len(one) < 550
    assert one == many
    kept = {r.doc_id for r in decontam.without_leaks(frame, benchmark, index_words=400).collect()}
    assert kept == {n for n, _ in docs} - {d for d, *_ in one}
    both = [(i, *t.split(". ", 1)) for i, t in bench]
    apart = spark.createDataFrame(both, "item_id long, question string, answer string")
    assert sorted(map(tuple, decontam.leaks(frame, apart, index_words=400).collect())) == sorted(map(tuple, decontam.leaks(frame, apart).collect()))


def test_a_very_long_text_equals_brute_force(spark):
    bench, rng = items(60), random.Random(2)
    noise = [f"n{rng.randrange(5000)}" for _ in range(120_000)]
    planted = {7: 100, 23: 64_000, 41: 119_000}
    for i, at in sorted(planted.items(), key=lambda x: -x[1]):
        noise[at:at] = bench[i][1].split()
    out = decontam.leaks(spark.createDataFrame([(1, " ".join(noise))], "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), index_words=200)
    assert sorted((r.doc_id, r.item_id, r.question_overlap) for r in out.collect()) == [(1, i, 1.0) for i in sorted(planted)]


def edited(text, every):
    """A word inserted after each so many."""
    out = []
    for n, w in enumerate(text.split(), 1):
        out += [w, f"extra{n}"] if n % every == 0 else [w]
    return " ".join(out)


@pytest.mark.parametrize("every", [5, 7, 9, 15])
def test_an_edited_copy_beside_a_part_is_found(every):
    long = (99, " ".join(f"v{n * 7 % 331}" for n in range(380)) + ". " + " ".join(f"u{n}" for n in range(20)) + ".")
    bench = items(50, seed=8, vocabulary=3000) + [long]
    indexes = list(decontam._by_class(bench, None))
    assert len(indexes) == 2
    found = lambda t: {x.items[i] for x in indexes for i in decontam.find(x, t, decontam.THRESHOLD, decontam.OVERLAP)}
    for i, t in bench:
        question = t.split(". ")[0]
        for text in (edited(t, every), f"{question}. {edited(t, every)}", f"{edited(t, every)} so {question}", f"{question} {question} then {edited(t, every)} {question}"):
            assert i in found("noise " * 70 + text + " noise" * 50), (i, text)
    assert 99 not in found(long[1].split(". ")[0] + " and nothing else")


def test_windows_are_all_of_them():
    """Every window of brute force that suffices is found, wherever passages begin."""
    rng = random.Random(12)
    bench = items(30, seed=5, vocabulary=60)
    (index,) = decontam._by_class(bench, None)
    for _ in range(40):
        parts = []
        for _ in range(6):
            w = bench[rng.randrange(30)][1].split()
            parts += [x for x in w if rng.random() < rng.choice((0.7, 0.9, 1.0))] + [f"n{rng.randrange(9)}" for _ in range(rng.randrange(0, 25))]
        tokens = decontam.words(" ".join(parts))
        got = decontam.find(index, " ".join(parts), 0.0001, decontam.OVERLAP)
        for k in range(len(index.items)):
            q, a = index.question[k], index.answer[k]
            n = len(q) + len(a)
            room = decontam.room_of(n)
            best = [(decontam.longest_common(q, near) / len(q), decontam.longest_common(a, near) / len(a) if a else 1.0) for at in range(0, len(tokens), room) for near in [tokens[at : at + n + 2 * room]]]
            assert (k in got) == any(x >= decontam.OVERLAP and y >= decontam.OVERLAP for x, y in best)
