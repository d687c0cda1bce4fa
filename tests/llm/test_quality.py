import random
import re

import numpy as np

from docquarry.llm import quality
from docquarry.llm.trees import fit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    words, lines = WORD.findall(text or ""), (text or "").split("\n")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    dup = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)]


def test_statistics_equal_the_plain_form(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t\n", "a", "a a a a", "a b c a b c", "x\ny\nx\n\n \n \nx", "é#ü|\x85 \x1cq 🙂<>", "tail\n"]
    texts += [" ".join(rng.choice(["é", "b", "c\n", "d#", "\x0b", "E!"]) for _ in range(rng.randrange(1, 120))) for _ in range(80)]
    docs = spark.createDataFrame([(i, t, 1, True) for i, t in enumerate(texts)] + [(None, "no id", 1, True)], "doc_id long, text string, n_words int, kept boolean")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert len(out) == len(texts) + 1
    for i, t in enumerate(texts):
        r = out[i]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == slow(t), repr(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed) and r.p_good is None
    assert quality.judge(docs.where("doc_id < 0"), labels).collect() == []
    assert quality.statistics(b"w%d " * 50_000)[0] == 50_000


def test_many_kinds_of_words():
    words = [f"{i}".encode() for i in range((1 << 20) + 10)] + [b"0", b"1", b"2"]
    assert quality._repeated(words) == (6, (1 << 20) + 10)


def test_monotonic_and_better_than_chance():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = (rng.random(3000) < 1 / (1 + np.exp(8 * (x[:, 0] - 0.5) - 4 * np.sin(9 * x[:, 1])))).astype(float)
    forest = fit(x[:2000], y[:2000], [-1, 0, 0])
    held = forest.score(x[2000:])
    assert ((held > 0) == (y[2000:] > 0)).mean() > 0.8
    for row in x[:50]:
        line = np.tile(row, (200, 1))
        line[:, 0] = np.linspace(0, 1, 200)
        assert (np.diff(forest.score(line)) <= 1e-12).all()


def test_trees_on_labels(spark):
    rng = random.Random(4)
    clean = lambda: " ".join(rng.choice("alpha beta gamma delta eta theta iota".split()) + str(rng.randrange(500)) + rng.choice(["", "", ","]) for _ in range(80))
    rows = [(i, clean() if i % 3 else clean().replace(" ", "### ")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 300)] + [(7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.kept for r in quality.judge(docs, labels).collect()}
    assert all(out[i] == bool(i % 3) for i in range(300, 400))


def slow_features(text):
    """The columns of FEATURES, written out for one text."""
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    n, chars, symbols, dup, again = *map(len, (words, "".join(words))), *slow(text)[2:]
    each = lambda pattern: len(re.findall(pattern, text))
    per_word, per_char = max(n, 1), max(chars, 1)
    return [
        symbols / per_word, dup / max(len(lines), 1), again / per_word, each("[A-Z]") / per_char, each("[!?]") / per_word, each("[0-9]") / per_char,
        chars / per_word, per_word / max(len(lines), 1), each("[.,;:]") / per_word, len(set(words)) / per_word, np.log(per_word),
    ]


def slow_score(forest, row):
    """Every tree walked node by node."""
    total = forest.base
    for at in forest.roots:
        while forest.feature[at] >= 0:
            at = forest.left[at] if row[forest.feature[at]] < forest.threshold[at] else forest.right[at]
        total += forest.value[at]
    return total


def test_verdicts_of_a_table_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None and r.doc_id in texts}
    ids = sorted(good)
    rows = {i: slow_features(t) for i, t in texts.items()}
    forest = fit(np.array([rows[i] for i in ids]), np.array([float(good[i] > 0) for i in ids]), [sign for _, sign in quality.FEATURES])
    out = {r.doc_id: r for r in quality.op5_boosted_quality(spark, sf).collect()}
    assert out.keys() == texts.keys() and {r.kept for r in out.values()} == {True, False}
    for i, r in out.items():
        p = 1 / (1 + np.exp(-slow_score(forest, rows[i])))
        assert abs(r.p_good - p) < 1e-9 and r.kept == (not r.base_failed and p >= quality.KEEP_FROM)


def test_repeated_ids_count_once_when_fitting(spark):
    rows = [(i, " ".join(["word"] * 3 + [f"w{i}{k}" for k in range(60)]) + (" ###" * 40 if i % 2 else "")) for i in range(80)]
    labels = [(i, int(i % 2 == 0)) for i in range(80)]
    stats = lambda rows: quality.document_statistics(spark.createDataFrame(rows, "doc_id long, text string"))
    known = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    once, again = (quality.fit_on_labels(stats(r), known(m)) for r, m in ((rows, labels), (rows * 4, labels + labels[:40])))
    assert (once.threshold == again.threshold).all() and (once.value == again.value).all()
