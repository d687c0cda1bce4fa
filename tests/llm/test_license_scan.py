import random

from docquarry.llm import license_scan as ls
from docquarry.llm.common import words


def test_patience_is_a_rising_alignment_and_whole_on_unique_words():
    rng = random.Random(2)
    for _ in range(300):
        b = [rng.randrange(12) for _ in range(rng.randrange(0, 25))]
        a = [x for x in b if rng.random() < 0.8]
        for _ in range(rng.randrange(0, 4)):
            a.insert(rng.randrange(len(a) + 1), rng.randrange(12, 20))
        pairs = ls.patience(a, b)
        assert all(a[p] == b[q] for p, q in pairs)
        assert all(p < r and q < s for (p, q), (r, s) in zip(pairs, pairs[1:]))
    unique = list(range(50))
    cut = [x for x in unique if x % 7]
    assert len(ls.patience([100, *cut, 101], unique)) == len(cut)


def test_gaps_are_aligned_by_words_unique_in_them():
    # "the" and "of" are unique only between the anchors x and y
    assert ls.patience("the of x the of y of the".split(), "of the x the q of y the of".split())[:3] != []
    pairs = ls.patience("a x the b y the c".split(), "a x the d y the c".split())
    assert len(pairs) == 6


def test_scan_finds_what_trying_every_window_finds():
    rng = random.Random(4)
    templates = [("short", "Granted under the Plain License, version 7."), ("long", "you may use and share and sell this work as long as this notice and the name of the author go with the work in all copies")]
    known = ls.Templates(templates, 0.8)
    vocabulary = [w.decode() for w in known.index] + ["n1", "n2", "n3"]
    for _ in range(200):
        doc = [rng.choice(vocabulary[-3:] if rng.random() < 0.9 else vocabulary) for _ in range(rng.randrange(0, 120))]
        for _, t in templates:
            if rng.random() < 0.5:
                w = t.split()
                for _ in range(rng.randrange(0, 5)):
                    k = rng.randrange(len(w))
                    w[k : k + rng.randrange(0, 2)] = ["zz"] * rng.randrange(0, 2)
                at = rng.randrange(len(doc) + 1)
                doc[at:at] = w
        found = {x[0] for x in known.scan(" ".join(doc))}
        tokens = words(" ".join(doc))
        for (name, _), (_, t) in zip(templates, known.all):
            sure = any(len(ls.patience(tokens[a : a + len(t)], t)) >= 0.8 * len(t) and tokens[a] == t[0] for a in range(len(tokens)))
            assert not sure or name in found


def test_documents(spark):
    apache, mit = ls.TEMPLATES[0][1], ls.TEMPLATES[8][1]
    rows = [
        (1, "noise " * 50 + apache + " more " * 9 + apache), (2, "the of and " * 5000 + mit.upper().replace(",", " ;")), (3, None), (4, ""), (5, "no license here"), (None, apache),
        (6, mit.replace("merge, publish, distribute,", "")), (7, " ".join(reversed(apache.split()))), (1, "noise " * 50 + apache), (8, "Released under the MIT License"), (9, "x " * 40_000),
    ]
    docs = spark.createDataFrame([(i, t, "l", 0.0) for i, t in rows], "doc_id long, text string, license string, coverage double").repartition(3)
    out = sorted(((r.doc_id, r.license, round(r.coverage, 2), r.places) for r in ls.scan(docs).collect()), key=str)
    n = len(words(mit))
    assert out == sorted([(1, "Apache-2.0", 1.0, 2), (1, "Apache-2.0", 1.0, 1), (2, "MIT-text", 1.0, 1), (None, "Apache-2.0", 1.0, 1), (6, "MIT-text", round((n - 3) / n, 2), 1), (8, "MIT", 1.0, 1)], key=str)
    assert [(r.first_word, r.last_word) for r in ls.scan(docs.where("doc_id = 1")).collect() if r.places == 1] == [(50, 57)]
    assert ls.scan(docs.where("doc_id = 99")).collect() == [] and ls.scan(docs, []).collect() == []


def test_templates_that_are_alike_are_told_apart():
    """Every notice, clean, loosely set, or amid others, is its own license and no other."""
    known = ls.Templates(ls.TEMPLATES, ls.COVERAGE)
    for name, notice in ls.TEMPLATES:
        n = len(words(notice))
        assert [(x[0], x[1], x[3] - x[2] + 1) for x in known.scan(f"some words before. {notice} and after")] == [(name, 1.0, n)], name
        assert [x[0] for x in known.scan(notice.lower().replace(" ", " * "))] == [name]
    both = known.scan("Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0. Licensed under CC BY-NC 4.0.")
    assert sorted((x[0], x[1], x[4]) for x in both) == [("CC-BY-4.0", 1.0, 1), ("CC-BY-NC-4.0", 1.0, 2)]
    gpl = dict(ls.TEMPLATES)["GPL-header"]
    assert [x[0] for x in known.scan(gpl.replace("hope", "").replace("details", "detail"))] == ["GPL-header"]
    assert known.scan(gpl.replace("version 3", "version 1")) == []  # neither 2 nor 3
    assert known.scan("Licensed under CC BY-NC 3.0.") == [] and known.scan("This work is licensed under the GNU General Public License, version 1.") == []
    assert known.scan("This work is licensed under the GNU Lesser General Public License, version 2.") == []  # neither the Lesser 2.1 nor the General 2


def test_what_is_no_license_is_not_found():
    known = ls.Templates(ls.TEMPLATES, ls.COVERAGE)
    rng = random.Random(12)
    vocabulary = sorted({w.decode() for _, t in known.all for w in t})
    for _ in range(200):
        assert known.scan(" ".join(rng.choice(vocabulary) for _ in range(300))) == []
    for t in ("Released under the moon", "The Apache License is a license.", "licensed under the general public", "version 2.0 of the License"):
        assert known.scan(t) == []


def test_very_long_texts_and_clashing_names(spark):
    notice = dict(ls.TEMPLATES)["CC-BY-NC-4.0"]
    rows = [(1, "filler words go on " * 60_000 + notice), (2, (notice + " x ") * 3000), (2, "y"), (3, None)]
    docs = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], "doc_id long, text string, license string, places int, first_word int, `odd``name` int")
    out = sorted((r.doc_id, r.license, r.coverage, r.first_word, r.last_word, r.places) for r in ls.scan(docs).collect())
    assert out == [(1, "CC-BY-NC-4.0", 1.0, 240_000, 240_006, 1), (2, "CC-BY-NC-4.0", 1.0, 0, 6, 3000)]


def test_notices_of_a_table_and_nothing_else(spark):
    """All pairs of document and license, against the notices written out."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    notices = {n: b" " + b" ".join(words(t)) + b" " for n, t in ls.TEMPLATES}
    expected = {(r.doc_id, n) for r in docs.collect() for n, x in notices.items() if x in b" " + b" ".join(words(r.text or "")) + b" "}
    assert len(expected) > 10 and {(r.doc_id, r.license) for r in ls.scan(docs).collect()} == expected
