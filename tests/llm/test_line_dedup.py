import random

from docquarry.llm import line_dedup as ld


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def slow(rows, least=5):
    """Texts after removal, by comparing every line with every earlier one."""
    places = sorted({(i, ld.row_of(t), k, tuple(ld.words_of(x))) for i, t in rows if i is not None and t is not None for k, x in enumerate(t.split("\n")) if len(ld.words_of(x)) >= least})
    gone = {p[:3] for n, p in enumerate(places) if any(distance(q[3], p[3]) <= 1 for q in places[:n])}
    return [(i, t if i is None or t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, ld.row_of(t), k) not in gone)) for i, t in rows]


def test_within_one_edit_and_variants():
    rng = random.Random(1)
    for _ in range(4000):
        a = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(5, 9))]
        b = list(a) if rng.random() < 0.7 else [rng.choice([b"a", b"b"]) for _ in range(rng.randrange(5, 9))]
        for _ in range(rng.randrange(0, 3)):
            k = rng.randrange(len(b))
            b[k : k + rng.randrange(0, 2)] = [rng.choice([b"a", b"b", b"d"])] * rng.randrange(0, 2)
        near = distance(a, b) <= 1
        assert ld.within_one_edit(a, b) == near
        if near and min(len(a), len(b)) >= 2:
            assert set(ld.half_keys(a)) & set(ld.half_keys(b))
            (wa, da, ga), (wb, db, gb) = ld.variant_keys(a), ld.variant_keys(b)
            assert wa == wb or wa in set(db.tolist()) or wb in set(da.tolist()) or set(ga.tolist()) & set(gb.tolist())


def test_equals_brute_force(spark):
    rng = random.Random(6)
    base = [" ".join(rng.choice("alpha Beta gamma delta eps zeta".split()) for _ in range(rng.randrange(1, 9))) for _ in range(30)]

    def line():
        w = rng.choice(base).split()
        if rng.random() < 0.4:
            k = rng.randrange(len(w))
            w[k : k + rng.randrange(0, 2)] = [rng.choice(["new", "Old"])] * rng.randrange(0, 2)
        return rng.choice([" ", "  "]).join(w)

    rows = [(i % 70, "\n".join(line() for _ in range(rng.randrange(0, 9)))) for i in range(80)]
    rows += [(None, base[0]), (None, None), (500, None), (501, ""), (502, "\n\n"), (503, "many " * 1500), (504, "many " * 1501), (505, "x\n" * 3000), rows[3], rows[3]]
    docs = spark.createDataFrame([(i, t, "r", 0, 1) for i, t in rows], "doc_id long, text string, row string, n_chars int, line_no int").repartition(3)
    out = ld.dedup_lines(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(slow(rows), key=str)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())
    assert ld.dedup_lines(docs.where("doc_id < 0")).collect() == []


def test_a_group_of_near_copies_and_no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ld, "BROADCAST_PLACES", 0), monkeypatch.setattr(ld, "BROADCAST_KEYS", 0)
    text = [f"one two three four five six seven w{i}" for i in range(200)]
    rows = [(i, t + "\nshort line\n" + text[0]) for i, t in enumerate(text)]
    out = ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), marks=True).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out) == sorted((i, 3, 2 if i else 1, "short line" if i else text[0] + "\nshort line") for i in range(200))


def test_clashing_names_and_marks(spark):
    line = "one two three four five six"
    rows = [(i, line + "\nown words of number " + str(i) * 3, 7, 8, 9, "a", "b") for i in range(4)]
    names = ["doc_id", "text", "_kept", "gone", "n_lines", "odd `name`", "c0"]
    docs = spark.createDataFrame(rows, "a long, b string, c int, d int, e int, f string, g string").toDF(*names)
    out = ld.dedup_lines(docs)
    assert out.columns == names
    assert sorted(tuple(r)[2:] for r in out.collect()) == [(7, 8, 9, "a", "b")] * 4
    expected = slow([r[:2] for r in rows])
    assert sorted((r[0], r[1]) for r in out.collect()) == sorted(expected) and expected[1][1] != rows[1][1]
    marked = ld.dedup_lines(docs, marks=True)
    assert marked.columns == ["doc_id", "text", "_kept", "gone", "odd `name`", "c0", "n_lines", "n_dropped"]
    assert all(r.n_lines == 2 for r in marked.collect())
