import re
from collections import Counter, defaultdict

import pytest

from docquarry.llm import divergence as dv
from tests.oracle import compare, connection


def slow(rows, least_docs, top=10):
    count, docs, groups = Counter(), Counter(), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        count.update((lang, source, w) for w in words)
        docs.update((lang, w) for w in set(words))
    out = []
    for lang, sources in groups.items():
        kept = [w for (x, w), n in docs.items() if x == lang and n >= least_docs]

        def share(of, w):
            total = sum(count[lang, s, v] for s in of for v in kept)
            return 1 + 10**9 * (sum(count[lang, s, w] for s in of) + 2) // (total + 2 * len(kept))

        gap = lambda p, q: (p - q) ** 2 // (p + q)
        p = {(s, w): share([s], w) for s in sources for w in kept}
        q = {w: share(sources, w) for w in kept}
        for s in sources:
            found = {"pair": [(-sum(gap(p[s, w], p[o, w]) for w in kept), o.encode()) for o in sources - {s}], "term": [(-gap(p[s, w], q[w]), w.encode()) for w in kept if count[lang, s, w] and p[s, w] > q[w]]}
            for part, xs in found.items():
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(sorted(xs), 1) if part == "pair" or k <= top]
    return sorted(out)


ROWS = [
    ("en", "a", "The cat, the CAT; the dog"), ("en", "a", "a cat"), ("en", "b", "Dog dog dog É é Éa"), ("en", None, "the É"), ("en", "", "cat É"), ("en", "c", None), ("en", "d", "123 ... \x00\t"),
    (None, "a", "only here"), ("", "b", "only there é"), ("de", "a", "einmal"), ("de", "b", ""), ("fr", "x", "un un"), ("fr", "x", "un"), ("en", "a", "a cat"), ("en", "e", "\U0001f600cat\U0001f600 ﬀ ﬀ \U0001f600"), ("en", "b", "\U0001f600 ﬀ " + "word cat " * 20_000),
]


@pytest.mark.parametrize("least_docs", [1, 2, 3])
@pytest.mark.parametrize("broadcast", [100, 0])
def test_against_plain_sums(spark, tmp_path, monkeypatch, least_docs, broadcast):
    monkeypatch.setattr(dv, "BROADCAST_SOURCES", broadcast)
    docs = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "lang string, source string, text string, term string, n int").repartition(3)
    out = dv.divergence(docs, str(tmp_path / "files"), least_docs=least_docs, top=2)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, out.collect())) == slow(ROWS, least_docs, top=2)


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert dv.divergence(docs, str(tmp_path / "files")).collect() == []


def test_large_counts_are_exact(spark):
    cases = [(c, d) for d in (1, 2, 7, 10**9 + 7, 8 * 10**15 + 3) for c in (0, 1, d // 3, d - 1, d)]
    rows = spark.createDataFrame(cases, "c long, d long").select("c", "d", dv._scaled(dv.F.col("c"), dv.F.col("d")).alias("x")).collect()
    assert [r.x for r in rows] == [10**9 * r.c // r.d for r in rows]


def test_query_against_sql(spark):
    compare(spark, connection(), dv.QUERIES["op12_source_divergence"], dv.ORACLES["op12_source_divergence"])
