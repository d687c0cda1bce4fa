"""Corrective answering against a walk through the same states, question by question."""

import math
import re
from collections import Counter

import pytest

from docquarry.operators import corrective, sparse
from docquarry.operators.postings import Postings

WORDS = "alpha beta gamma delta sales cost margin growth Apple units total revenue".split()
DOCS = [(n, " ".join(WORDS[(n * k + k * k) % len(WORDS)] for k in range(3 + n % 4)) + (f" {n * 100}" if n % 3 == 0 else ""), "xy"[n % 2], "table" if n % 3 == 0 else "prose", 2020 + n % 4) for n in range(1, 25)]
DOCS += [(30, None, "x", "prose", 2020), (31, "", "y", "table", None)]
QUESTIONS = [(1, "alpha beta sales"), (2, "total revenue growth of delta"), (3, "nothing known here"), (4, "gamma margin and cost units"), (5, "unplanned"), (6, "how many units of beta")]
SUBS = [
    (1, 1, "alpha beta sales", "x", [2020]), (1, 2, "alpha margin", None, []), (2, 1, "total revenue", None, [2021, 2022]), (2, 2, "growth of delta zeta eta theta", "y", None),
    (3, 1, "nothing known here", None, []), (4, 1, "gamma margin cost", "nowhere", []), (4, 2, "cost units margin Apple", None, [2019]), (6, 1, "how many units of beta", None, []),
]


def toks(text):
    return [t for t in re.findall(r"[a-z0-9]+", (text or "").lower()) if t not in TOKEN_STOPS]


TOKEN_STOPS = {"of", "and", "how", "here", "many"}


def bm25(query, keep, k):
    docs = [(d, Counter(toks(t)), d2) for d, t, *d2 in DOCS]
    mean = sum(sum(c.values()) for _, c, _ in docs) / len(docs)
    out = []
    for i, c, meta in docs:
        score = 0.0
        for t in set(toks(query)):
            df = sum(t in x for _, x, _ in docs)
            score += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * c[t] * (sparse.K1 + 1) / (c[t] + sparse.K1 * (1 - sparse.B + sparse.B * sum(c.values()) / mean))
        if round(score, 6) > 0 and keep(*meta):
            out.append((-round(score, 6), i))
    return [i for _, i in sorted(out)[:k]]


def walked(subs):
    hits, tried = [], Counter()
    for q, s, text, company, years in subs:
        n = sum(x[0] == q for x in subs)
        width, query, tables, years, mine = max(2, 6 // n), text, False, years or [], []
        for r in range(3):
            tried[q, s] += 1
            found = bm25(query, lambda c, kind, y, co=company, tb=tables, ys=years: (co is None or c == co) and (not tb or kind == "table") and (not ys or y in ys), 6)[: width if r == 0 else 4]
            for place, d in enumerate(found, 1):
                if d not in [x[2] for x in mine]:
                    have, want = set(toks(next(t for i, t, *_ in DOCS if i == d))), set(toks(text))
                    share = len(have & want) / max(len(want), 1)
                    mine.append((q, s, d, r, place, 2 if share >= 0.6 else 1 if share >= 0.2 else 0))
            if any(x[5] == 2 for x in mine) or r == 2:
                break
            words = query.split(" ")
            query, tables = " ".join(words[len(words) // 2 :]), bool(re.search(corrective.FIGURE, text))
            years = sorted({*years, *(y + 1 for y in years)}) if r == 0 else years
        hits += mine
    return sorted(hits), tried


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, company string, kind string, year int")
    index = Postings.write(docs, str(tmp_path_factory.mktemp("corrective") / "index"), keep=("company", "kind", "year"), buckets=2)
    questions = spark.createDataFrame(QUESTIONS, "qid long, question string")
    subs = spark.createDataFrame(SUBS, "qid long, sub int, question string, company string, years array<int>")
    return corrective.correct(questions, subs, index, docs)


def test_hits_and_rounds(found):
    hits, tried = walked(SUBS)
    assert sorted(map(tuple, found.hits.select("qid", "sub", "doc_id", "round", "place", "grade").collect())) == hits
    assert {(r.qid, r.sub): r.tried for r in found.subs.collect()} == tried
    assert {(r.qid, r.sub): r.answered for r in found.subs.collect()} == {k: any(h[:2] == k and h[5] == 2 for h in hits) for k in tried}
    assert {1, 3} <= set(tried.values()) and any(h[3] > 0 for h in hits)


def test_answers(found):
    hits, _ = walked(SUBS)
    rows = {r.qid: r for r in found.answers.collect()}
    assert rows.keys() == {q for q, _ in QUESTIONS}
    for q, row in rows.items():
        taken: list[int] = []
        for s in sorted({x[1] for x in SUBS if x[0] == q}):
            mine = [h for h in hits if h[0] == q and h[1] == s and h[5] > 0 and h[2] not in taken]
            taken += [h[2] for h in sorted(mine, key=lambda h: (-h[5], h[3], h[4], h[2]))][:4]
        assert (row.passages or []) == taken
        assert row.refused_by == ("plan" if q == 5 else None if taken else "no relevant passages")
        if taken:
            position = int(row.answer[-2])
            text = next(t for i, t, *_ in DOCS if i == taken[position - 1])
            assert row.answer == f"{text} [{position}]" and position == row.fixes + 1
