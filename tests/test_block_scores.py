"""Scores of one block: frequent terms laid out, others by lists, for some queries and columns, against plain sums."""

import numpy as np
import pytest

from docquarry.operators import postings as ps
from docquarry.operators.blocks import Best


@pytest.mark.parametrize("cells,added", [(1 << 22, 1 << 22), (150, 7), (0, 1)])
def test_scores_of_some_queries_and_columns(monkeypatch, cells, added):
    monkeypatch.setattr(ps, "DENSE_CELLS", cells), monkeypatch.setattr(ps, "ADDED_AT_A_TIME", added)
    rng, rows, terms = np.random.default_rng(5), 50, 40
    table = rng.random((terms, rows)) * (rng.random((terms, rows)) < rng.random((terms, 1)) ** 3)
    term, row = np.nonzero(table)
    mixed = rng.permutation(len(term))
    block = ps._Block(row[mixed], term[mixed], table[term, row][mixed], rows, terms)
    asked = [rng.permutation(terms)[:n] for n in (0, 1, 9, 40)]
    for columns in (np.arange(rows), np.array([3, 4, 31]), np.arange(0)):
        expected = np.array([table[t].sum(0)[columns] for t in asked])
        assert np.allclose(block.scores(asked, columns), expected, rtol=0, atol=1e-12)
    assert (block.place >= 0).any() == (cells > 0)


def test_rounding_the_few_equals_rounding_all():
    """Scores that are equal once rounded go by key, zeros are nobody's best, whatever came before."""
    rng = np.random.default_rng(3)
    best, plain = Best(40, 5), Best(40, 5)
    for at in range(0, 400, 80):
        raw = np.round(rng.random((40, 80)) * rng.integers(0, 2, (40, 80)), 5) + rng.random((40, 80)) * 9e-7
        raw[:3] = 0
        raw[3, 7:] = 0
        keys = rng.permutation(80) + at
        best.add(raw, keys, np.arange(40), 6)
        whole = np.round(raw, 6)
        whole[whole <= 0] = -np.inf
        plain.add(whole, keys, np.arange(40))
    assert all(np.array_equal(getattr(best, x), getattr(plain, x)) for x in ("query", "key", "score", "least")) and len(best.query)
