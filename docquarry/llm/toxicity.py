"""Toxicity by a classifier chain of linear models.

The categories are label columns in a given order. Each is predicted by a logistic model over word features;
each model also sees the log-odds that the earlier models of the chain give. When a model is fitted these come
from out-of-fold predictions, so that it learns from what earlier models say of documents they have not seen.

Features are whole words and the beginnings of words, counted over the whole text (as log(1 + count)), and the
log of the word count. Those kept are the ones that set the labelled classes of some category apart most.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import as_text, checkpointed, mapped, slices, table, text_column

#: Labelled documents that the chain is fitted on, at most; those with the smallest hashes of their ids.
FIT_ROWS = 6000
#: Features kept for each category, at most.
FEATURES = 1500
#: A feature must occur in so many labelled documents.
LEAST_DOCUMENTS = 5
#: Lengths of the beginnings of words.
BEGINNINGS = (3, 4, 5, 6)
FOLDS = 3
#: Features that a Python worker counts before it hands its counts on.
COUNTED = 50_000
#: Words whose features a Python worker remembers.
REMEMBERED = 150_000

_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    """The whole word and its shorter beginnings."""
    return [f"={word}", *(word[:n] for n in BEGINNINGS if n < len(word))]


def counts_of(text: str) -> Counter:
    return Counter(f for w, n in Counter(_WORD.findall(text.lower())).items() for f in word_features(w) * n)


def _sums(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of the runs of values that begin at `start` (which has the end too); an empty run is 0."""
    out, filled = np.zeros(len(start) - 1), start[1:] > start[:-1]
    if filled.any():
        out[filled] = np.add.reduceat(values, start[:-1][filled])
    return out


@dataclass
class Rows:
    """A sparse matrix by rows."""

    start: np.ndarray
    column: np.ndarray
    value: np.ndarray
    width: int

    @cached_property
    def by_column(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each column begins, and the rows and values in order of columns."""
        order = np.argsort(self.column, kind="stable")
        row = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        return np.searchsorted(self.column[order], np.arange(self.width + 1)), row[order], self.value[order]

    def times(self, w: np.ndarray) -> np.ndarray:
        return _sums(self.value * w[self.column], self.start)

    def back(self, r: np.ndarray) -> np.ndarray:
        start, row, value = self.by_column
        return _sums(value * r[row], start)

    def some(self, rows: np.ndarray) -> Rows:
        lengths = np.diff(self.start)[rows]
        take = np.repeat(self.start[rows] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        return Rows(np.concatenate(([0], np.cumsum(lengths))), self.column[take], self.value[take], self.width)


def fit_logistic(x: Rows, dense: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 160) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the sparse columns and of the dense ones (the first is the constant), by accelerated gradient steps on scaled columns."""
    scale = 1 / np.sqrt(x.back(np.ones(len(y))) ** 2 / max(len(y), 1) ** 2 + np.bincount(x.column, x.value**2, x.width) / max(len(y), 1) + 1e-3)
    d_scale = 1 / np.sqrt((dense**2).mean(0) + 1e-9)
    probe = np.ones(x.width)
    for _ in range(12):  # the largest curvature, by power iteration
        probe = scale * x.back(x.times(scale * probe))
        top = np.sqrt((probe**2).sum()) or 1.0
        probe /= top
    rate = 1 / (0.25 * (top + len(y) * dense.shape[1]) + l2)
    w, v = np.zeros(x.width), np.zeros(dense.shape[1])
    wz, vz, t = w, v, 1.0
    free = np.concatenate(([0.0], np.ones(dense.shape[1] - 1)))
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(x.times(scale * wz) + dense @ (d_scale * vz), -30, 30))) - y
        w2, v2 = wz - rate * (scale * x.back(r) + l2 * wz), vz - rate * (d_scale * (dense.T @ r) + l2 * free * vz)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        wz, vz = w2 + (t - 1) / t2 * (w2 - w), v2 + (t - 1) / t2 * (v2 - v)
        w, v, t = w2, v2, t2
    return scale * w, d_scale * v


@dataclass
class Chain:
    """Models in order; model k has one more dense weight for each model before it."""

    categories: list[str]
    features: dict[str, int]
    sparse: list[np.ndarray]
    dense: list[np.ndarray]
    thresholds: list[float]

    def log_odds(self, x: Rows, n_words: np.ndarray) -> np.ndarray:
        out, dense = [], np.stack([np.ones(len(n_words)), np.log1p(n_words)], 1)
        for w, v in zip(self.sparse, self.dense):
            out.append(x.times(w) + dense @ v)
            dense = np.column_stack([dense, np.clip(out[-1], -12, 12)])
        return np.stack(out, 1)


def _threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The cut of out-of-fold scores with the best F1, in the middle of the gap it lies in."""
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    best = int(f1.argmax())
    below = score[order[best + 1]] if best + 1 < len(y) else score[order[best]] - 2
    return float((score[order[best]] + below) / 2)


def fit_chain(categories: list[str], features: list[str], x: Rows, n_words: np.ndarray, labels: np.ndarray, folds: int = FOLDS) -> Chain:
    """labels: a column of 0 or 1 for each category. Row i is in fold i % folds."""
    chain = Chain(categories, {f: k for k, f in enumerate(features)}, [], [], [])
    dense, fold = np.stack([np.ones(len(n_words)), np.log1p(n_words)], 1), np.arange(len(n_words)) % folds
    for k in range(len(categories)):
        y, unseen = labels[:, k].astype(float), np.zeros(len(n_words))
        for f in range(folds):
            here, there = np.nonzero(fold != f)[0], np.nonzero(fold == f)[0]
            if len(here) and len(there):
                w, v = fit_logistic(x.some(here), dense[here], y[here])
                unseen[there] = x.some(there).times(w) + dense[there] @ v
        w, v = fit_logistic(x, dense, y)
        chain.sparse.append(w), chain.dense.append(v), chain.thresholds.append(_threshold(unseen, y))
        dense = np.column_stack([dense, np.clip(unseen, -12, 12)])
    return chain


def _informative(n: int, of: np.ndarray, seen: np.ndarray, with_it: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of features: `seen` documents have one, `with_it` of these are in a class of `of` among n."""
    def part(a, b):
        return np.where(a > 0, a * np.log(np.maximum(a, 1e-12) / np.maximum(b, 1e-12)), 0.0)

    total = 0.0
    for has, size in ((with_it, of), (seen - with_it, n - of)):
        total = total + part(has, seen * size / n) + part(size - has, (n - seen) * size / n)
    return 2 * total


def fit_on_labels(docs: DataFrame, labels: DataFrame, categories: list[str], positive: dict[str, int], key: str = "doc_id", text: str = "text", rows: int = FIT_ROWS, keep: int = FEATURES) -> Chain | None:
    """The chain, from `rows` labelled documents at most; None where the last category has not both classes among them.

    Documents with a missing label are left out; of rows that repeat an id one label each is taken. The driver
    gets the documents each feature is in by class (features in LEAST_DOCUMENTS documents or more, of the bounded
    sample) and the kept features' counts.
    """
    known = labels.where(F.col("doc_id").isNotNull())
    for c in categories:
        known = known.where(F.col(c).isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(*(F.max((F.col(c) == positive[c]).cast("int")).alias(f"_y{k}") for k, c in enumerate(categories)))
    some = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    marks = [f"_y{k}" for k in range(len(categories))]
    # One pass over documents; what follows reads the sample, which is bounded by `rows` ids.
    sample = checkpointed(docs.select(F.col(key).cast("long").alias("_id"), text_column(text)).join(F.broadcast(some), "_id").select("_id", "text", *marks))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            columns = list(zip(*seen.values())) or [()] * (len(marks) + 1)
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], ["f", "n", *marks])

        for batch in slices(batches, 64):
            ys = list(zip(*(batch.column(m).to_pylist() for m in marks)))
            for t, y in zip(as_text(batch.column("text")), ys):
                for f in counts_of(t):
                    at = seen.setdefault(f, [0] * (len(y) + 1))
                    at[0] += 1
                    for k, one in enumerate(y, 1):
                        at[k] += one
            if len(seen) > COUNTED:
                yield out()
                seen.clear()
        yield out()

    counted = sample.mapInArrow(grams, f"f string, n long, {', '.join(f'{m} long' for m in marks)}").groupBy("f").agg(*(F.sum(c).alias(c) for c in ["n", *marks]))
    totals = sample.agg(F.count("*").alias("n"), *(F.sum(m).alias(m) for m in marks)).first()
    n = totals["n"]
    if not n or totals[marks[-1]] in (None, 0, n):
        return None
    found = counted.where(F.col("n") >= LEAST_DOCUMENTS).orderBy("f").toArrow().to_pandas()
    chosen: set[str] = set()
    for m in marks:
        worth = _informative(n, totals[m], found["n"].to_numpy(float), found[m].to_numpy(float))
        best = np.argsort(-worth, kind="stable")[:keep]
        chosen |= set(found["f"].to_numpy()[best[worth[best] > 6.6]])
    names = sorted(chosen)
    index = {f: k for k, f in enumerate(names)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns, values, sizes = [], [], []
            for t in as_text(batch.column("text")):
                own = {index[f]: v for f, v in counts_of(t).items() if f in index}
                columns.append(sorted(own)), values.append([own[c] for c in sorted(own)]), sizes.append(len(_WORD.findall(t)))
            yield pa.RecordBatch.from_arrays([pa.array(columns, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int32())), pa.array(sizes, pa.int64()), batch.column("_id"), *(batch.column(m) for m in marks)], ["c", "v", "n_words", "_id", *marks])

    frame = sample.mapInArrow(vectors, f"c array<int>, v array<int>, n_words long, _id long, {', '.join(f'{m} int' for m in marks)}").toArrow().combine_chunks()
    of = lambda c: frame.column(c).to_numpy()
    flat = lambda c: frame.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    lengths = pc.list_value_length(frame.column("c")).to_numpy()
    order = np.lexsort((of("n_words"), of("_id") * 2654435761 % 2**32))
    x = Rows(np.concatenate(([0], np.cumsum(lengths))), flat("c").astype(np.int64), np.log1p(flat("v").astype(float)), len(names)).some(order)
    return fit_chain(categories, names, x, of("n_words")[order], np.stack([of(m) for m in marks], 1)[order])


class Scorer:
    """Log-odds of texts; remembers which kept features a word has."""

    def __init__(self, chain: Chain):
        self.chain, self.known = chain, {}

    def _of(self, word: str) -> tuple:
        index = self.chain.features
        found = tuple(index[f] for f in word_features(word) if f in index)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[word] = found
        return found

    def __call__(self, texts: list[str]) -> np.ndarray:
        start, column, value, sizes = [0], [], [], []
        for t in texts:
            words, get, miss, hits = _WORD.findall(t.lower()), self.known.get, self._of, []
            for w in words:
                f = get(w)
                if f is None:
                    f = miss(w)
                if f:
                    hits += f
            own = Counter(hits)
            column += own.keys()
            value += own.values()
            start.append(len(column)), sizes.append(len(words))
        x = Rows(np.array(start), np.array(column, np.int64), np.log1p(np.array(value, float)), len(self.chain.features))
        return self.chain.log_odds(x, np.array(sizes, float))


def _fitted(docs: DataFrame, labels: DataFrame, categories, positive, key, text, rows) -> Chain | None:
    return fit_on_labels(docs, labels, list(categories), positive or dict.fromkeys(categories, 1), key, text, rows)


def score(docs: DataFrame, labels: DataFrame, categories: tuple = ("quality", "toxic"), positive: dict | None = None, key: str = "doc_id", text: str = "text", rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, p_<category> for each category of the chain, rejected (the last category is over its threshold) of every document.

    positive gives the label that counts as the category (1 unless named). Texts that are null or have no words
    are scored by the constants; texts of any length are scored whole. A score equal to the threshold is not
    rejected. Without labels of both classes of the last category nothing is rejected and all probabilities are
    null. Repeated rows are scored each, a null id stays null, other columns do not matter, whatever their names;
    an empty table gives no rows.
    """
    chain = _fitted(docs, labels, categories, positive, key, text, rows)
    names = [f"p_{c}" for c in categories]
    schema = f"doc_id long, {', '.join(f'{c} double' for c in names)}, rejected boolean"
    source = docs.select(F.col(key).cast("long").alias("doc_id"), text_column(text))
    if chain is None:
        return source.select("doc_id", *(F.lit(None).cast("double").alias(c) for c in names), F.lit(False).alias("rejected"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(chain)
        for batch in slices(batches):
            odds = scorer(as_text(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (1 / (1 + np.exp(-np.clip(odds, -500, 500)))).T), pa.array(odds[:, -1] > chain.thresholds[-1])], ["doc_id", *names, "rejected"])

    return source.mapInArrow(of, schema)


def without_toxic(docs: DataFrame, labels: DataFrame, categories: tuple = ("quality", "toxic"), positive: dict | None = None, key: str = "doc_id", text: str = "text", rows: int = FIT_ROWS) -> DataFrame:
    """The documents that score does not reject, with all their columns; filtered where they lie, without a shuffle."""
    chain = _fitted(docs, labels, categories, positive, key, text, rows)
    if chain is None:
        return docs
    where = docs.columns.index(text)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(chain)
        for batch in slices(batches):
            yield batch.filter(pa.array(scorer(as_text(batch.column(where)))[:, -1] <= chain.thresholds[-1]))

    return mapped(docs, of)


#: The labelled categories of the tables at hand: low quality (label 0), then toxic.
LOW_QUALITY_THEN_TOXIC = {"quality": 0, "toxic": 1}


def op8_chain_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs, labels, tuple(LOW_QUALITY_THEN_TOXIC), LOW_QUALITY_THEN_TOXIC).withColumnRenamed("p_quality", "p_low_quality")


QUERIES = {"op8_chain_toxicity": op8_chain_toxicity}
ORACLES: dict[str, str] = {}
