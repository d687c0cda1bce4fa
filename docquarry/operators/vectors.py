"""Vector search: exact by matrix products in Arrow batches, approximate by an inverted file of fitted cells."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.text import split_tokens
from docquarry.operators.blocks import Best, arrow_type, bounded, in_arrow, in_blocks
from docquarry.operators.sparse import parents, top

#: Query vectors that are sent to every worker at a time; more are searched block by block.
QUERIES_AT_A_TIME = 4096
#: Scores (queries times rows) that a worker holds at a time.
SCORES_AT_A_TIME = 1 << 20
#: Vectors that cells are fitted on, at most: those with the smallest hashes of their keys.
SAMPLE = 20_000
CELLS = 32
#: Recall at FIT_K that the sample's own searches must reach, for which probes are chosen; a filtered search looks further away than its k.
TARGET, FIT_K = 0.95, 100


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def _hashed(lists: pa.Array, dims: int, places: dict[str, int]) -> np.ndarray:
    """The default embedder's vector of each list of tokens; `places` are those that were hashed before."""
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    if len(places) > 200_000:
        places.clear()
    for w in words:
        if w not in places:
            places[w] = int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % dims
    place = np.array([places[w] for w in words], np.int64)
    cell = parents(lists) * dims + place[coded.indices.to_numpy(zero_copy_only=False)] if len(place) else np.empty(0, np.int64)
    found = np.bincount(cell, minlength=len(lists) * dims).reshape(-1, dims).astype(float)
    length = np.sqrt((found**2).sum(1, keepdims=True))
    return found / np.where(length > 0, length, 1)


def embed(texts: DataFrame, key: str, toks: str, out: str, dims: int = 64) -> DataFrame:
    """key, out: the default embedder, token counts in `dims` hashed places, of unit length (all zero without tokens)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str, int] = {}
        for batch in bounded(batches):
            found = _hashed(batch.column(1), dims, places)
            flat = pa.array(found.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, dims, dtype=np.int32)), flat)], [key, out])

    kind = texts.schema[key].dataType.simpleString()
    return in_arrow(texts.select(key, toks), of, f"{key} {kind}, {out} array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _search(corpus: DataFrame, queries: DataFrame, k: int, key: str, vector: str, group: str | None, scorer: Callable[[np.ndarray], Callable[[np.ndarray], np.ndarray]], earlier: bool) -> DataFrame:
    """The k best of each query by the scores that scorer(query matrix)(row matrix) gives, -inf for no candidate. A vector that is a string is joined tokens, which the default embedder reads in the same worker."""
    spark = corpus.sparkSession
    own = [group] if group else []
    source = corpus.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(key, vector, *own)
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    joined = kinds[vector] == "string"
    schema, qid_type, key_type = f"qid {queries.schema['qid'].dataType.simpleString()}, {key} {kinds[key]}, score double", arrow_type(queries, "qid"), arrow_type(source, key)

    def of_block(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(([r[0] for r in block], np.array([r[1] for r in block], np.float64), [r[2] for r in block] if group else None))

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, groups = shared.value
            best, everyone = Best(len(ids), k), np.arange(len(ids))
            number = {g: n for n, g in enumerate(dict.fromkeys(groups))} if group else {None: 0}
            mine = np.array([number[g] for g in groups]) if group else np.zeros(len(ids), np.int64)
            # The queries of each group are compared with its rows only.
            asking = [(who, scorer(q[who]), np.array(ids)[who]) for who in (everyone[mine == n] for n in number.values())]
            at_a_time = max(1, SCORES_AT_A_TIME // max(len(who) for who, _, _ in asking))
            places: dict[str, int] = {}
            for whole in bounded(batches):
                for at in range(0, whole.num_rows, at_a_time):
                    batch = whole.slice(at, at_a_time)
                    keys = batch.column(0).to_numpy(zero_copy_only=False)
                    rows = _hashed(split_tokens(batch.column(1)), q.shape[1], places) if joined else _matrix(batch.column(1))
                    theirs = np.array([number.get(g, -1) for g in batch.column(2).to_pylist()]) if group else np.zeros(len(keys), np.int64)
                    for n in np.unique(theirs[theirs >= 0]).tolist():
                        (who, scores_of, own), inside = asking[n], theirs == n
                        scores = np.round(scores_of(rows[inside]), 6)
                        if earlier:
                            scores[own[:, None] <= keys[inside][None, :]] = -np.inf
                        best.add(scores, keys[inside], who)
            if best.key is not None:
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in best.query], qid_type), pa.array(best.key, key_type), pa.array(best.score)], ["qid", key, "score"])

        return in_arrow(source, of, schema)

    asked = queries.where("qvec IS NOT NULL").select("qid", "qvec", *own).orderBy("qid").toLocalIterator()
    found = in_blocks(map(tuple, asked), QUERIES_AT_A_TIME, of_block)
    return top(found if found is not None else spark.createDataFrame([], schema), k, key=key)


def exact_search(corpus: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", group: str | None = None, earlier: bool = False) -> DataFrame:
    """qid, key, score (cosine of unit vectors), rank: the k nearest of every query.

    queries: qid, qvec (and the group it may search in). earlier: only rows with a key below the query's own id
    are candidates. Where vector is a column of joined tokens (text.joined_tokens), the rows are embedded as they are
    read. Batches of the corpus are multiplied with the query matrix and only a task's k best for each
    query go on, so what is shuffled is k rows a query and task. Rows and queries without a vector match nothing.
    """
    return _search(corpus, queries, k, key, vector, group, lambda q: lambda v: q @ v.T, earlier)


@dataclass
class Cells:
    """centres: one row a cell; probes: how many of the nearest cells a query looks into."""

    centres: np.ndarray
    probes: int


def fit_cells(corpus: DataFrame, cells: int = CELLS, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, target: float = TARGET, rounds: int = 15) -> Cells:
    """Cells by k-means on a sample of at most `sample` vectors, and the fewest probes with which searches of the sample in itself reach the target recall."""
    some = corpus.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample).select(vector).toArrow()[vector].combine_chunks()
    v = _matrix(some)
    cells = min(cells, len(v))
    if not cells:
        return Cells(np.zeros((0, 0)), 0)
    centres = v[:cells].copy()  # the order is one of hashes, so these are a random choice
    for _ in range(rounds):
        nearest = (v @ centres.T).argmax(1)
        for c in range(cells):
            if (nearest == c).any():
                mean = v[nearest == c].mean(0)
                centres[c] = mean / (np.linalg.norm(mean) or 1.0)
    nearest = (v @ centres.T).argmax(1)
    asked = v[:: max(1, len(v) // 500)]
    truth = np.argsort(-(asked @ v.T), axis=1, kind="stable")[:, : FIT_K + 1]
    order = np.argsort(-(asked @ centres.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # of each cell in the query's order
    needed = np.take_along_axis(place, nearest[truth], axis=1)
    for probes in range(1, cells + 1):
        if (needed < probes).mean() >= target:
            break
    return Cells(centres, probes)


def inverted_file_search(corpus: DataFrame, queries: DataFrame, cells: Cells, k: int, key: str = "vec_id", vector: str = "embedding", group: str | None = None) -> DataFrame:
    """Approximate: each row lies in its nearest cell, and a query is compared with the rows of its nearest cells only. Rows are placed as they are read, without a shuffle; every row is indexed."""
    centres, probes = cells.centres, cells.probes

    def scorer(q: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        order = np.argsort(-np.round(q @ centres.T, 6), axis=1, kind="stable")[:, :probes]
        probed = np.zeros((len(q), len(centres)), bool)
        np.put_along_axis(probed, order, True, axis=1)

        def scores_of(v: np.ndarray) -> np.ndarray:
            scores, nearest = np.full((len(q), len(v)), -np.inf), np.round(v @ centres.T, 6).argmax(1)
            for c in np.unique(nearest):
                who, rows = np.nonzero(probed[:, c])[0], np.nonzero(nearest == c)[0]
                scores[np.ix_(who, rows)] = q[who] @ v[rows].T
            return scores

        return scores_of

    return _search(corpus, queries, k, key, vector, group, scorer, False)


def pairwise_moments(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """label, n, mean, deviation of the cosines of all pairs of a label, without forming pairs.

    The cosines sum to half of the squared length of the summed unit vectors less n, their squares to half of the
    squared entries of the sum of outer products less n. Both sums are made in each task before the shuffle.
    """
    kind, own_type = vectors.schema[label].dataType.simpleString(), arrow_type(vectors, label)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            labels, v = np.array(batch.column(0).to_pylist(), object), _matrix(batch.column(1))
            for own in dict.fromkeys(labels.tolist()):
                u = v[[x == own for x in labels]]
                u = u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
                flat = np.concatenate(([len(u)], u.sum(0), (u.T @ u).ravel()))
                sums[own] = u.shape[1], flat + (sums[own][1] if own in sums else 0)
        for own, (dims, flat) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([own] * len(flat), own_type), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat), pa.array(np.full(len(flat), dims, np.int32))], [label, "place", "x", "dims"])

    summed = vectors.where(F.col(vector).isNotNull()).select(label, vector).mapInArrow(of, f"{label} {kind}, place int, x double, dims int").groupBy(label, "place", "dims").agg(F.sum("x").alias("x"))
    square = F.col("x") * F.col("x")
    both = summed.groupBy(label).agg(F.sum(F.when(F.col("place") == 0, F.col("x"))).alias("n"), F.sum(F.when(F.col("place").between(1, F.col("dims")), square)).alias("s"), F.sum(F.when(F.col("place") > F.col("dims"), square)).alias("g"))
    n, pairs = F.col("n"), F.col("n") * (F.col("n") - 1) / 2
    mean = (F.col("s") - n) / 2 / pairs
    return both.where("n > 1").select(label, n.cast("long").alias("n"), mean.alias("mean"), F.sqrt(F.greatest((F.col("g") - n) / 2 / pairs - mean * mean, F.lit(0.0))).alias("deviation"))
