"""A second vector store, of product-quantised codes: a byte for each part of a vector instead of its numbers.

Codebooks are fitted on a bounded sample, every row is coded. A search adds up, for each row, one entry of a table for each
part (the products of the query's part with the part's 256 centres), keeps the best of each task, and compares these
with the query exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators.blocks import Best, arrow_type, in_arrow, in_blocks
from docquarry.operators.sparse import top
from docquarry.operators.vectors import SAMPLE, SCORES_AT_A_TIME, _matrix, dot
from docquarry.session import checkpointed, few

#: Parts of a vector, centres of a part, rounds of fitting; candidates for each row asked for; queries at a time.
PARTS, CENTRES, ROUNDS, CANDIDATES, QUERIES_AT_A_TIME = 16, 256, 8, 10, 1024


def fit_codebooks(corpus: DataFrame, parts: int = PARTS, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """[part, centre, number]: k-means of each part on at most `sample` vectors, those with the smallest hashes of their keys. Vectors are of one size, a multiple of `parts`."""
    some = corpus.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample).select(vector).toArrow()[vector].combine_chunks()
    v = _matrix(some)
    if not len(v):
        return np.zeros((parts, 0, 0))
    if v.shape[1] % parts:
        raise ValueError(f"vectors of {v.shape[1]} numbers have no {parts} equal parts")
    books = []
    for x in np.split(v, parts, axis=1):
        centres = x[:CENTRES].copy()
        for _ in range(rounds):
            nearest = _nearest(x, centres)
            count = np.bincount(nearest, minlength=len(centres))
            total = np.zeros_like(centres)
            np.add.at(total, nearest, x)
            centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        books.append(centres)
    return np.array(books)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - (centres**2).sum(1) / 2).argmax(1)


class Quantized:
    """Stored codes beside the corpus they were made of."""

    def __init__(self, spark: SparkSession, path: str, corpus: DataFrame, books: np.ndarray, key: str = "vec_id", vector: str = "embedding"):
        self.spark, self.codes, self.corpus, self.books, self.key, self.vector = spark, spark.read.parquet(path), corpus, books, key, vector

    @classmethod
    def write(cls, corpus: DataFrame, path: str, parts: int = PARTS, key: str = "vec_id", vector: str = "embedding", group: str | None = None) -> Quantized:
        """Code every row that has a key and a vector. Without rows there are no codes."""
        books = fit_codebooks(corpus, parts, key, vector)
        spark = corpus.sparkSession
        shared = spark.sparkContext.broadcast(books)
        own = F.col(group).cast("string") if group else F.lit(None).cast("string")
        source = corpus.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector"), own.alias("own"))

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = shared.value
            for batch in batches:
                v = _matrix(batch.column(1))
                if len(v):
                    code = np.stack([_nearest(x, c) for x, c in zip(np.split(v, len(books), axis=1), books)], 1).astype(np.uint8)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in code], pa.binary()), batch.column(2)], ["key", "code", "own"])

        source.mapInArrow(of, f"key {source.schema['key'].dataType.simpleString()}, code binary, own string").write.mode("overwrite").parquet(path)
        return cls(spark, path, corpus, books, key, vector)

    def candidates(self, queries: DataFrame, n: int, group: str | None = None) -> DataFrame:
        """qid, key, score, rank: the n rows of each query (qid, qvec, and the value it looks within) that are best by their codes."""
        spark, books = self.spark, self.books
        schema, qid_type, key_type = f"qid {queries.schema['qid'].dataType.simpleString()}, key {self.codes.schema['key'].dataType.simpleString()}, score double", arrow_type(queries, "qid"), arrow_type(self.codes, "key")
        own = [F.col(group).cast("string").alias("own")] if group else []

        def of_block(block: list) -> DataFrame:
            q = np.array([r[1] for r in block], np.float64)
            tables = np.einsum("qpd,pcd->pqc", q.reshape(len(q), len(books), -1), books) if books.size else np.zeros((0, len(q), 0))
            shared = spark.sparkContext.broadcast(([r[0] for r in block], tables, [r[2] for r in block] if group else None))

            def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                ids, tables, wanted = shared.value
                number = {g: k for k, g in enumerate(dict.fromkeys(x for x in wanted if x is not None))} if wanted else {None: 0}
                mine = np.array([number.get(g, -2) for g in wanted]) if wanted else np.zeros(len(ids), np.int64)
                # The queries of each value are compared with its rows only.
                asking = [(who, tables[:, who]) for who in (np.flatnonzero(mine == g) for g in number.values())]
                best, at_a_time = Best(len(ids), n), max(1, SCORES_AT_A_TIME // max((len(who) for who, _ in asking), default=1))
                for whole in batches:
                    for at in range(0, whole.num_rows, at_a_time):
                        batch = whole.slice(at, at_a_time)
                        code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                        keys = batch.column(0).to_numpy(zero_copy_only=False)
                        theirs = np.array([number.get(g, -1) for g in batch.column(2).to_pylist()]) if wanted else np.zeros(len(keys), np.int64)
                        for g in np.unique(theirs[theirs >= 0]).tolist():
                            (who, own), inside = asking[g], theirs == g
                            scores = np.zeros((len(who), int(inside.sum())))
                            for part, table in enumerate(own):
                                scores += table[:, code[inside, part]]
                            best.add(scores, keys[inside], who)
                if best.key is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in best.query], qid_type), pa.array(best.key, key_type), pa.array(best.score)], ["qid", "key", "score"])

            return in_arrow(self.codes.select("key", "code", "own"), of, schema)

        asked = queries.where("qvec IS NOT NULL").select("qid", "qvec", *own).orderBy("qid").toLocalIterator()
        found = in_blocks(map(tuple, asked), QUERIES_AT_A_TIME, of_block)
        return top(found if found is not None else spark.createDataFrame([], schema), n, key="key")

    def search(self, queries: DataFrame, k: int, group: str | None = None, candidates: int = CANDIDATES) -> DataFrame:
        """qid, key, score, rank: the k best of `candidates` times as many, by exact comparison."""
        chosen = checkpointed(self.candidates(queries, candidates * k, group).select("qid", "key"))
        own = self.corpus.select(F.col(self.key).alias("key"), F.col(self.vector).alias("_v"))
        met = chosen.join(own.join(few(chosen.select("key").distinct()), "key"), "key").join(queries.select("qid", "qvec"), "qid")
        return top(met.select("qid", "key", F.round(dot(F.col("qvec"), F.col("_v")), 6).alias("score")), k, key="key")
