"""Vector search in stored neighbour graphs.

Rows are dealt out into shards of a bounded size; each shard becomes one row of a table: its keys and vectors, and a
graph whose links are the near neighbours of each vector, thinned so that they point in different directions, and the
same the other way round. A few vectors also lie in a sparser layer above, and so on upwards. A query goes down from
the top, best first, and keeps a beam of the best rows met; what it meets is all that is compared with it.

With a group (a label, a tenant) each vector also has links to near neighbours of its own group, and a filtered search
walks on these alone, so rows that do not pass are never compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators.blocks import arrow_type, in_arrow, in_blocks
from docquarry.operators.sparse import top
from docquarry.operators.vectors import QUERIES_AT_A_TIME, _matrix

#: Rows of a shard, about; links of a vector; share of a layer that the layer above has.
SHARD_ROWS, LINKS, THINNED = 4096, 12, 16
#: Rows that a walk keeps at least; queries that walk at a time.
BEAM, WALKERS = 24, 256
_SCHEMA = "shard int, keys array<{key}>, owns array<string>, vectors binary, dims int, layers array<binary>, links array<binary>, widths array<int>"


def _near(v: np.ndarray, links: int) -> np.ndarray:
    """For each vector its links, -1 where there are fewer: near neighbours in different directions first, then those that link to it."""
    n = len(v)
    pool = min(n - 1, 3 * links)
    out = np.full((n, 2 * links), -1, np.int32)
    if pool < 1:
        return out
    back: list[list[int]] = [[] for _ in range(n)]
    for at in range(0, n, 512):
        some = v[at : at + 512] @ v.T
        some[np.arange(len(some)), np.arange(at, at + len(some))] = -np.inf
        best = np.argpartition(-some, pool - 1, axis=1)[:, :pool]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(some, best, 1), axis=1, kind="stable"), 1)
        for i, row in enumerate(best):
            own, among = some[i, row], v[row] @ v[row].T
            chosen: list[int] = []
            for j in range(pool):
                if len(chosen) == links:
                    break
                if not chosen or own[j] > among[j, chosen].max():
                    chosen.append(j)
            chosen += [j for j in range(pool) if j not in chosen][: links - len(chosen)]
            out[at + i, : len(chosen)] = row[chosen]
            for j in row[chosen].tolist():
                back[j].append(at + i)
    for i, those in enumerate(back):
        known = set(out[i, :links].tolist())
        more = [j for j in those if j not in known]
        more = sorted(more, key=lambda j: -float(v[i] @ v[j]))[:links] if len(more) > links else more
        out[i, links : links + len(more)] = more
    return out


def _build(keys: np.ndarray, v: np.ndarray, owns: list, links: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Layers (places of their vectors; rows come in the order of their hashes, so the first are a random choice) and links within each, lowest first; with groups the links of each within its own come last."""
    layers, found, n = [], [], len(v)
    while n:
        layers.append(np.arange(n, dtype=np.int32))
        found.append(_near(v[:n], links))
        n //= THINNED
    if owns[0] is not None or any(x is not None for x in owns):
        inside = np.full((len(v), 2 * links), -1, np.int32)
        names = np.array([x if x is not None else "" for x in owns], object)
        for value in dict.fromkeys(owns):
            here = np.flatnonzero(names == value) if value is not None else np.array([k for k, x in enumerate(owns) if x is None])
            near = _near(v[here], links)
            inside[here] = np.where(near >= 0, here[near], -1)
        layers.append(np.arange(len(v), dtype=np.int32))
        found.append(inside)
    return layers, found


class _Walk:
    """Beams of some queries over one shard."""

    def __init__(self, v: np.ndarray, q: np.ndarray, beam: int):
        self.v, self.q, self.beam = v, q, beam
        self.seen = np.zeros((len(q), len(v)), bool)
        self.computed = np.zeros(len(q), np.int64)
        self.row = np.full((len(q), beam), -1)
        self.score = np.full((len(q), beam), -np.inf)
        self.done = np.zeros((len(q), beam), bool)

    def meet(self, rows: np.ndarray) -> None:
        """Compare each query with some rows (-1: none) and keep the best."""
        who = np.arange(len(self.q))[:, None]
        new = (rows >= 0) & ~self.seen[who, np.maximum(rows, 0)]
        for a in range(rows.shape[1]):  # a row may be named twice
            new[:, a] &= ~self.seen[who[:, 0], np.maximum(rows[:, a], 0)]
            self.seen[who[:, 0][new[:, a]], rows[:, a][new[:, a]]] = True
        query, place = np.nonzero(new)
        score = np.full(rows.shape, -np.inf)
        score[query, place] = np.einsum("ij,ij->i", self.q[query], self.v[rows[query, place]])
        self.computed += new.sum(1)
        both = np.concatenate((self.score, score), 1)
        order = np.argsort(-both, axis=1, kind="stable")[:, : self.beam]
        self.score = np.take_along_axis(both, order, 1)
        self.row = np.where(np.isfinite(self.score), np.take_along_axis(np.concatenate((self.row, np.where(new, rows, -1)), 1), order, 1), -1)
        self.done = np.take_along_axis(np.concatenate((self.done, np.zeros(rows.shape, bool)), 1), order, 1)

    def go(self, links: np.ndarray, width: int) -> None:
        """Walk on until the `width` best rows of every query have been left by all their links."""
        while True:
            open_ = (self.row[:, :width] >= 0) & ~self.done[:, :width]
            if not open_.any():
                return
            first, any_ = open_.argmax(1), open_.any(1)
            who = np.arange(len(self.q))
            self.done[who[any_], first[any_]] = True
            self.meet(np.where(any_[:, None], links[np.maximum(self.row[who, first], 0)], -1))

    def again(self) -> None:
        """Begin a layer: what was met is kept, and may be left once more."""
        self.done[:] = False


class Navigable:
    """A stored table of graphs; `search` gives top lists, `walk` also how many rows were compared."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.shards = spark, spark.read.parquet(path)

    @classmethod
    def write(cls, corpus: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", group: str | None = None, links: int = LINKS, shard_rows: int = SHARD_ROWS) -> Navigable:
        """Index all rows that have a key and a vector (of unit length, all of one size); the number of shards follows from a count. Repeated keys are indexed as often as they come."""
        spark = corpus.sparkSession
        own = F.col(group).cast("string") if group else F.lit(None).cast("string")
        rows = corpus.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector"), own.alias("own"))
        shards = max(1, -(-rows.count() // shard_rows))
        key_type = arrow_type(rows, "key")

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            current = None

            def out() -> pa.RecordBatch:
                whole = pa.Table.from_batches(held).combine_chunks()
                v, owns = _matrix(whole["vector"].combine_chunks()).astype(np.float32), whole["own"].to_pylist()
                layers, found = _build(whole["key"].to_numpy(), v, owns, links)
                row = [[current], [whole["key"].to_pylist()], [owns], [v.tobytes()], [v.shape[1]], [[x.tobytes() for x in layers]], [[x.tobytes() for x in found]], [[x.shape[1] for x in found]]]
                kinds = [pa.int32(), pa.list_(key_type), pa.list_(pa.string()), pa.binary(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int32())]
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], [c.split()[0] for c in _SCHEMA.split(", ")])

            for batch in batches:
                shard = batch.column(0).to_numpy()
                starts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)])).tolist() if len(shard) else [0]
                for a, b in zip(starts, starts[1:]):
                    if current is not None and shard[a] != current:
                        yield out()
                        held = []
                    current = int(shard[a])
                    held.append(batch.slice(a, b - a))
            if held:
                yield out()

        order = F.xxhash64("key", "vector")
        dealt = rows.withColumn("order", order).withColumn("shard", F.pmod(F.xxhash64("order"), F.lit(shards)).cast("int")).repartition(shards, "shard").sortWithinPartitions("shard", "order")
        dealt.select("shard", "key", "vector", "own").mapInArrow(of, _SCHEMA.format(key=rows.schema["key"].dataType.simpleString())).write.mode("overwrite").parquet(path)
        return cls(spark, path)

    def walk(self, queries: DataFrame, k: int, beam: int = BEAM, group: str | None = None) -> DataFrame:
        """qid, key, score of the k best of each query and shard, and a row for each of them without key: `computed`, the rows it was compared with.

        queries: qid, qvec, and with `group` the value within which each looks (null: within none).
        """
        key = self.shards.schema["keys"].dataType.elementType.simpleString()
        schema, qid_type = f"qid {queries.schema['qid'].dataType.simpleString()}, key {key}, score double, computed long", arrow_type(queries, "qid")
        spark, key_type = self.spark, arrow_type(self.shards, "keys").value_type
        own = [F.col(group).cast("string").alias("own")] if group else []

        def of_block(block: list) -> DataFrame:
            shared = spark.sparkContext.broadcast(([r[0] for r in block], np.array([r[1] for r in block], np.float32), [r[2] for r in block] if group else None))

            def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                ids, q, wanted = shared.value
                for batch in batches:
                    for k in range(batch.num_rows):
                        yield _walked(batch.slice(k, 1).to_pylist()[0], ids, q, wanted)

            def _walked(shard: dict, ids: list, q: np.ndarray, wanted: list | None) -> pa.RecordBatch:
                v = np.frombuffer(shard["vectors"], np.float32).reshape(-1, shard["dims"])
                links = [np.frombuffer(x, np.int32).reshape(-1, w) for x, w in zip(shard["links"], shard["widths"])]
                grouped = any(x is not None for x in shard["owns"])
                out: list[list] = [[], [], [], []]
                for who, start in _starts(shard["owns"], wanted, len(ids), len(links) - grouped, links):
                    for at in range(0, len(who), WALKERS):
                        some = who[at : at + WALKERS]
                        w = _Walk(v, q[some], max(beam, k))
                        w.meet(np.tile(start, (len(some), 1)))
                        if wanted is None:
                            for layer in range(len(links) - grouped - 1, 0, -1):
                                w.go(links[layer], 1)
                                w.again()
                            w.go(links[0], w.beam)
                        else:
                            w.go(links[-1], w.beam)
                        for i, n in enumerate(some):
                            rows = w.row[i][w.row[i] >= 0][:k]
                            out[0] += [ids[n]] * (len(rows) + 1)
                            out[1] += [shard["keys"][r] for r in rows] + [None]
                            out[2] += [*w.score[i][: len(rows)].tolist(), None]
                            out[3] += [None] * len(rows) + [int(w.computed[i])]
                return pa.RecordBatch.from_arrays([pa.array(out[0], qid_type), pa.array(out[1], key_type), pa.array(out[2], pa.float64()), pa.array(out[3], pa.int64())], ["qid", "key", "score", "computed"])

            return in_arrow(self.shards, of, schema)

        asked = queries.where("qvec IS NOT NULL").select("qid", "qvec", *own).orderBy("qid").toLocalIterator()
        found = in_blocks(map(tuple, asked), QUERIES_AT_A_TIME, of_block)
        return spark.createDataFrame([], schema) if found is None else found

    def search(self, queries: DataFrame, k: int, beam: int = BEAM, group: str | None = None) -> DataFrame:
        """qid, key, score, rank: about the k nearest rows of each query."""
        return top(self.walk(queries, k, beam, group).where("key IS NOT NULL").select("qid", "key", F.round("score", 6).alias("score")), k, key="key")


#: Rows that a walk sets out from within a group.
GROUP_STARTS = 4


def _starts(owns: list, wanted: list | None, n: int, layers: int, links: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries with the rows they set out from: all of the top layer, or some of their group."""
    if wanted is None:
        yield np.arange(n), np.arange(len(links[layers - 1]))
        return
    by_value: dict[str, list[int]] = {}
    for k, x in enumerate(owns):
        if x is not None and len(by_value.setdefault(x, [])) < GROUP_STARTS:
            by_value[x].append(k)
    for value, rows in by_value.items():
        who = np.array([k for k, x in enumerate(wanted) if x == value], int)
        if len(who):
            yield who, np.array(rows)
