"""A stored inverted file for BM25, as four tables that Spark writes once and every search prunes.

Documents are numbered as they are written; those of one block, at most BLOCK_DOCS, have neighbouring numbers.

* `docs`: doc_id, tokens (as one string, read as the array toks) and kept columns of each document, with its block and its place there, and its length.
* `blocks`: the places, ids and lengths of each block.
* `postings`, partitioned by a hash of the term: for each term and block the gaps between its documents' places and how often
  each has it (both packed, as rows of arrays cost Spark several times more), their sums, and the block's maxima; the rare
  terms of a block share a row (most occurrences, shortest document). A term of all documents is thus many rows.
* `terms`, partitioned alike: in how many documents a term is, and how often; and `size`, the corpus's number and mean length.

A search reads the partitions of its terms only. A block's postings meet in one task, which keeps its best rows of each
query and passes over the queries to which a block's maxima leave no chance.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from docquarry.functions.text import apart, joined_tokens, split_tokens
from docquarry.operators.blocks import Best, arrow_type, bounded, in_arrow, in_blocks, in_small_batches
from docquarry.operators.sparse import B, K1, Statistics, asked_terms, elsewhere, lengths_of, parents, top
from docquarry.session import union

#: A power of two: documents of a block.
BLOCK_BITS = 11
BLOCK_DOCS = 1 << BLOCK_BITS
#: Partitions of the postings, and parts into which the rows of each are dealt out when written.
BUCKETS, PARTS = 64, 16
#: Terms that are given to the scan one by one; more are joined.
PUSHED_TERMS = 100
#: Queries that are sent to every worker at a time; the postings are dealt out once for each such block.
QUERIES_AT_A_TIME = 8192
#: Scores (queries times documents) that a worker holds at a time.
SCORES_AT_A_TIME = 1 << 21
#: A term that one in DENSE_PART of a block's documents has is laid out over all of them, in a table of so many cells at most.
DENSE_PART, DENSE_CELLS = 16, 1 << 22
#: Contributions (postings times queries that ask for their term) that a worker adds up at a time.
ADDED_AT_A_TIME = 1 << 22
#: Gaps are below BLOCK_DOCS, counts may be of any size.
GAP, COUNT = np.dtype("<u2"), np.dtype("<i4")
#: Bytes of documents of a block that a worker inverts at a time; a block with more has several rows for a term.
INVERTED_AT_A_TIME = 16 << 20
#: Terms in fewer documents of a block share a row with all such terms of their bucket: most terms are rare, and each row costs more than its postings.
RARE = 16
#: Counts of rare terms that a worker holds before it sums them and hands them on.
SUMMED_AT_A_TIME = 1 << 19
_POSTINGS = "bucket int, term string, block long, df long, cf long, gaps binary, tfs binary, max_tf int, min_length int, rare string, dfs binary"
_TERMS = "bucket int, term string, df long, cf long"


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % buckets


@F.arrow_udf(returnType=StructType([StructField("words", StringType()), StructField("length", IntegerType())]))
def _joined(texts: pa.Array) -> pa.Array:
    done = [joined_tokens(part.column(0)) for part in bounded(iter([pa.record_batch([texts], ["text"])]))]
    words, length = pa.concat_arrays([d[0] for d in done]), pa.array(np.concatenate([d[1] for d in done]))
    return pa.StructArray.from_arrays([words, length], ["words", "length"])


def _first_bytes(words: pa.Array) -> np.ndarray:
    """The first eight bytes of each word as a number, by which words sort nearly like themselves."""
    data, at = np.frombuffer(words.buffers()[2], np.uint8), np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4)
    size, out = np.diff(at), np.zeros(len(words), np.uint64)
    for j in range(8):
        out = out << np.uint64(8) | np.where(j < size, data[np.minimum(at[:-1] + j, len(data) - 1)], 0).astype(np.uint64)
    return (out >> np.uint64(1)).astype(np.int64)


def _packed(values: np.ndarray, at: np.ndarray, kind: np.dtype) -> pa.Array:
    """One binary value for each stretch of the values."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * kind.itemsize).astype(np.int32)), pa.py_buffer(values.astype(kind))])


def _unpacked(column: pa.Array, kind: np.dtype) -> pa.Array:
    """The lists that binary values hold; no value is an empty list."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False) // kind.itemsize
    whole = np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(whole))


def _inverted(docs: DataFrame, buckets: int) -> DataFrame:
    """The postings of documents (block, place, length, words); a block read by two tasks, or a large one, has several rows for a term."""

    def invert(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(held).combine_chunks()
        toks = split_tokens(part["words"].combine_chunks())
        coded = toks.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if not words:
            return
        rows, places, lengths = part.num_rows, part["place"].to_numpy(), part["length"].to_numpy()
        order = np.argsort(places, kind="stable")
        rank = np.argsort(order)
        cell, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * rows + rank[parents(toks)], return_counts=True)
        code, row = cell // rows, order[cell % rows]
        place, length = places[row], lengths[row]
        first = np.searchsorted(code, np.arange(len(words)))
        gaps = np.diff(place, prepend=0)
        gaps[first] = place[first]
        at = np.append(first, len(code))
        bucket, df = np.array([bucket_of(w, buckets) for w in words]), np.diff(at)
        # The terms that have a row of their own, then the rare ones by bucket; their postings are brought into that order.
        own, rare = np.flatnonzero(df >= RARE), np.flatnonzero(df < RARE)
        rare = rare[np.argsort(bucket[rare], kind="stable")]
        turn = np.concatenate((own, rare))
        post = np.arange(len(code)) + np.repeat(at[turn] - (np.cumsum(df[turn]) - df[turn]), df[turn])
        gaps, tf, length = gaps[post], tf[post], length[post]
        shared = np.flatnonzero(np.diff(bucket[rare], prepend=-1))  # where a bucket's rare terms begin
        term = np.concatenate((np.arange(len(own)), len(own) + shared))  # first term of each row
        each = np.diff(np.append(term, len(turn)))
        at = np.concatenate(([0], np.cumsum(df[turn])))
        ends = at[np.append(term, len(turn))]
        names = coded.dictionary.take(pa.array(turn))
        single = np.arange(len(term)) < len(own)
        lists = pa.ListArray.from_arrays(pa.array(np.append(term, len(turn)).astype(np.int32)), names)
        joined = pc.binary_join(lists, " ")
        none = pa.nulls(len(term) - len(own), pa.string())
        columns = [pa.array(bucket[turn][term].astype(np.int32)), pa.concat_arrays([names.slice(0, len(own)), none]), pa.array(np.full(len(term), part["block"][0].as_py()))]
        columns += [pa.array(np.diff(ends)), pa.array(np.add.reduceat(tf, ends[:-1])), _packed(gaps, ends, GAP), _packed(tf, ends, COUNT)]
        columns += [pa.array(f.reduceat(x, ends[:-1]).astype(np.int32)) for f, x in ((np.maximum, tf), (np.minimum, length))]
        columns += [pa.concat_arrays([pa.nulls(len(own), pa.string()), joined.slice(len(own))]), _packed(df[turn], np.append(np.where(single, np.arange(len(term)), term), len(turn)), GAP)]
        columns.append(pa.array(np.where(single, _first_bytes(names.take(pa.array(np.minimum(term, len(turn) - 1)))), -1)))
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "term", "block", "df", "cf", "gaps", "tfs", "max_tf", "min_length", "rare", "dfs", "first_bytes"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current, size = [], None, 0
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            starts = np.concatenate(([0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)])).tolist() if len(blocks) else [0]
            for a, b in zip(starts[:-1], starts[1:]):
                if held and (blocks[a] != current or size > INVERTED_AT_A_TIME):
                    yield from invert(held)
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                current, size = blocks[a], size + held[-1].nbytes
        if held:
            yield from invert(held)

    return in_arrow(docs.select("block", "place", "length", "words"), of, f"{_POSTINGS}, first_bytes long")


def _told_apart(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The terms of rows of rare terms: the row of each, the term, and in how many documents it is."""
    terms = split_tokens(rows["rare"].combine_chunks() if isinstance(rows, pa.Table) else rows["rare"])
    return parents(terms), terms.flatten(), _unpacked(rows["dfs"], GAP).flatten().to_numpy().astype(np.int64)


def _counted(postings: DataFrame) -> DataFrame:
    """bucket, term, df, cf: the counts of the terms in each row of the postings; those of rare terms are summed before they go on."""

    def out(held: list[pa.Table]) -> pa.RecordBatch:
        summed = pa.concat_tables(held).group_by(["bucket", "term"]).aggregate([("df", "sum"), ("cf", "sum")])
        return pa.RecordBatch.from_arrays([summed[c].combine_chunks() for c in ("bucket", "term", "df_sum", "cf_sum")], ["bucket", "term", "df", "cf"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            row, term, df = _told_apart(batch)
            tf = _unpacked(batch["tfs"], COUNT).flatten().to_numpy().astype(np.int64)
            held.append(pa.table({"bucket": batch["bucket"].take(pa.array(row)), "term": term, "df": df, "cf": np.add.reduceat(tf, np.cumsum(df) - df) if len(df) else df}))
            size += len(df)
            if size > SUMMED_AT_A_TIME:
                yield out(held)
                held, size = [], 0
        if size:
            yield out(held)

    rare = in_arrow(postings.where(F.col("term").isNull()).select("bucket", "rare", "dfs", "tfs"), of, _TERMS)
    return union(postings.where(F.col("term").isNotNull()).select("bucket", "term", "df", "cf"), rare)


def _lists(batch: pa.RecordBatch, asked: pa.Array) -> pa.RecordBatch:
    """A batch of postings and heads of blocks by term: gaps and counts are lists again, the gaps of a head its places. Rows of rare terms become one for each that is asked for."""
    names = [c for c in batch.schema.names if c not in ("places", "rare", "dfs")]
    shared, known = pc.is_valid(batch["rare"]), pc.is_in(batch["term"], value_set=asked)
    whole = batch.filter(pc.or_(pc.equal(batch["kind"], 0), known))
    places, gaps, n = whole["places"], _unpacked(whole["gaps"], GAP), whole.num_rows
    places = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths_of(places)))).astype(np.int32)), places.flatten())
    lists = {"gaps": pa.concat_arrays([places, gaps]).take(pa.array(np.arange(n) + n * whole["kind"].to_numpy())), "tfs": _unpacked(whole["tfs"], COUNT)}
    out = [pa.table({c: lists.get(c, whole[c]) for c in names})]
    rare = batch.filter(shared)
    if rare.num_rows:
        row, term, df = _told_apart(rare)
        which = np.flatnonzero(pc.is_in(term, value_set=asked).to_numpy(zero_copy_only=False))
        at = pa.array(np.concatenate(([0], np.cumsum(df))).astype(np.int32))
        lists = {c: pa.ListArray.from_arrays(at, _unpacked(rare[c], kind).flatten()).take(pa.array(which)) for c, kind in (("gaps", GAP), ("tfs", COUNT))}
        lists["term"] = term.take(pa.array(which))
        out.append(pa.table({c: lists[c] if c in lists else rare[c].take(pa.array(row[which])) for c in names}))
    both = pa.concat_tables(out).combine_chunks()
    order = np.argsort(both["block"].to_numpy(), kind="stable")
    both = both.take(pa.array(order)).combine_chunks()
    return both.to_batches()[0] if both.num_rows else batch.slice(0, 0).select(names)


class Postings:
    """A stored index: `docs` is its table of documents, `search` gives top lists."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.docs, self.blocks = spark.read.parquet(f"{path}/docs").withColumn("toks", apart(F.col("words"))), spark.read.parquet(f"{path}/blocks")
        self.postings, self.terms = spark.read.schema(_POSTINGS).parquet(f"{path}/postings"), spark.read.schema(_TERMS).parquet(f"{path}/terms")
        self.n, self.mean, self.buckets = spark.read.parquet(f"{path}/size").first()

    @classmethod
    def write(cls, docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", keep: tuple = (), buckets: int = BUCKETS) -> Postings:
        """Index documents. Rows without a key are left out, a null text has no tokens; a repeated key is indexed as often as it comes."""
        spark = docs.sparkSession
        numbered = in_small_batches(docs).where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), _joined(F.col(text)).alias("_j"), *keep, F.monotonically_increasing_id().alias("_n"))
        place = F.col("_n").bitwiseAND(BLOCK_DOCS - 1).cast("int")
        numbered.withColumns({"block": F.shiftright("_n", BLOCK_BITS), "place": place, "words": F.col("_j.words"), "length": F.col("_j.length")}).drop("_n", "_j").write.mode("overwrite").parquet(f"{path}/docs")
        read = spark.read.parquet(f"{path}/docs")
        _listed(read).write.mode("overwrite").parquet(f"{path}/blocks")
        dealt = _inverted(read, buckets).repartition("bucket", F.pmod("block", F.lit(PARTS))).sortWithinPartitions("bucket", "first_bytes").drop("first_bytes")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        _counted(spark.read.schema(_POSTINGS).parquet(f"{path}/postings")).groupBy("bucket", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
        read.agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean")).select("n", "mean", F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/size")
        return cls(spark, path)

    def of_terms(self, df: DataFrame, words: list[str]) -> DataFrame:
        """Rows of `postings` or `terms` for some terms: only their partitions are read, and of these, if the terms are few, only row groups that may have them."""
        inside = df.where(F.col("bucket").isin(sorted({bucket_of(w, self.buckets) for w in words})))
        shared = F.col("term").isNull() if "rare" in df.columns else F.lit(False)  # their terms are told apart by the search
        if len(words) <= PUSHED_TERMS:
            return inside.where(shared | F.col("term").isin(words))
        if "rare" in df.columns:
            return inside  # a worker passes over the terms that nobody asks for
        asked = self.spark.createDataFrame(pa.table({"term": pa.array(words, pa.string())}))
        return inside.join(F.broadcast(asked), "term", "left_semi")

    def statistics(self, words: list[str]) -> Statistics:
        """Of the terms of one block of queries; the driver gets one row a term."""
        found = self.of_terms(self.terms, words).select("term", "df").toArrow()
        df = dict(zip(found["term"].to_pylist(), found["df"].to_pylist()))
        return Statistics(self.n, self.mean, words, np.array([df.get(w, 0) for w in words], np.int64))

    def search(self, terms: DataFrame, k: int = 10, where: Column | None = None, group: str | None = None, value: Column | None = None, patterns: bool = False, known: Callable[[list[str]], Statistics] | None = None) -> DataFrame:
        """qid, doc_id, score, rank of the k best documents of each query (qid, term), with `group` of each query and value; see sparse.search.

        value: what the group is, if it is no column of the documents. patterns: values are JSON arrays, in which a
        query's null stands for any value. known: statistics of terms, if others than this index's own count.
        """
        key, key_type, qid_type = self.docs.schema["doc_id"].dataType.simpleString(), arrow_type(self.docs, "doc_id"), arrow_type(terms, "qid")
        own_group = group is not None and group in terms.columns
        each_value = group is not None and not own_group
        schema = f"qid {terms.schema['qid'].dataType.simpleString()}, doc_id {key}, score double" + (f", {group} string" if each_value else "")
        docs = self.docs if value is None else self.docs.withColumn(group, value)
        listed = self.blocks if where is None and group is None else _listed(docs if where is None else docs.where(where), group)
        listed = listed if "owns" in listed.columns else listed.withColumn("owns", F.lit(None).cast("array<string>"))
        fields = ["block", "kind", "term", "places", "gaps", "tfs", "max_tf", "min_length", "rare", "dfs", "ids", "lengths", "owns"]

        def of_block(block: list) -> DataFrame:
            ids = [r[0] for r in block]
            words = sorted({w for r in block for w in r[1]})
            index = {w: i for i, w in enumerate(words)}
            queries = np.repeat(np.arange(len(ids)), [len(r[1]) for r in block])
            codes = np.array([index[w] for r in block for w in r[1]], np.int64)
            order = np.argsort(codes, kind="stable")
            stats = (known or self.statistics)(words)
            shared = self.spark.sparkContext.broadcast((ids, words, stats.idf, stats.mean or 1.0, queries[order], np.searchsorted(codes[order], np.arange(len(words) + 1)), [r[2] for r in block] if own_group else None))
            asked = self.of_terms(self.postings, words)
            none = {"places": "array<int>", "ids": f"array<{key}>", "lengths": "array<int>", "owns": "array<string>"}
            some = {"term": "string", "gaps": "binary", "tfs": "binary", "max_tf": "int", "min_length": "int", "rare": "string", "dfs": "binary"}
            postings = asked.select(F.lit(1).alias("kind"), "*").withColumns({c: F.lit(None).cast(t) for c, t in none.items()}).select(fields)
            heads = listed.select("block", F.lit(0).alias("kind"), "places", "ids", "lengths", "owns").withColumns({c: F.lit(None).cast(t) for c, t in some.items()}).select(fields)

            def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                ids, words, weight, mean, who, start, mine = shared.value
                asked_for = pa.array(words, pa.string())
                batches = (_lists(batch, asked_for) for batch in batches)
                scorer = _Scorer(len(ids), k, pa.array(words, pa.string()), weight, mean, who, start, each_value, mine, patterns)
                held: list[pa.RecordBatch] = []
                current = None
                for batch in batches:
                    blocks = batch.column(0).to_numpy()
                    starts = np.concatenate(([0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)])).tolist() if len(blocks) else [0]
                    for a, b in zip(starts[:-1], starts[1:]):
                        if blocks[a] != current:
                            scorer.add(held)
                            held, current = [], blocks[a]
                        held.append(batch.slice(a, b - a))
                scorer.add(held)
                for value, best in scorer.best.items():
                    if best.key is not None:
                        columns = [pa.array([ids[q] for q in best.query], qid_type), pa.array(best.key, key_type), pa.array(best.score), *([pa.array([value] * len(best.query), pa.string())] if each_value else [])]
                        yield pa.RecordBatch.from_arrays(columns, ["qid", "doc_id", "score", *([group] if each_value else [])])

            self.spark.conf.set("spark.sql.unionOutputPartitioning", "false")
            return in_arrow(heads.unionAll(postings).repartition("block").sortWithinPartitions("block", "kind"), of, schema)

        found = in_blocks(asked_terms(terms, group if own_group else None), QUERIES_AT_A_TIME, of_block)
        return top(found if found is not None else self.spark.createDataFrame([], schema), k, by=("qid", group) if each_value else ("qid",))


class Overlay:
    """Several stored indexes searched as one: a few documents beside a corpus, say, without writing the corpus again. Scores are those that one index of all documents would give; ids are unique over all."""

    def __init__(self, *parts: Postings):
        self.spark, self.parts = parts[0].spark, parts

    @property
    def docs(self) -> DataFrame:
        names = [c for c in self.parts[0].docs.columns if all(c in p.docs.columns for p in self.parts)]
        return union(*(p.docs.select(names) for p in self.parts))

    def statistics(self, words: list[str]) -> Statistics:
        """Sums over the parts."""
        each = [p.statistics(words) for p in self.parts]
        n = sum(s.n for s in each)
        return Statistics(n, sum(s.n * s.mean for s in each) / n if n else 0.0, words, sum(s.df for s in each))

    def search(self, terms: DataFrame, k: int = 10, where: Column | None = None, group: str | None = None, value: Column | None = None, patterns: bool = False) -> DataFrame:
        found = union(*(p.search(terms, k, where, group, value, patterns, self.statistics).drop("rank") for p in self.parts))
        return top(found, k, by=("qid", group) if group in found.columns else ("qid",))


def _listed(docs: DataFrame, group: str | None = None) -> DataFrame:
    """block, places, ids, lengths (and the group's values) of documents by block; a list has BLOCK_DOCS entries at most."""
    own = [F.col(group).cast("string").alias("own")] if group else []
    lists = docs.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "doc_id", "length", *own))).alias("d"))
    return lists.select("block", F.col("d.place").alias("places"), F.col("d.doc_id").alias("ids"), F.col("d.length").alias("lengths"), *([F.col("d.own").alias("owns")] if group else []))


class _Scorer:
    """The best rows of each query (and group) over blocks that are added one by one."""

    def __init__(self, n: int, k: int, words: pa.Array, weight: np.ndarray, mean: float, who: np.ndarray, start: np.ndarray, grouped: bool, mine: list | None = None, patterns: bool = False):
        self.patterns = patterns
        self.n, self.k, self.words, self.weight, self.mean, self.who, self.start, self.grouped, self.mine = n, k, words, weight, mean, who, start, grouped, mine
        self.degree = np.diff(start)
        codes = np.repeat(np.arange(len(self.degree)), self.degree)
        order = np.argsort(who, kind="stable")
        self.terms, self.first = codes[order], np.searchsorted(np.asarray(who)[order], np.arange(n + 1))  # of each query
        self.kinds: dict[str | None, list[int]] = {}
        for q, value in enumerate(mine or []):
            self.kinds.setdefault(value, []).append(q)
        self.best: dict[str | None, Best] = {}
        self.passed = 0  # queries that a block's maxima ruled out

    def _part(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.weight[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))

    def _asked(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of some terms each query that asks for it: the term's place among them, and the query."""
        times = self.degree[term]
        each = np.repeat(np.arange(len(term)), times)
        return each, self.who[np.arange(len(each)) - np.repeat(np.cumsum(times) - times - self.start[term], times)]

    def add(self, held: list[pa.RecordBatch]) -> None:
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        kind = rows["kind"].to_numpy()
        head, post = rows.filter(pa.array(kind == 0)), rows.filter(pa.array(kind == 1))
        if not head.num_rows or not post.num_rows:
            return
        flat = lambda t, c: t[c].combine_chunks().flatten()
        keys, length = flat(head, "ids").to_numpy(zero_copy_only=False), flat(head, "lengths").to_numpy()
        slot = np.full(BLOCK_DOCS, -1)
        slot[flat(head, "gaps").to_numpy()] = np.arange(len(keys))
        owns = flat(head, "owns").to_pylist() if self.grouped or self.mine else None
        term = pc.index_in(post["term"].combine_chunks(), value_set=self.words).to_numpy()
        bound = self._part(term, post["max_tf"].to_numpy(), post["min_length"].to_numpy())
        each, query = self._asked(term)
        most = np.bincount(query, bound[each], self.n)
        live = most > 0
        if not self.grouped and None in self.best:
            live &= most + 1e-6 >= self.best[None].least
            self.passed += int((~live).sum())
        if not live.any():
            return
        sizes = lengths_of(post["gaps"].combine_chunks())
        steps, tf = np.cumsum(flat(post, "gaps").to_numpy().astype(np.int64)), flat(post, "tfs").to_numpy()
        first = np.cumsum(sizes) - sizes
        place = steps - np.repeat(np.concatenate(([0], steps))[first], sizes)
        row, of_term = slot[place], np.repeat(term, sizes)
        there = row >= 0
        row, of_term, tf = row[there], of_term[there], tf[there]
        block = _Block(row, of_term, self._part(of_term, tf, length[row]), len(keys), len(self.words))
        for value, queries, columns in self._wanted(owns, len(keys)):
            queries = queries[live[queries]]
            best = self.best.setdefault(value, Best(self.n, self.k))
            at_a_time = max(1, SCORES_AT_A_TIME // max(len(columns), 1))
            for at in range(0, len(queries), at_a_time):
                some = queries[at : at + at_a_time]
                scores = block.scores([self.terms[self.first[q] : self.first[q + 1]] for q in some], columns)
                best.add(scores, keys[columns], some, 6)

    def _wanted(self, owns: list | None, rows: int) -> Iterator[tuple[str | None, np.ndarray, np.ndarray]]:
        """Queries, and the rows that they look among, by the value under which their best rows are kept."""
        everyone = np.arange(self.n)
        if owns is None:
            yield None, everyone, np.arange(rows)
            return
        values = list(dict.fromkeys(owns))
        number = {x: i for i, x in enumerate(values)}
        code = np.array([number[x] for x in owns])
        if self.grouped:
            yield from ((x, everyone, np.flatnonzero(code == i)) for x, i in number.items())
            return
        kinds = list(self.kinds)
        for x, outside in zip(kinds, elsewhere(kinds, values, self.patterns)):
            columns = np.flatnonzero(~outside[code])
            if len(columns):
                yield None, np.array(self.kinds[x]), columns


class _Block:
    """The contributions of one block's postings: frequent terms laid out over its documents, the others as lists by term."""

    def __init__(self, row: np.ndarray, term: np.ndarray, part: np.ndarray, rows: int, terms: int):
        order = np.argsort(term, kind="stable")
        self.row, self.part, self.size = row[order], part[order], np.bincount(term, minlength=terms)
        self.start, self.rows = np.cumsum(self.size) - self.size, rows
        frequent = np.flatnonzero(self.size * DENSE_PART >= max(rows, 1))
        frequent = frequent[np.argsort(-self.size[frequent], kind="stable")][: DENSE_CELLS // max(rows, 1)]
        self.place = np.full(terms, -1)
        self.place[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), rows))
        for i, t in enumerate(frequent.tolist()):
            here = slice(self.start[t], self.start[t] + self.size[t])
            self.dense[i, self.row[here]] = self.part[here]
        self.seen: tuple | None = None

    def scores(self, asked: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
        """[query, column] for the terms of some queries."""
        if self.seen is None or self.seen[0] is not columns:
            self.seen = columns, *self._inside(columns)
        _, dense, row, part, size, start = self.seen
        out = np.zeros((len(asked), len(columns)))
        for i, terms in enumerate(asked):
            places = self.place[terms]
            places = places[places >= 0]
            if len(places):
                np.add.reduce(dense[places], axis=0, out=out[i])
        query, term = np.repeat(np.arange(len(asked)), [len(x) for x in asked]), np.concatenate(asked)
        listed = (self.place[term] < 0) & (size[term] > 0)
        query, term = query[listed], term[listed]
        ends = np.cumsum(size[term])
        at = 0
        while at < len(term):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ADDED_AT_A_TIME, "right")))
            each = size[term[at:stop]]
            post = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each - start[term[at:stop]], each)
            out += np.bincount(np.repeat(query[at:stop] * len(columns), each) + row[post], part[post], out.size).reshape(out.shape)
            at = stop
        return out

    def _inside(self, columns: np.ndarray) -> tuple:
        """What the block has of some columns: the dense table, and the lists with the number of each list's entries and where it begins."""
        if len(columns) == self.rows:
            return self.dense, self.row, self.part, self.size, self.start
        where = np.full(self.rows, -1)
        where[columns] = np.arange(len(columns))
        column = where[self.row]
        kept = column >= 0
        size = np.bincount(np.repeat(np.arange(len(self.size)), self.size)[kept], minlength=len(self.size))
        return self.dense[:, columns], column[kept], self.part[kept], size, np.cumsum(size) - size
