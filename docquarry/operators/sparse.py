"""BM25 over a batch of queries: an index of tokens, scores, top lists, explanations.

An index is a table of documents with their tokens, written once (write_index) and read by every search; a plain
table of documents serves too, its tokens are then made on the way. A search reads it twice: for the statistics
of the query terms, and to score Arrow batches against all queries of a block. Each task sends on its k best rows
of each query, so no posting is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.functions.text import tokens
from docquarry.operators.blocks import Best, arrow_type, bounded, in_arrow, in_blocks

K1, B = 1.5, 0.75
#: Queries that are sent to every worker at a time; more are searched block by block.
QUERIES_AT_A_TIME = 1024
#: Scores (queries times rows) that a worker holds at a time.
SCORES_AT_A_TIME = 1 << 22
#: Different terms that a worker counts before it hands its counts on.
COUNTED = 1 << 20


def write_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", keep: tuple = ()) -> DataFrame:
    """doc_id, toks and the columns to keep, written to `path` as Parquet (tokens are stored by dictionary) and read again."""
    docs.select(F.col(key).alias("doc_id"), tokens(F.col(text)).alias("toks"), *keep).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _tokens(docs: DataFrame, text: str) -> Column:
    return F.col("toks") if "toks" in docs.columns else tokens(F.col(text))


def documents_of(index) -> DataFrame:
    """The table of documents of an index, be it one itself or stored postings."""
    return index if isinstance(index, DataFrame) else index.docs


def lengths_of(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def parents(lists: pa.Array) -> np.ndarray:
    """The row of each item of flattened lists."""
    return np.repeat(np.arange(len(lists)), lengths_of(lists))


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, df, cf: documents that have each term, and its occurrences; counted in each task before the shuffle."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            df, cf = zip(*seen.values()) if seen else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(df, pa.int64()), pa.array(cf, pa.int64())], ["term", "df", "cf"])

        for batch in bounded(batches):
            toks = batch.column(0)
            coded, row = toks.flatten().dictionary_encode(), parents(toks)
            code, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
            df = np.bincount(np.unique(row * np.int64(max(len(words), 1)) + code) % max(len(words), 1), minlength=len(words))
            for w, d, c in zip(words, df.tolist(), np.bincount(code, minlength=len(words)).tolist()):
                at = seen.setdefault(w, [0, 0])
                at[0] += d
                at[1] += c
            if len(seen) > COUNTED:
                yield out()
                seen.clear()
        yield out()

    return in_arrow(docs.select(_tokens(docs, text).alias("toks")), of, "term string, df long, cf long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


@dataclass
class Statistics:
    """Of a whole corpus: its size, its mean length, and how many documents have each of some terms."""

    n: int
    mean: float
    terms: list[str]
    df: np.ndarray

    @property
    def idf(self) -> np.ndarray:
        return np.log(1 + (self.n - self.df + 0.5) / (self.df + 0.5))


def _entries(toks: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, term, tf of the terms in each row's tokens."""
    code = pc.index_in(toks.flatten(), value_set=terms)
    known = np.asarray(pc.is_valid(code))
    row = parents(toks)[known]
    cell, tf = np.unique(row * len(terms) + code.filter(code.is_valid()).to_numpy(zero_copy_only=False), return_counts=True)
    return cell // max(len(terms), 1), cell % max(len(terms), 1), tf


def statistics(docs: DataFrame, terms: list[str], text: str = "text") -> Statistics:
    """One pass over the corpus; the driver gets one row a term."""
    spark, n = docs.sparkSession, len(terms)
    shared = spark.sparkContext.broadcast(terms)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_set, df, rows, total = pa.array(shared.value, pa.string()), np.zeros(n, np.int64), 0, 0
        for batch in batches:
            toks = batch.column(0)
            rows, total = rows + batch.num_rows, total + len(toks.flatten())
            df += np.bincount(_entries(toks, value_set)[1], minlength=n)
        there = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((there, [n, n + 1])).astype(np.int64)), pa.array(np.concatenate((df[there], [rows, total])).astype(np.int64))], ["code", "n"])

    found = in_arrow(docs.select(_tokens(docs, text).alias("toks")), of, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(n + 2, np.int64)
    counts[found["code"].to_numpy()] = found["n"].to_numpy()
    return Statistics(int(counts[n]), counts[n + 1] / counts[n] if counts[n] else 0.0, terms, counts[:n])


def query_terms(queries: DataFrame, key: str = "qid", text: str = "question") -> DataFrame:
    """qid, term: distinct terms of each query."""
    return queries.select(F.col(key).alias("qid"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))


def top(scored: DataFrame, k: int, score: str = "score", by: tuple = ("qid",), key: str = "doc_id") -> DataFrame:
    """The k best of each query with their ranks: scores to six places, then smaller ids first."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(docs: DataFrame, terms: DataFrame, k: int = 10, where: Column | None = None, key: str = "doc_id", text: str = "text", group: str | None = None) -> DataFrame:
    """qid, doc_id, score, rank of the k best documents of each query; with `group` (a string column) of each query and value.

    docs: documents, an index of tokens, or stored postings. terms: qid, term, and maybe `group`: a query then looks only
    among rows with its own value (null: none), and the group is not in the result. A filter comes after the statistics, which stay those of the
    corpus. Queries beyond QUERIES_AT_A_TIME are searched block by block.
    """
    if not isinstance(docs, DataFrame):
        return docs.search(terms, k, where, group)
    spark, own_group = docs.sparkSession, group is not None and group in terms.columns
    kinds = {"qid": terms.schema["qid"].dataType.simpleString(), key: docs.schema[key].dataType.simpleString()}
    each_value = group is not None and not own_group
    schema = f"qid {kinds['qid']}, doc_id {kinds[key]}, score double" + (f", {group} string" if each_value else "")
    qid_type, key_type = arrow_type(terms, "qid"), arrow_type(docs, key)
    source = docs.select(F.col(key), _tokens(docs, text).alias("toks"), (F.lit(True) if where is None else F.coalesce(where, F.lit(False))).alias("ok"), (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("own"))

    def of_block(block: list) -> DataFrame:
        ids = [r[0] for r in block]
        words = sorted({w for r in block for w in r[1]})
        index = {w: i for i, w in enumerate(words)}
        queries = np.repeat(np.arange(len(ids)), [len(r[1]) for r in block])
        codes = np.array([index[w] for r in block for w in r[1]], np.int64)
        order = np.argsort(codes, kind="stable")
        stats = statistics(docs, words, text)
        shared = spark.sparkContext.broadcast((ids, words, stats.idf, stats.mean or 1.0, queries[order], np.searchsorted(codes[order], np.arange(len(words) + 1)), [r[2] for r in block] if own_group else None))

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, words, weight, mean, asked, start, mine = shared.value
            value_set, n, best = pa.array(words, pa.string()), len(ids), {}
            degree, at_a_time = np.diff(start), max(1, SCORES_AT_A_TIME // len(ids))
            for whole in batches:
                for at in range(0, whole.num_rows, at_a_time):
                    batch = whole.slice(at, at_a_time)
                    toks, rows = batch.column(1), batch.num_rows
                    row, term, tf = _entries(toks, value_set)
                    length = lengths_of(toks)
                    part = weight[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / mean))
                    times = degree[term]
                    each = np.repeat(np.arange(len(term)), times)
                    query = asked[np.arange(len(each)) - np.repeat(np.cumsum(times) - times - start[term], times)]
                    scores = np.round(np.bincount(query * rows + row[each], part[each], n * rows).astype(float), 6).reshape(n, rows)
                    scores[scores <= 0] = -np.inf
                    scores[:, ~batch.column(2).to_numpy(zero_copy_only=False)] = -np.inf
                    keys, own = batch.column(0).to_numpy(zero_copy_only=False), batch.column(3).to_pylist() if group else [None] * rows
                    if own_group:
                        scores[elsewhere(mine, own)] = -np.inf
                    for value in dict.fromkeys(own) if each_value else [None]:
                        here = np.array([x == value for x in own]) if each_value else slice(None)
                        best.setdefault(value, Best(n, k)).add(scores[:, here], keys[here])
            for value, b in best.items():
                if b.key is not None:
                    columns = [pa.array([ids[q] for q in b.query], qid_type), pa.array(b.key, key_type), pa.array(b.score), *([pa.array([value] * len(b.query), pa.string())] if each_value else [])]
                    yield pa.RecordBatch.from_arrays(columns, ["qid", "doc_id", "score", *([group] if each_value else [])])

        return in_arrow(source, of, schema)

    found = in_blocks(asked_terms(terms, group if own_group else None), QUERIES_AT_A_TIME, of_block)
    return top(found if found is not None else spark.createDataFrame([], schema), k, by=("qid", group) if each_value else ("qid",))


def asked_terms(terms: DataFrame, group: str | None) -> Iterator:
    """Each query with its terms and its own value of the group, by id."""
    lists = [F.collect_set("term"), *([F.first(F.col(group).cast("string"))] if group else [])]
    return terms.where("term IS NOT NULL AND qid IS NOT NULL").groupBy("qid").agg(*lists).orderBy("qid").toLocalIterator()


def elsewhere(mine: list, theirs: list, patterns: bool = False) -> np.ndarray:
    """[query, row]: whether a row has another value than the query. As patterns, values are JSON arrays, and a query's null stands for any value in its place."""
    if patterns:
        asked, there = list(dict.fromkeys(mine)), list(dict.fromkeys(theirs))
        values = [json.loads(x) for x in there]
        fits = np.array([[all(a is None or a == b for a, b in zip(json.loads(x), v)) for v in values] for x in asked]).reshape(len(asked), len(there))
        return ~fits[np.ix_([asked.index(x) for x in mine], [there.index(x) for x in theirs])]
    number = {x: n for n, x in enumerate(dict.fromkeys(x for x in mine if x is not None))}
    return np.array([number.get(x, -2) for x in mine])[:, None] != np.array([number.get(x, -1) for x in theirs])[None, :]


def contributions(docs: DataFrame, terms: DataFrame, hits: DataFrame, text: str = "text") -> DataFrame:
    """qid, doc_id, term, tf, df, idf, part: what each query term adds to the score of each hit (qid, doc_id). Stored postings have the statistics, so only the hits' tokens are read."""
    if isinstance(docs, DataFrame):
        n, counted = docs.agg(F.count("*").alias("n"), F.avg(F.size(_tokens(docs, text))).alias("mean")), term_counts(docs, text)
    else:
        n, counted, docs = docs.spark.createDataFrame([(docs.n, docs.mean)], "n long, mean double"), docs.terms, docs.docs
    wanted = docs.select("doc_id", _tokens(docs, text).alias("toks")).join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    tf = wanted.select("doc_id", F.size("toks").alias("dl"), F.explode("toks").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    df = counted.join(terms.select("term").distinct(), "term", "left_semi").select("term", "df")
    each = hits.select("qid", "doc_id").join(terms, "qid").join(tf, ["doc_id", "term"]).join(df, "term").crossJoin(F.broadcast(n))
    each = each.withColumn("idf", idf(F.col("n"), F.col("df")))
    norm = K1 * (1 - B + B * F.col("dl") / F.col("mean"))
    return each.select("qid", "doc_id", "term", "tf", "df", "idf", (F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("part"))
