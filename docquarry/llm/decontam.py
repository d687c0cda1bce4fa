"""Benchmark decontamination by BM25 with block-max WAND over an index of the test items.

The index is of the test items, which are few; each passage of each document is a query. A posting holds its
BM25 score as a share of what its item scores against itself, so one threshold serves all items. Postings are
grouped in blocks of neighbouring items with the largest score of each block. A passage is looked up only if
the sums of its terms' block maxima reach the threshold in some block, first over coarse and then over fine blocks; then block-max WAND walks the postings
and returns every item above the threshold, and the item's question and answer are aligned with the words there, in
every window in which enough of them lie, so that a part of an item beside an edited copy does not hide the copy.

Items are indexed by classes of length, each with passages of its own size, so one long item does not make all passages long.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, fsum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import as_text, checkpointed, mapped, slices, table, text_column, words

K1, B = 1.5, 0.75
#: Share of an item's score against itself that a passage must reach.
THRESHOLD = 0.6
#: Share of the words of the question, and of the answer, that must be found in order.
OVERLAP = 0.8
#: Words of test items in one index, about; more items are split over several indexes, each searched by all passages.
INDEX_WORDS = 300_000
#: Indexes that one pass over the documents searches; what a worker holds is bounded by so many.
INDEXES_AT_A_TIME = 4
BLOCK_ITEMS = 4
#: Coarse blocks that the first bound tells apart, at most (of neighbouring blocks taken together).
BOUND_BLOCKS = 64

_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The last sentence is the answer; an item of one sentence is all question."""
    parts = [w for w in map(words, _SENTENCE.split(text)) if w]
    if len(parts) < 2:
        return (parts or [[]])[0], []
    return [w for p in parts[:-1] for w in p], parts[-1]


def longest_common(a: list, b: list) -> int:
    """Length of the longest common subsequence, by one big-integer step for each word of b."""
    where: dict = defaultdict(int)
    for i, w in enumerate(a):
        where[w] |= 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & where.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@dataclass
class Statistics:
    """Of all test items, however many indexes they are split over: how many have a word, their mean length and the greatest in each class, how many have each term (those asked for at least)."""

    n: int
    mean: float
    longest: dict[int, int]
    df: dict[bytes, int]


@dataclass
class Index:
    """Items in order of length, so that neighbours score alike. Term 0 is any word that no item has."""

    items: list
    question: list[list[bytes]]
    answer: list[list[bytes]]
    terms: dict[bytes, int]
    first: np.ndarray  # where a term's postings begin
    item: np.ndarray
    score: np.ndarray
    most: np.ndarray  # the largest score of each term
    block_first: np.ndarray  # where a term's blocks begin
    block: np.ndarray
    block_most: np.ndarray  # the largest score in each block
    bound: np.ndarray  # of each term, the largest score in each group of blocks
    longest: int

    def best_block(self, terms: np.ndarray) -> float:
        """The largest sum of block maxima that any block of items gets from the terms."""
        rows = [slice(a, b) for a, b in zip(self.block_first[terms].tolist(), self.block_first[terms + 1].tolist())]
        if not rows:
            return 0.0
        return float(np.bincount(np.concatenate([self.block[r] for r in rows]), np.concatenate([self.block_most[r] for r in rows])).max(initial=0.0))

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: every item whose postings of the distinct terms sum to the threshold or more."""
        end = len(self.items)
        lists = []
        for t in terms:
            a, b = self.first[t], self.first[t + 1]
            if b > a:
                rows = slice(self.block_first[t], self.block_first[t + 1])
                lasts = (self.block[rows] + 1) * BLOCK_ITEMS - 1
                lists.append([int(self.item[a]), 0, self.item[a:b].tolist(), self.score[a:b].tolist(), float(self.most[t]), lasts.tolist(), self.block_most[rows].tolist(), 0])
        found = []

        def seek(cursor: list, item: int) -> None:
            at, items = cursor[1], cursor[2]
            while at < len(items) and items[at] < item:
                at += 1
            cursor[1], cursor[0] = at, items[at] if at < len(items) else end

        def block_at(cursor: list, item: int) -> int:
            at, lasts = cursor[7], cursor[5]
            while at < len(lasts) and lasts[at] < item:
                at += 1
            cursor[7] = at
            return at

        slack = threshold - 1e-9
        while True:
            lists.sort(key=lambda c: c[0])
            total, pivot = 0.0, -1
            for i, c in enumerate(lists):
                if c[0] >= end:
                    break
                total += c[4]
                if total >= slack:
                    pivot = i
                    break
            if pivot < 0:
                return found
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            ahead, top = end, 0.0
            for c in lists[: pivot + 1]:
                k = block_at(c, item)
                if k < len(c[5]):
                    top += c[6][k]
                    ahead = min(ahead, c[5][k] + 1)
            if top < slack:  # nothing in these blocks can reach the threshold: go on behind the first that ends
                if pivot + 1 < len(lists):
                    ahead = min(ahead, lists[pivot + 1][0])
                for c in lists[: pivot + 1]:
                    seek(c, max(ahead, item + 1))
            elif lists[0][0] == item:
                score = fsum(c[3][c[1]] for c in lists[: pivot + 1])
                if score >= slack:
                    found.append((item, score))
                for c in lists[: pivot + 1]:
                    seek(c, item + 1)
            else:
                for c in lists[:pivot]:
                    seek(c, item)


def _parted(texts: list) -> tuple[list[bytes], list[bytes]]:
    """Question and answer of an item given as one text, or as both."""
    return question_and_answer(texts[0] or "") if len(texts) == 1 else (words(texts[0] or ""), words(texts[1] or ""))


def class_of(length: int) -> int:
    """Items of up to 64 words, of up to 256, and so on."""
    return max(0, -(-((length - 1) >> 6).bit_length() // 2))


def room_of(length: int) -> int:
    """Words by which a copy may be longer than its item."""
    return 4 + length // 4


def build_index(rows: list[tuple], known: Statistics | None = None) -> Index | None:
    """rows: (item id, text), or (item id, question, answer); known: of all items, where these are a part. None where no item has a word."""
    parted = []
    for item, *texts in rows:
        q, a = _parted(texts)
        if q or a:
            parted.append((len(q) + len(a), item, q, a))
    if not parted:
        return None
    parted.sort(key=lambda x: (x[0], x[1] is None, x[1], x[2], x[3]))
    counts = [Counter(q + a) for _, _, q, a in parted]
    known = known or Statistics(len(parted), sum(x[0] for x in parted) / len(parted), {class_of(x[0]): x[0] for x in parted}, Counter(t for c in counts for t in c))
    n, mean, df = known.n, known.mean, known.df
    terms = {t: k for k, t in enumerate(sorted({t for c in counts for t in c}), 1)}
    postings: list[list[tuple[int, float]]] = [[] for _ in range(len(terms) + 1)]
    for i, (length, c) in enumerate(zip((x[0] for x in parted), counts)):
        norm = K1 * (1 - B + B * length / mean)
        raw = {t: np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + norm) for t, tf in c.items()}
        total = fsum(raw.values())
        for t, s in raw.items():
            postings[terms[t]].append((i, s / total))
    first = np.concatenate(([0], np.cumsum([len(p) for p in postings])))
    item = np.array([i for p in postings for i, _ in p], np.int64)
    score = np.array([s for p in postings for _, s in p])
    term = np.repeat(np.arange(len(postings)), np.diff(first))
    blocks = -(-len(parted) // BLOCK_ITEMS)
    cell, inverse = np.unique(term * blocks + item // BLOCK_ITEMS, return_inverse=True)
    block_most = np.zeros(len(cell))
    np.maximum.at(block_most, inverse, score)
    block_first = np.searchsorted(cell // blocks, np.arange(len(postings) + 1))
    groups = min(BOUND_BLOCKS, blocks)
    per = -(-blocks // groups) * BLOCK_ITEMS
    bound = np.zeros((len(postings), groups), np.float32)
    np.maximum.at(bound, (term, item // per), score.astype(np.float32) * np.float32(1.000001))
    return Index([x[1] for x in parted], [x[2] for x in parted], [x[3] for x in parted], terms, first, item, score, bound.max(1).astype(float), block_first, cell % blocks, block_most, bound, known.longest[class_of(parted[-1][0])])


def _halves_over(index: Index, ids: np.ndarray, half: int, threshold: float) -> np.ndarray:
    """Passages (each of two neighbouring half passages) in which some block's bound reaches the threshold."""
    known = np.nonzero(ids)[0]
    halves = -(-len(ids) // half)
    sums = np.zeros((halves + 1, index.bound.shape[1]), np.float32)
    if len(known):
        kinds = len(index.most)
        once = np.unique(known // half * kinds + ids[known])  # each term counts once in a half
        of, term = np.divmod(once, kinds)
        starts = np.concatenate(([0], np.nonzero(of[1:] != of[:-1])[0] + 1))
        sums[of[starts]] = np.add.reduceat(index.bound[term], starts)
    return np.nonzero(((sums[:-1] + sums[1:]) >= threshold * (1 - 1e-4)).any(1))[0]


def find(index: Index, text: str, threshold: float, overlap: float) -> dict[int, tuple[float, float, float]]:
    """Position of each leaked item -> score, overlap of question and answer, the best of all passages."""
    tokens = words(text)
    get = index.terms.get
    ids = np.array([get(w, 0) for w in tokens], np.int64)
    half = max(32, index.longest + index.longest // 8)
    best: dict[int, tuple[float, float, float]] = {}
    for h in _halves_over(index, ids, half, threshold):
        at, to = int(h) * half, min(len(ids), (int(h) + 2) * half)
        passage = ids[at:to]
        distinct = np.unique(passage[passage > 0])
        if index.best_block(distinct) < threshold - 1e-9:
            continue
        for item, score in index.search(distinct.tolist(), threshold):
            q, a = ([get(w, 0) for w in x] for x in (index.question[item], index.answer[item]))
            for q_part, a_part in _alignments(ids, at, to, q, a, overlap):
                best[item] = max(best.get(item, (0.0, 0.0, 0.0)), (score, q_part, a_part))
    return best


def _alignments(ids: np.ndarray, start: int, stop: int, q: list[int], a: list[int], overlap: float) -> Iterator[tuple[float, float]]:
    """Overlaps of question and answer in each window of a text where both suffice.

    Windows begin at all multiples of the room of the item and are two rooms longer than it, so every run of words
    that is longer than the item by its room at most lies in one. Those that meet start to stop are tried.
    """
    length = len(q) + len(a)
    room = room_of(length)
    size = length + 2 * room
    first = max(0, (start - size) // room + 1) * room
    begins = np.arange(first, stop, room)
    there = np.concatenate(([0], np.cumsum(np.isin(ids[first : stop + size], q + a))))
    ends = np.minimum(begins - first + size, len(there) - 1)
    least = max(ceil(overlap * len(x) - 1e-9) for x in (q, a))
    for at in begins[there[ends] - there[np.minimum(begins - first, len(there) - 1)] >= least].tolist():
        near = ids[at : at + size].tolist()
        q_part = longest_common(q, near) / len(q) if q else 1.0
        if q_part >= overlap:
            a_part = longest_common(a, near) / len(a) if a else 1.0
            if a_part >= overlap:
                yield q_part, a_part


def _statistics(items: DataFrame, texts: list[str]) -> tuple[Statistics, DataFrame]:
    """Totals over all items, and the table of terms (term, df), counted by the cluster."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            terms, longest, total, n = Counter(), Counter(), 0, 0
            for row in zip(*(batch.column(c).to_pylist() for c in texts)):
                q, a = _parted(list(row))
                if q or a:
                    terms.update(set(q + a))
                    size = len(q) + len(a)
                    n, total = n + 1, total + size
                    longest[class_of(size)] = max(longest[class_of(size)], size)
            rows = [(t, None, d, 0, 0) for t, d in terms.items()] + [(None, c, 0, 0, x) for c, x in longest.items()] + [(None, None, n, total, 0)]
            kinds = (pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["term", "class", "df", "total", "longest"])

    counted = checkpointed(items.select(*texts).mapInArrow(of, "term binary, class int, df long, total long, longest long").groupBy("term", "class").agg(F.sum("df").alias("df"), F.sum("total").alias("total"), F.max("longest").alias("longest")))
    whole = {r["class"]: r for r in counted.where("term IS NULL").collect()}  # one row a class, and one for all
    n = whole[None]["df"] if whole else 0
    return Statistics(n, whole[None]["total"] / n if n else 0.0, {c: r["longest"] for c, r in whole.items() if c is not None}, {}), counted.where("term IS NOT NULL").select("term", "df")


def _indexes(benchmark: DataFrame, index_words: int) -> Iterator[Index]:
    """One index, or several of about `index_words` words each where the test set is larger; one at a time is held.

    The statistics are those of all items, so that an item scores alike whatever index it is in.
    """
    texts = ["question", "answer"] if {"question", "answer"} <= set(benchmark.columns) else ["text"]
    items = benchmark.select(F.col("item_id"), *(F.col(c).cast("string").alias(c) for c in texts))
    size = items.agg(F.sum(sum((F.coalesce(F.length(c), F.lit(0)) for c in texts), F.lit(0))).alias("n")).first()["n"] or 0
    parts = max(1, -(-int(size) // (6 * index_words)))
    if parts == 1:
        yield from _by_class([tuple(r) for r in items.collect()], None)
        return
    known, df = _statistics(items, texts)
    for k in range(parts):
        rows = [tuple(r) for r in items.where(F.pmod(F.xxhash64(*items.columns), F.lit(parts)) == k).collect()]
        own = {t for _, *x in rows for side in _parted(x) for t in side}
        wanted = F.broadcast(benchmark.sparkSession.createDataFrame([(bytearray(t),) for t in own], "term binary"))
        yield from _by_class(rows, Statistics(known.n, known.mean, known.longest, {bytes(r["term"]): r["df"] for r in df.join(wanted, "term").collect()}))


def _by_class(rows: list[tuple], known: Statistics | None) -> Iterator[Index]:
    """An index for each class of length among some items."""
    sizes = [sum(map(len, _parted(list(x)))) for _, *x in rows]
    if known is None:
        counts = [Counter({t for side in _parted(list(x)) for t in side}) for _, *x in rows]
        some = [n for n in sizes if n]
        longest: dict[int, int] = {}
        for n in some:
            longest[class_of(n)] = max(longest.get(class_of(n), 0), n)
        known = Statistics(len(some), sum(some) / max(len(some), 1), longest, sum(counts, Counter()))
    for c in sorted(known.longest):
        found = build_index([r for r, n in zip(rows, sizes) if n and class_of(n) == c], known)
        if found:
            yield found


def _shared(benchmark: DataFrame, index_words: int) -> Iterator[list]:
    """Broadcast indexes, a few at a time; the driver keeps none of them."""
    few = []
    for index in _indexes(benchmark, index_words):
        few.append(benchmark.sparkSession.sparkContext.broadcast(index))
        del index
        if len(few) == INDEXES_AT_A_TIME:
            yield few
            few = []
    if few:
        yield few


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, index_words: int = INDEX_WORDS) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: one row for each document and test item found in it.

    benchmark has item_id and text, or question and answer. Passages are twice as long as the longest item (and an eighth more)
    of their class of length and half overlap, so each run of so many words lies in one whole. Null texts and items without words
    match nothing; a null id of either side is returned as null; repeated documents are searched each; repeated
    items are reported each. A score equal to the threshold counts. Texts of any length are searched whole, and
    other columns do not matter, whatever their names. Empty tables give no rows. A broadcast holds the test items
    of one index, about `index_words` words (or one item); larger test sets are split over several indexes with
    the statistics of all items, a few of which are searched in each pass over the documents.
    """
    kind = benchmark.schema["item_id"].dataType.simpleString()
    schema, out = f"doc_id long, item_id {kind}, score double, question_overlap double, answer_overlap double", None
    source = docs.select(F.col(key).cast("long").alias("doc_id"), text_column(text))
    for few in _shared(benchmark, index_words):

        def of(batches: Iterator[pa.RecordBatch], few=few) -> Iterator[pa.RecordBatch]:
            item_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string() if kind == "string" else None
            for batch in slices(batches):
                rows = [(r, x.value.items[i], *hit) for r, t in enumerate(as_text(batch.column(1))) for x in few for i, hit in sorted(find(x.value, t, threshold, overlap).items())]
                where, items, *numbers = zip(*rows) if rows else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(where, pa.int64())), pa.array(items, item_type), *(pa.array(x, pa.float64()) for x in numbers)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
                )

        found = source.mapInArrow(of, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, index_words: int = INDEX_WORDS) -> DataFrame:
    """The documents in which no test item is found, with all their columns; filtered where they lie, without a shuffle. As in leaks, null and empty texts hold nothing and stay, and so do repeated rows."""
    where = docs.columns.index(text)
    for few in _shared(benchmark, index_words):

        def of(batches: Iterator[pa.RecordBatch], few=few) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                texts = as_text(batch.column(where).cast(pa.string()))
                yield batch.filter(pa.array([not any(find(x.value, t, threshold, overlap) for x in few) for t in texts], pa.bool_()))

        docs = mapped(docs, of)
    return docs


def op1_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_bm25_decontamination": op1_bm25_decontamination}
ORACLES: dict[str, str] = {}
