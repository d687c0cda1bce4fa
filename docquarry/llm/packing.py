"""Packing of token sequences by best-two-fit, planned on the histogram of lengths.

Which document goes where matters only through its length, and there are at most `capacity` lengths. So the
bins are planned on the counts of lengths (at most `capacity` rows, whatever the corpus), many equal bins at a
time: a bin is filled greedily with the largest pieces that fit, then its smallest piece is replaced by two
unpacked ones that fill the expanded gap more tightly. Pieces then take their places by their rank among the
pieces of equal length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.llm.common import as_text, checkpointed, slices, table, text_column
from docquarry.llm.tokens import encoder, tokenizer_path

SEQUENCE_TOKENS = 1024
END_ID = 2
#: Gaps that a bin may keep without a swap, each of which is tried.
GAPS = (0, 1, 2, 4, 8, 16, 32, 64)


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n tokens: all full but the first, which may be shorter."""
    return [n] if n <= capacity else [n % capacity] * (n % capacity > 0) + [capacity] * (n // capacity)


def _two_that_fit(counts: np.ndarray, space: int, above: int) -> tuple[int, int] | None:
    """Two unpacked lengths whose sum is the largest up to `space`, if it is over `above`."""
    lengths = np.arange(space + 1)
    there = counts[: space + 1] > 0
    upto = np.maximum.accumulate(np.where(there, lengths, 0))  # the largest unpacked length up to x
    first = np.nonzero(there)[0]
    first = first[first > 0]
    second = upto[space - first]
    alone = (second == first) & (counts[first] < 2)
    second = np.where(alone, upto[np.maximum(first - 1, 0)], second)
    total = np.where(second > 0, first + second, 0)
    if not len(total) or total.max() <= above:
        return None
    best = int(total.argmax())
    return int(first[best]), int(second[best])


@dataclass
class Plan:
    """Places by length: from rank `rank` on, `uses` pieces of that length lie side by side from `offset` in each of the sequences from `sequence` on."""

    start: np.ndarray  # where each length's rows begin
    rank: np.ndarray
    uses: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for n in np.unique(length):
            here, rows = np.nonzero(length == n)[0], slice(self.start[n], self.start[n + 1])
            at = np.searchsorted(self.rank[rows], rank[here], side="right") - 1 + self.start[n]
            bin_no, place = np.divmod(rank[here] - self.rank[at], self.uses[at])
            sequence[here] = self.sequence[at] + bin_no
            offset[here] = self.offset[at] + place * n
        return sequence, offset


def plan_bins(counts: np.ndarray, capacity: int) -> Plan:
    """The plan with the fewest sequences of best-two-fit under each of GAPS and swaps: the histogram is small, so trying costs next to nothing."""
    return min((_plan(counts, capacity, gap, swaps) for gap in GAPS for swaps in (1, capacity)), key=lambda p: p.sequences)


def _plan(counts: np.ndarray, capacity: int, gap: int, swaps: int) -> Plan:
    """Best-two-fit over counts[length]; each round makes as many equal bins as the counts allow.

    A bin's smallest piece is replaced by two unpacked ones where that tightens its gap and the gap is over `gap`
    (which spares small pieces for later bins), again and again up to `swaps` times.
    """
    left = counts.astype(np.int64).copy()
    rows: list[tuple[int, int, int, int, int]] = []
    taken, sequence = np.zeros(capacity + 1, np.int64), 0
    while (top := int(np.nonzero(left)[0].max(initial=0))) > 0:
        filled: dict[int, int] = {}
        space, n = capacity, top
        rest = left.copy()
        while True:
            uses = min(int(rest[n]), space // n)
            filled[n] = uses
            rest[n] -= uses
            space -= uses * n
            fitting = np.nonzero(rest[: space + 1])[0]
            if not len(fitting) or fitting[-1] == 0:
                break
            n = int(fitting[-1])
        for _ in range(swaps):
            smallest = min(filled)
            if space <= gap or not (two := _two_that_fit(rest, space + smallest, smallest)):
                break
            filled[smallest] -= 1
            rest[smallest] += 1
            for n in two:
                filled[n] = filled.get(n, 0) + 1
                rest[n] -= 1
            space += smallest - sum(two)
            filled = {n: uses for n, uses in filled.items() if uses}
        bins = min(int(left[n]) // uses for n, uses in filled.items())
        offset = 0
        for n, uses in sorted(filled.items(), reverse=True):
            rows.append((n, int(taken[n]), uses, sequence, offset))
            taken[n] += uses * bins
            left[n] -= uses * bins
            offset += uses * n
        sequence += bins
    length, rank, uses, first, offset = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return Plan(np.searchsorted(length, np.arange(capacity + 2)), rank, uses, first, offset, sequence)


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and _part, _rank: its place among the part's pieces of equal length."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, part = encoder(path), np.uint32(end_id).astype("<u4").tobytes(), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in slices(batches):
            row, piece, start, length, crc, rank = [], [], [], [], [], []
            for r, t in enumerate(as_text(batch.column(1))):
                ids, at = enc.encode(t) + end, 0
                for k, n in enumerate(cut(len(ids) // 4, capacity)):
                    row.append(r), piece.append(k), start.append(at), length.append(n)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + n)]))
                    rank.append(seen[n])
                    seen[n] += 1
                    at += n
            columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, kind) for c, kind in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64()), ([part] * len(row), pa.int32()), (rank, pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_rank"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), text_column(text)).mapInArrow(of, "doc_id long, piece int, start long, length long, ids_crc32 long, _part int, _rank long")


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    Ids come from the tokenizer file at `path`, then the end id; a null or empty text is the end id alone.
    Documents over `capacity` tokens are cut; the rest are whole. Repeated rows are packed each, a null id is
    kept as null, an empty table gives no rows. The driver gets one row for each length only.
    """
    cut_up = checkpointed(pieces(docs, path, key, text, capacity, end_id))
    by_part = cut_up.groupBy("_part", "length").count()
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut_up.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    plan = plan_bins(counts, capacity)
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = by_part.select("_part", "length", F.coalesce(F.sum("count").over(before), F.lit(0).cast("long")).alias("_shift"))
    ranked = cut_up.join(shifts, ["_part", "length"]).withColumn("_rank", F.col("_rank") + F.col("_shift"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            sequence, offset = plan.place(length, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(
        of, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def op4_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


QUERIES = {"op4_best_two_fit": op4_best_two_fit}
ORACLES: dict[str, str] = {}
