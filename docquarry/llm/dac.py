"""Token files with directly addressable codes.

A segment holds the ids of some consecutive documents. Each id is split into 8-bit chunks, lowest first. Level
k holds the k-th chunks of all ids that have one, a bitmap tells which of them go on to level k + 1, and a rank
directory counts the set bits before every block of 512. The i-th id of a level goes on at index rank(i) of the
next, so any token is found by a few look-ups, and a run of tokens is a run in every level; no block is decoded.

Segment layout, little-endian: magic, uint32 levels, then for each level uint64 n, n chunk bytes, and, unless it
is the last, the bitmap (n bits, lowest first, in whole bytes) and one uint32 for each block of 512 bits.

Spark writes segments as rows of a Parquet table (any store that Spark writes to; a lost executor's task is
simply run again): part, segment, before (ids in the part before the segment), doc_ids, ends (ids in the
segment up to each document's end), payload.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.llm.common import as_text, checkpoint_folder, slices, table, text_column
from docquarry.llm.tokens import encoder, scratch_folder, tokenizer_path

MAGIC = b"DAC1"
BLOCK_BITS = 512
END_ID = 1
#: A segment is closed at so many ids or documents.
SEGMENT_IDS, SEGMENT_DOCS = 1 << 20, 4096
SCHEMA = "part int, segment int, before long, doc_ids array<long>, ends array<long>, payload binary"


def encode(ids: np.ndarray) -> bytes:
    """A segment of unsigned 32-bit ids."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest > 0xFF
        last = not more.any()
        level = struct.pack("<Q", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes()
        if not last:
            bits = np.packbits(more, bitorder="little")
            blocks = np.add.reduceat(more, np.arange(0, len(more), BLOCK_BITS), dtype=np.uint32)
            level += bits.tobytes() + (np.cumsum(blocks, dtype=np.uint32) - blocks).astype("<u4").tobytes()
        levels.append(level)
        if last:
            return MAGIC + struct.pack("<I", len(levels)) + b"".join(levels)
        rest = rest[more] >> 8


class Segment:
    """Random access to an encoded segment; its arrays are views of the bytes."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        (levels,), at = struct.unpack_from("<I", payload, 4), 8
        self.levels: list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]] = []
        for k in range(levels):
            (n,) = struct.unpack_from("<Q", payload, at)
            chunks = np.frombuffer(payload, np.uint8, n, at + 8)
            at += 8 + n
            bits = ranks = None
            if k + 1 < levels:
                bits = np.frombuffer(payload, np.uint8, -(-n // 8), at)
                at += len(bits)
                ranks = np.frombuffer(payload, "<u4", -(-n // BLOCK_BITS), at)
                at += 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Set bits before i: the directory, then the bytes of one block."""
        if i == 8 * len(bits) or i // BLOCK_BITS == len(ranks):
            block = len(ranks) - 1
        else:
            block = i // BLOCK_BITS
        first = block * BLOCK_BITS // 8
        count = int(ranks[block]) + int(np.bitwise_count(bits[first : i // 8]).sum(dtype=np.int64))
        return count + (int(bits[i // 8]) & ((1 << i % 8) - 1)).bit_count() if i % 8 else count

    def access(self, i: int) -> int:
        """The i-th id."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            if bits is None or not bits[i // 8] >> i % 8 & 1:
                break
            i = self._rank(bits, ranks, i)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop, which are a run in every level."""
        out, where, start, stop = np.zeros(stop - start, "<u4"), None, start, stop
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            part = chunks[start:stop].astype("<u4") << np.uint32(8 * k)
            if where is None:
                out |= part
            else:
                out[where] |= part
            if bits is None or start == stop:
                break
            more = np.unpackbits(bits[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :][: stop - start].astype(bool)
            where = np.nonzero(more)[0] if where is None else where[more]
            start = self._rank(bits, ranks, start)
            stop = start + int(more.sum())
        return out


def write(docs: DataFrame, path: str, folder: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, segment_ids: int = SEGMENT_IDS, segment_docs: int = SEGMENT_DOCS) -> None:
    """Encode every document with the tokenizer file at `path`, append the end id, and write segments to `folder` in ascending order of the key.

    Documents are dealt out by ranges of the key and sorted in each, so parts and segments follow its order;
    a null key comes first, rows with equal keys are ordered by text. A null text is empty.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, part = encoder(path), np.uint32(end_id).astype("<u4").tobytes(), TaskContext.get().partitionId()
        segment = before = total = 0
        keys: list[int | None] = []
        ends: list[int] = []
        held: list[bytes] = []

        def out() -> pa.RecordBatch:
            payload = encode(np.frombuffer(b"".join(held), "<u4"))
            columns = [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([before], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "segment", "before", "doc_ids", "ends", "payload"])

        for batch in slices(batches):
            for k, t in zip(batch.column(0).to_pylist(), as_text(batch.column(1))):
                ids = enc.encode(t) + end
                total += len(ids) // 4
                keys.append(k), ends.append(total), held.append(ids)
                if total >= segment_ids or len(keys) >= segment_docs:
                    yield out()
                    segment, before, total, keys, ends, held = segment + 1, before + total, 0, [], [], []
        if keys:
            yield out()

    ordered = docs.select(F.col(key).cast("long").alias("doc_id"), text_column(text)).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(of, SCHEMA).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files at `folder`, each taken out of its segment by random access.

    start counts the ids of all documents before it. What is broadcast is one row for each part that was written.
    """
    files = spark.read.schema(SCHEMA).parquet(folder)
    sizes = files.groupBy("part").agg(F.sum(F.element_at("ends", -1)).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("long").alias("part_start"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            segment, begin, ends = Segment(row["payload"]), [0, *row["ends"][:-1]], row["ends"]
            crc = [zlib.crc32(segment.slice(a, b).tobytes()) for a, b in zip(begin, ends)]
            start = np.array(begin, np.int64) + row["before"] + row["part_start"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(start), pa.array(np.array(ends, np.int64) - np.array(begin, np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    placed = files.join(F.broadcast(starts), "part").select("doc_ids", "ends", "payload", "before", "part_start")
    return placed.mapInArrow(of, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_dac_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(checkpoint_folder(spark), "dac-tokens")
    write(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), folder)
    return read(spark, folder)


QUERIES = {"op10_dac_tokens": op10_dac_tokens}
ORACLES: dict[str, str] = {}
