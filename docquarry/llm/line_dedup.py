"""Line deduplication by a deletion-neighbourhood join.

Lines are compared as sequences of lower-case words; the edit bound is one word put in, taken out or changed,
whatever the length of the line (a similarity of 0.8 only for lines of five words). Every line emits its variants as hashed
keys: itself, each deletion, and each deletion with its place kept (a gap). Equal keys join: a line and another's
deletion differ by one word put in or taken out, two lines with the same gap by one changed word. A link is
verified on the words, and of two linked lines the earlier one stays.

Only lines that can have a partner emit variants. One edit leaves the first or the last half of a line whole, so
each line has four half keys (two for partners up to its own length, two for partners one word shorter); a line
none of whose half keys is shared with another line has no partner. Copies of a line are one line here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import as_text, checkpointed, slices, table

#: Shorter lines are never removed.
LEAST_WORDS = 5
#: Places of candidate lines that are broadcast at most (a hundred bytes each, with their document); beyond that they are joined by a shuffle.
BROADCAST_PLACES = 500_000
#: Keys that more than one line has, broadcast at most (a hundred bytes each); beyond that the join shuffles both sides.
BROADCAST_KEYS = 500_000

_BASE = 0x9E3779B97F4A7C15
_GAP = np.uint64(0xD6E8FEB86659FD93)
_CHANGED = np.uint64(0xA5A5A5A55A5A5A5A)
_PLACE = ["doc_id", "row", "line_no"]
_HALVES = ["first", "last", "first_shorter", "last_shorter"]


def words_of(line: str) -> list[bytes]:
    return line.lower().encode("utf-8", "surrogatepass").split()


def row_of(text: str) -> int:
    """Tells apart rows that repeat an id; rows equal in id and text are one document."""
    return _signed(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def half_keys(words: list[bytes]) -> list[int]:
    """Hashes of the first and last half: for partners of the same length or one word longer, and for partners one word shorter."""
    out, n = [], len(words)
    for shorter in (n, n - 1):
        half = shorter // 2
        out.append(xxhash.xxh3_64_intdigest(b" ".join(words[:half]), 4 * shorter))
        out.append(xxhash.xxh3_64_intdigest(b" ".join(words[n - (shorter - half) :]), 4 * shorter + 1))
    return [_signed(x) for x in out]


def variant_keys(words: list[bytes]) -> tuple[int, np.ndarray, np.ndarray]:
    """Keys of the line itself, of each deletion, and of each deletion that keeps its gap; a deletion's key is that of the shorter line."""
    n = len(words)
    powers = np.full(n + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    each = np.array([xxhash.xxh3_64_intdigest(w, 7) | 1 for w in words], np.uint64)
    upto = np.concatenate(([np.uint64(0)], np.cumsum(each * powers[:n], dtype=np.uint64)))
    behind = upto[n] - upto[1:]
    back = np.uint64(pow(_BASE, -1, 1 << 64))
    deleted = upto[:n] + behind * back
    length = np.array([n, n - 1], np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return int(upto[n] ^ length[0]), deleted ^ length[1], (upto[:n] + behind + _GAP * powers[:n]) ^ length[0] ^ _CHANGED


def within_one_edit(a: list, b: list) -> bool:
    """Edit distance of one word at most."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def _few(keys: DataFrame) -> DataFrame:
    """A table of keys, broadcast if it is small, so that the other side of its join need not be shuffled again."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _lines(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """doc_id, row, line_no, two hashes and the half keys of every line of enough words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for doc, t in zip(batch.column(0).to_pylist(), as_text(batch.column(1))):
                row = row_of(t)
                for k, line in enumerate(t.split("\n")):
                    words = words_of(line)
                    if len(words) >= least:
                        both = xxhash.xxh3_128_intdigest(b" ".join(words))
                        out.append((doc, row, k, _signed(both >> 64), _signed(both & (1 << 64) - 1), *half_keys(words)))
            columns = list(zip(*out)) if out else [()] * 9
            kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], [*_PLACE, "h1", "h2", *_HALVES])

    named = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return named.mapInArrow(of, f"doc_id long, row long, line_no int, h1 long, h2 long, {', '.join(f'{h} long' for h in _HALVES)}")


def _by_doc(places: DataFrame, name: str, *columns: str) -> DataFrame:
    """One row a document with its places, never more than it has lines."""
    return places.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias(name))


def _texts_of(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, row, line_no, line, shared of the wanted places (doc_id, row, line_no, shared)."""
    by_doc = _by_doc(wanted, "wanted", "row", "line_no", "shared")
    if wanted.count() <= BROADCAST_PLACES:
        by_doc = F.broadcast(by_doc)
    here = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).join(by_doc, "doc_id")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for doc, t, places in zip(batch.column(0).to_pylist(), as_text(batch.column(1)), batch.column(2).to_pylist()):
                row, lines = row_of(t), t.split("\n")
                out += [(doc, row, p["line_no"], lines[p["line_no"]], p["shared"]) for p in places if p["row"] == row]
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32()])], [*_PLACE, "line", "shared"])

    return here.select("doc_id", "text", "wanted").mapInArrow(of, "doc_id long, row long, line_no int, line string, shared int").dropDuplicates(_PLACE)


def _variants(lines: DataFrame) -> DataFrame:
    """key, whole (the line itself, not a deletion), gap, and the line's place.

    shared has a bit for each half key that another line has. A partner of a shared first half differs in the
    last one and the other way round, so only variants with their edit in the half that is not shared are emitted.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            which, keys, kinds = [], [], []
            for r, (line, shared) in enumerate(zip(as_text(batch.column(3)), batch.column(4).to_pylist())):
                whole, deleted, gaps = variant_keys(words_of(line))
                n = len(gaps)
                own = np.array([whole] * bool(shared & 3), np.uint64)
                gaps = gaps[(0 if shared & 2 else n // 2) : (n if shared & 1 else n // 2)]
                deleted = np.unique(deleted[(0 if shared & 8 else (n - 1) // 2) : (n if shared & 4 else (n - 1) // 2 + 1)]) if shared & 12 else deleted[:0]
                keys += [own, deleted, gaps]
                sizes = [len(own), len(deleted), len(gaps)]
                which.append(np.full(sum(sizes), r))
                kinds.append(np.repeat(np.array([0, 1, 2], np.int8), sizes))
            if not keys:
                continue
            rows, kind = pa.array(np.concatenate(which)), np.concatenate(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), pa.array(kind == 0), pa.array(kind == 2), *(batch.column(c).take(rows) for c in range(3))], ["key", "whole", "gap", *_PLACE]
            )

    return lines.select(*_PLACE, "line", "shared").mapInArrow(of, "key long, whole boolean, gap boolean, doc_id long, row long, line_no int")


def near_copies(lines: DataFrame) -> DataFrame:
    """The places of lines (doc_id, row, line_no, line, shared; no two alike) that have an earlier line within one edit.

    For each key only the earliest place of each kind counts, so a group of near copies gives one link a row and
    no pairs. The minima are combined before the shuffle, and the join back may be split where a key is hot.
    """
    place = F.struct(*_PLACE)
    variants = _variants(lines)
    first = variants.groupBy("key").agg(
        F.min(F.when(F.col("gap"), place)).alias("gap_first"), F.min(F.when(F.col("whole"), place)).alias("whole_first"), F.min(F.when(~F.col("gap") & ~F.col("whole"), place)).alias("cut_first"), F.count("*").alias("rows")
    )
    met = variants.join(_few(checkpointed(first.where("rows > 1").drop("rows"))), "key")
    partner = F.when(F.col("gap"), F.col("gap_first")).when(F.col("whole"), F.col("cut_first")).otherwise(F.col("whole_first"))
    found = met.withColumn("partner", partner).where(F.col("partner") < place).groupBy(*_PLACE).agg(F.min("partner").alias("partner"))
    partners = lines.select(place.alias("partner"), F.col("line").alias("other"))
    pairs = found.join(lines.drop("shared"), _PLACE).join(partners, "partner")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            a, b = as_text(batch.column(3)), as_text(batch.column(4))
            yield batch.select(_PLACE).filter(pa.array([within_one_edit(words_of(x), words_of(y)) for x, y in zip(a, b)], pa.bool_()))

    return pairs.select(*_PLACE, "line", "other").mapInArrow(of, "doc_id long, row long, line_no int")


def dropped_places(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, row, line_no of the lines of `least` words or more that go: all copies of a line but the earliest, and the earliest where it is a near copy."""
    place = F.struct(*_PLACE)
    every = checkpointed(_lines(docs, key, text, least))
    grouped = every.groupBy("h1", "h2").agg(F.min(place).alias("p"), F.max(place).alias("q"), *(F.min(h).alias(h) for h in _HALVES))
    distinct = checkpointed(grouped.select("p.*", "h1", "h2", (F.col("p") != F.col("q")).alias("repeated"), *_HALVES))
    repeated = distinct.where("repeated").select("h1", "h2", place.alias("p"))
    copies = every.select(*_PLACE, "h1", "h2").join(_few(repeated), ["h1", "h2"]).where(place != F.col("p")).select(*_PLACE).distinct()
    halves = distinct.select("h1", F.posexplode(F.array(*_HALVES)).alias("which", "half"))
    shared = checkpointed(halves.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a != b").select("half"))
    partnered = halves.join(_few(shared), "half", "left_semi").groupBy("h1").agg(F.sum_distinct(F.expr("shiftleft(1, which)")).cast("int").alias("shared"))
    candidates = checkpointed(distinct.join(partnered, "h1").select(*_PLACE, "shared"))
    lines = checkpointed(_texts_of(docs, candidates, key, text))
    return copies.unionByName(near_copies(lines).distinct())


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_WORDS, length: str | None = "n_chars", marks: bool = False) -> DataFrame:
    """The documents, their text without lines that repeat an earlier one.

    A line of `least` words or more goes if an earlier line (by id, then place) is equal in words or within one
    edit of it, whether or not that one stays. Shorter lines, and documents without an id, are left alone and
    make nothing else go. A null text stays null; rows equal in id and text lose the same lines; a document all
    of whose lines go keeps an empty text; texts and lines of any length are compared whole; an empty table gives
    no rows. Where the table has the column `length`, it is set to the new code points. marks adds n_lines and
    n_dropped, in place of columns of these names. Other columns are left alone, whatever their names.
    """
    if marks:
        docs = docs.select(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c not in ("n_lines", "n_dropped")))
    names = docs.columns
    own, where, sized = names.index(key), names.index(text), names.index(length) if length in names else None
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))  # names of our own beside ours
    gone = checkpointed(dropped_places(plain, f"c{own}", f"c{where}", least))
    # Copies grow with the documents, so this join deals out both sides at every size.
    by_doc = _by_doc(gone, "gone", "row", "line_no").withColumnRenamed("doc_id", "gone_id").hint("merge")
    joined = plain.join(by_doc, F.col(f"c{own}").cast("long") == F.col("gone_id"), "left").drop("gone_id")
    added = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())] if marks else []
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in plain.schema.fields] + added)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns, texts, count, lost = list(batch.columns[:-1]), [], [], []
            for doc, t, places in zip(batch.column(own).to_pylist(), batch.column(where).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                lines = (t or "").split("\n")
                stay = lines
                if places and t is not None and doc is not None:
                    row = row_of(t)
                    out = {p["line_no"] for p in places if p["row"] == row}
                    stay = [x for k, x in enumerate(lines) if k not in out]
                texts.append(None if t is None else "\n".join(stay)), count.append(len(lines)), lost.append(len(lines) - len(stay))
            columns[where] = pa.array(texts, pa.string())
            if sized is not None:
                columns[sized] = pa.array([None if x is None else len(x) for x in texts], pa.int64()).cast(columns[sized].type)
            if marks:
                columns += [pa.array(count, pa.int64()), pa.array(lost, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return joined.mapInArrow(of, schema).toDF(*names, *(f.name for f in added))


def op9_deletion_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), marks=True)
    return found.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


QUERIES = {"op9_deletion_line_dedup": op9_deletion_line_dedup}
ORACLES: dict[str, str] = {}
