"""SimHash near-duplicates by multi-index hashing.

Each text gets a 64-bit fingerprint of its word shingles. To find fingerprints within `bound` differing bits,
the 64 bits are cut into segments, each with a radius, such that the radii plus one sum to more than `bound`:
any linked pair is then within the radius in at least one segment. Each fingerprint enumerates a small Hamming
ball in each segment by clearing up to `radius` of its set bits; two segments within the radius always meet at
their common bits. What meets at a segment value is verified on the complete 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import as_bytes, checkpointed, slices, table, text_column
from docquarry.llm.components import connected_components

#: Contract of the shingle hash.
SEED = 42
#: (width, radius) of the segments: (1+1) + (1+1) + (0+1) > 4.
SEGMENTS = ((21, 1), (21, 1), (22, 0))
#: The same for more fingerprints than SHORT_SEGMENTS can tell apart: (2+1) + (1+1) > 4.
LONG_SEGMENTS = ((32, 2), (32, 1))
MANY_FINGERPRINTS = 50_000_000
#: Rows at one segment value that one group compares; larger ones are cut into blocks, and pairs of blocks are compared.
GROUP_ROWS = 8192
#: Runs up to this length are compared by shifting whole batches.
SHORT_RUN = 24
#: Classes, or rows, that are broadcast at most (fifty bytes each); beyond that the join shuffles both sides.
BROADCAST_CLASSES = 500_000
_HASHES_AT_A_TIME = 65_536


def fingerprint(text: bytes, words: int = 4) -> int:
    """SimHash over the words of the lower-cased text (A-Z only), as contracted: over half of the shingle hashes set a bit."""
    parts = text.lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(parts) - words + 1].tolist()
    stops = ends[words - 1 :].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _HASHES_AT_A_TIME):
        few = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + _HASHES_AT_A_TIME], stops[at : at + _HASHES_AT_A_TIME])], "<u8")
        total += np.unpackbits(few.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every document; a text without words or a null text has 0."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t, words) for t in as_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), text_column(text)).mapInArrow(of, "doc_id long, fp long")


def _balls(classes: DataFrame, segments: tuple) -> DataFrame:
    """value (segment number and bits), level (bits cleared), radius, fp, id: the Hamming balls of every fingerprint."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            fp, at = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), 0
            rows = np.arange(len(fp))
            for number, (width, radius) in enumerate(segments):
                bits = (fp >> np.uint64(at)) & np.uint64((1 << width) - 1)
                at += width
                for level in range(radius + 1):
                    for cleared in combinations(range(width), level):
                        mask = np.uint64(sum(1 << c for c in cleared))
                        here = rows if not level else rows[(bits & mask) == mask]
                        value = (bits[here] & ~mask) | np.uint64(number << 40)
                        few = pa.array(here)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(value.view(np.int64)), pa.array(np.full(len(here), level, np.int8)), pa.array(np.full(len(here), radius, np.int8)), batch.column(0).take(few), batch.column(1).take(few)],
                            ["value", "level", "radius", "fp", "id"],
                        )

    return classes.select("fp", "id").mapInArrow(of, "value long, level byte, radius byte, fp long, id long")


def _long_run(run: dict[str, np.ndarray], bound: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links in one group, so that a dense group gives fewer links than rows."""
    fp, level, radius, block, cross, n = run["fp"], run["level"], run["radius"], run["block"], run["cross"], len(run["fp"])
    label, left, right = np.arange(n), [], []
    for at in range(0, n, 256):
        to = min(at + 256, n)
        close = np.bitwise_count(fp[at:to, None] ^ fp[None, :to]) <= bound
        close &= (level[at:to, None] + level[None, :to]) <= radius[at:to, None]
        close &= ~(cross[at:to, None] & (block[at:to, None] == block[None, :to]))
        close &= np.arange(to)[None, :] < np.arange(at, to)[:, None]
        for r in np.nonzero(close.any(1))[0]:
            own, met = at + r, np.nonzero(close[r])[0]
            _, first = np.unique(label[met], return_index=True)
            for other in met[first]:
                if label[other] != label[own]:
                    left.append(own)
                    right.append(other)
                    label[label == label[other]] = label[own]
    return left, right


def _links_of(run: dict[str, np.ndarray], bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links (ids) among rows sorted by group."""
    group, fp = run["group"], run["fp"]
    starts = np.concatenate(([0], np.nonzero(group[1:] != group[:-1])[0] + 1, [len(group)]))
    lengths = np.diff(starts)
    a, b = [], []
    length_here = np.repeat(lengths, lengths)
    for shift in range(1, min(SHORT_RUN, lengths.max(initial=0))):
        i = np.nonzero((group[:-shift] == group[shift:]) & (length_here[:-shift] <= SHORT_RUN))[0]
        j = i + shift
        ok = (run["level"][i] + run["level"][j] <= run["radius"][i]) & ~(run["cross"][i] & (run["block"][i] == run["block"][j]))
        i, j = i[ok], j[ok]
        ok = np.bitwise_count(fp[i] ^ fp[j]) <= bound
        a.append(run["id"][i[ok]])
        b.append(run["id"][j[ok]])
    for at in np.nonzero(lengths > SHORT_RUN)[0]:
        part = {k: v[starts[at] : starts[at + 1]] for k, v in run.items()}
        left, right = _long_run(part, bound)
        a.append(part["id"][left])
        b.append(part["id"][right])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(classes: DataFrame, bound: int = 4, segments: tuple = SEGMENTS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """a, b: links between the ids of different fingerprints (fp, id) at `bound` or fewer differing bits, enough to connect all that are linked."""
    if sum(w for w, _ in segments) != 64 or sum(r + 1 for _, r in segments) <= bound:
        raise ValueError("the segments must cover 64 bits, and their radii plus one sum to more than the bound")
    balls = _balls(classes, segments)
    crowded = balls.groupBy("value").count().where(F.col("count") > group_rows).select("value", F.ceil(F.col("count") / (group_rows // 2)).cast("int").alias("blocks"))
    marked = balls.join(crowded, "value", "left").withColumn("block", F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")))
    other = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = marked.withColumn("other", F.explode(other)).select(
        F.when(F.col("blocks").isNull(), F.col("value")).otherwise(F.xxhash64("value", F.least("block", "other"), F.greatest("block", "other"))).alias("group"),
        "level", "radius", "block", (F.col("block") != F.col("other")).alias("cross"), "fp", "id",
    )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None

        def out(run: dict[str, np.ndarray]) -> pa.RecordBatch:
            a, b = _links_of(run, bound)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            new = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("group", "level", "radius", "block", "cross", "id")}
            new["fp"] = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(new["group"]):
                continue
            run = new if held is None else {k: np.concatenate((held[k], new[k])) for k in new}
            last = int(np.searchsorted(run["group"], run["group"][-1]))  # the last group may go on in the next batch
            if last:
                yield out({k: v[:last] for k, v in run.items()})
            held = {k: v[last:] for k, v in run.items()}
        if held is not None:
            yield out(held)

    return met.repartition("group").sortWithinPartitions("group").mapInArrow(of, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, bound: int = 4, segments: tuple | None = None) -> DataFrame:
    """doc_id, fp, component_id of every document.

    component_id is the smallest doc_id that is reachable by links, its own included. Texts without words (or
    null) have fingerprint zero and are linked like any other. Equal fingerprints are one class: only classes
    are compared, so copies cost nothing more. A document without an id is fingerprinted but stays alone, with
    a null component_id. Rows that repeat an id are returned each; an empty table gives no rows.
    """
    fps = checkpointed(fingerprints(docs, key, text, words))
    classes = fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("id"))
    if segments is None:
        segments = SEGMENTS if classes.count() < MANY_FINGERPRINTS else LONG_SEGMENTS
    # two classes can share their smallest id where rows repeat an id; then they are one component already
    found = connected_components(links(classes, bound, segments))
    placed = classes.join(found, classes["id"] == found["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return fps.join(placed, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, bound: int = 4, segments: tuple | None = None) -> DataFrame:
    """One document of each group of near-duplicates, with all its columns: the one with the smallest id.

    Rows are told apart by id, text and the other columns, so rows that repeat an id but not its text are
    compared like any others; of rows of one id the one with the smallest hash of text, then of all columns,
    comes first, and of rows equal in all columns one stays. Null and empty texts have fingerprint zero and are
    one group. A document without an id stays and makes nothing else go. Texts of any length count whole; columns
    may have any names; an empty table gives no rows.
    """
    names = docs.columns
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))  # names of our own beside ours
    content = F.col(f"c{names.index(text)}").cast("string")
    hashed = [F.xxhash64(f.name) for f in plain.schema.fields if "map<" not in f.dataType.simpleString()]
    plain = plain.withColumns({"id": F.col(f"c{names.index(key)}").cast("long"), "t": F.xxhash64(content), "r": F.xxhash64(*hashed)})
    row = F.struct("id", "t", "r")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t, words) for t in as_bytes(batch.column(3))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fps.view(np.int64))], ["id", "t", "r", "fp"])

    fps = checkpointed(plain.where("id IS NOT NULL").select("id", "t", "r", F.coalesce(content, F.lit("")).alias("text")).mapInArrow(of, "id long, t long, r long, fp long"))
    classes = checkpointed(fps.groupBy("fp").agg(F.min(row).alias("first"), F.count("*").alias("rows")))
    if segments is None:
        segments = SEGMENTS if classes.count() < MANY_FINGERPRINTS else LONG_SEGMENTS
    found = checkpointed(connected_components(links(classes.select("fp", F.col("fp").alias("id")), bound, segments)))
    linked = classes.join(found, classes["fp"] == found["node"]).select("fp", "first", "component")
    best = linked.groupBy("component").agg(F.min("first").alias("best"))
    alone = classes.where("rows > 1").join(found, classes["fp"] == found["node"], "left_anti").select("fp", F.col("first").alias("best"))
    # Only classes that hold several rows or are linked can lose any: far fewer than the documents.
    several = checkpointed(linked.join(best, "component").select("fp", "best").unionByName(alone))
    few = F.broadcast(several) if several.count() <= BROADCAST_CLASSES else several
    met = checkpointed(fps.join(few, "fp").select("id", "t", "r", (row == F.col("best")).alias("stays")))
    gone = met.where("NOT stays").select("id", "t", "r").distinct()
    kept = plain.join(F.broadcast(gone) if gone.count() <= BROADCAST_CLASSES else gone, ["id", "t", "r"], "left_anti")
    twice = checkpointed(met.where("stays").groupBy("id", "t", "r").count().where("count > 1").select("id", "t", "r"))
    if twice.head(1):
        few = F.broadcast(twice) if twice.count() <= BROADCAST_CLASSES else twice
        repeated = kept.join(few, ["id", "t", "r"], "left_semi").dropDuplicates(["id", "t", "r"])
        kept = kept.join(few, ["id", "t", "r"], "left_anti").unionByName(repeated)
    return kept.select(*plain.columns[: len(names)]).toDF(*names)


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash_dedup": op2_simhash_dedup}
ORACLES: dict[str, str] = {}
