"""Quality rules: base rules on document statistics, then boosted trees over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import as_bytes, checkpointed, slices, table, text_column
from docquarry.llm.trees import Forest, fit

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_stops", "n_distinct"]
#: Labelled rows that the trees are fitted on, at most; those with the smallest hashes of their ids.
FIT_ROWS = 20_000
KEEP_FROM = 0.5

# Bytes that count as symbols, and bytes of the two kinds of marks.
SYMBOLS = b"#*$%&|<>"
EXCLAIM = b"!?"
STOPS = b".,;:"

#: What the trees see, and whether the verdict may only fall (-1) with it.
FEATURES = [
    ("symbols a word", -1), ("repeated lines of all", -1), ("words in repeated windows of all", -1), ("upper-case letters of all characters", -1),
    ("exclamations a word", -1), ("digits of all characters", 0), ("characters a word", 0), ("words a line", 0), ("stops a word", 0), ("distinct words of all", 0), ("log of words", 0),
]


def _repeated(words: list[bytes]) -> tuple[int, int]:
    """Words in three-word windows that come twice or more, and distinct words."""
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    if len(ids) < 4:
        return 0, len(seen)
    kinds, left = len(seen), ids[:-2]
    pair = ids[:-2] * kinds + ids[1:-1]
    if kinds > 1 << 20:  # three ids would not fit in 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair * kinds + ids[2:]
    order = np.argsort(window, kind="stable")
    equal = window[order][1:] == window[order][:-1]
    again = np.zeros(len(left), bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    inside = np.zeros(len(ids), bool)
    for k in range(3):
        inside[k : k + len(again)] |= again
    return int(inside.sum()), kinds


def statistics(text: bytes) -> list[int]:
    """The counts of COUNTS over a whole text. Words are runs of anything but ASCII white space; word_chars are their code points."""
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    repeated, distinct = _repeated(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    characters = int(kinds.sum() - kinds[0x80:0xC0].sum())
    blank = int(kinds[0x20] + kinds[0x09:0x0E].sum())
    return [
        len(words), characters - blank, int(kinds[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated, len(lines),
        int(kinds[65:91].sum()), int(kinds[48:58].sum()), int(kinds[list(EXCLAIM)].sum()), int(kinds[list(STOPS)].sum()), distinct,
    ]


def document_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and COUNTS of every document; a null text has none of anything."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts = np.array([statistics(t) for t in as_bytes(batch.column(1))], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts.T)], ["doc_id", *COUNTS])

    return docs.select(F.col(key).cast("long").alias("doc_id"), text_column(text)).mapInArrow(of, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}")


def features(counts: np.ndarray) -> np.ndarray:
    """One row for each row of COUNTS, one column for each of FEATURES."""
    c = dict(zip(COUNTS, np.asarray(counts, float).T))
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.stack([
        c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_upper"] / chars, c["n_marks"] / words, c["n_digits"] / chars,
        chars / words, words / lines, c["n_stops"] / words, c["n_distinct"] / words, np.log(words),
    ], 1)


def fit_on_labels(stats: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, label: str = "quality") -> Forest | None:
    """Trees for the label, from `rows` labelled documents at most; None where fewer than two classes are labelled.

    An id counts once: of several labels the smallest, of several rows of documents the one with the smallest statistics.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col(label).cast("int")).alias("_label"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    once = stats.join(F.broadcast(some), "doc_id").groupBy("doc_id", "_label").agg(F.min(F.struct(*COUNTS)).alias("counts"))
    found = once.select("doc_id", "_label", "counts.*").orderBy("doc_id").toPandas()
    if found["_label"].nunique() < 2:
        return None
    return fit(features(found[COUNTS].to_numpy()), (found["_label"] > 0).to_numpy(float), [sign for _, sign in FEATURES])


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = FIT_ROWS, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept, p_good of every document.

    base_failed: fewer than 50 words, or over half of the words in repeated windows. kept: not base_failed, and
    the trees give `keep_from` or more (a tie keeps). Without labels of both classes the base rules decide alone
    (p_good null). A null or empty text has no words and fails; texts of any length count whole. Repeated rows are
    judged each, a null id stays null, other columns do not matter, an empty table gives no rows.
    """
    stats = checkpointed(document_statistics(docs, key, text))
    forest = fit_on_labels(stats, labels, rows)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in COUNTS], 1)
            failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
            if forest is None:
                p, kept = pa.nulls(len(counts), pa.float64()), ~failed
            else:
                good = 1 / (1 + np.exp(-forest.score(features(counts))))
                p, kept = pa.array(good), ~failed & (good >= keep_from)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(failed), pa.array(kept), p], [*batch.schema.names, "base_failed", "kept", "p_good"])

    schema = f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, p_good double"
    return stats.mapInArrow(of, schema)


def op5_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


QUERIES = {"op5_boosted_quality": op5_boosted_quality}
ORACLES: dict[str, str] = {}
