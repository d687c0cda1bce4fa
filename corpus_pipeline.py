"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before kept, all but the last return the columns of documents, and the last one
returns the pieces of the sequences (doc_id, piece, start, length, ids_crc32, sequence_id, offset).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm.common import checkpoint_folder, table
from docquarry.llm.decontam import without_leaks
from docquarry.llm.line_dedup import dedup_lines
from docquarry.llm.packing import pack
from docquarry.llm.simhash import keep_one
from docquarry.llm.tokens import scratch_folder, tokenizer_path
from docquarry.llm.toxicity import LOW_QUALITY_THEN_TOXIC, without_toxic

#: SQL can express neither the fitted models nor the tokenizer; the tests compare with brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go; a score equal to the threshold stays.

    Null and empty texts are scored by the constants alone, very long ones whole, repeated rows each alike; a null
    id changes nothing. Without labels of both classes all stay. Other columns pass through, whatever their names;
    an empty table stays empty.
    """
    return without_toxic(docs, table(spark, sf_dir, "labels"), tuple(LOW_QUALITY_THEN_TOXIC), LOW_QUALITY_THEN_TOXIC)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of five words or more that repeat an earlier line, by id and place, but for one word at most go; every document stays.

    Null texts stay null, empty ones empty, very long ones are compared whole; rows equal in id and text lose the
    same lines; documents without an id are left alone. n_chars is set anew. Other columns pass through, whatever
    their names; an empty table stays empty.
    """
    return dedup_lines(docs)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    Ties are broken by hashes of the text, then of all columns, and of wholly equal rows one stays. Null and empty
    texts are one group, very long ones count whole; documents without an id stay. Other columns pass through,
    whatever their names; an empty table stays empty.
    """
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go; a score equal to the threshold counts.

    Null and empty texts hold nothing and stay, as do documents without an id; very long texts are searched whole,
    repeated rows each alike. Without test items all stay. Other columns pass through, whatever their names; an
    empty table stays empty.
    """
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest becomes token sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone; very long ones are cut; repeated rows are packed each; a null id is
    kept. Pieces of equal length are taken in the order of their parts. Other columns do not matter, whatever their
    names; an empty table gives no rows.
    """
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("simhash", simhash), ("decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what goes from stage to stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = scratch_folder(checkpoint_folder(spark), f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
