"""What the corpus operators share: reading tables, cutting lineage, walking Arrow batches."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text that a Python worker turns into Python objects at a time.
ROWS_AT_A_TIME = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where that is unset a local session takes a temporary folder, and a cluster, whose machines share none, is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="docquarry-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared folder, so that a lost executor costs no recomputation of it."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_A_TIME) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to few rows, which bounds what a worker holds as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mapped(df: DataFrame, of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """df with each of its batches handled by `of`, by place: columns are c0, c1, ... in it, whatever their names outside."""
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    return plain.mapInArrow(of, plain.schema).toDF(*df.columns)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def text_column(name: str = "text"):
    """The text as a string, whatever the column's type; null is empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


#: ASCII white space and punctuation part words.
_PARTING = bytes(32 if x < 48 or 58 <= x < 65 or 91 <= x < 97 or 123 <= x < 128 else x for x in range(256))


def words(text: str) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_PARTING).split()
