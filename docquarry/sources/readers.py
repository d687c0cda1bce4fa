"""Sources and sinks: JSON lines, JSON arrays, day files of traces, vector tables, append-only logs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK = "id string, text string, ticker string, fiscal_year int, item string, section string, url string"
USER = "api_key string, id string, tickers array<string>, rpm double, daily_usd double"
TRACE = "trace_id string, name string, started_at string, duration_ms double, attrs string, spans array<struct<name: string, start_ms: double, duration_ms: double, attrs: string>>"
NAMESPACE = uuid.NAMESPACE_URL


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_traces(spark: SparkSession, folder: str, name: str | None = None) -> DataFrame:
    """All day files of a folder; started_at becomes a timestamp."""
    t = spark.read.schema(TRACE).json(f"{folder}/*.jsonl").withColumn("started_at", F.to_timestamp("started_at"))
    return t if name is None else t.where(F.col("name") == name)


def write_batch(folder: str, day: str, batch: DataFrame, number: int) -> None:
    """One micro-batch as JSON lines by day, in a place of its own: a batch that comes again replaces what it wrote before."""
    batch.withColumn("day", F.to_date(day)).write.mode("overwrite").partitionBy("day").json(f"{folder}/batch={number}")


def stream_day_files(events: DataFrame, folder: str, checkpoint: str, day: str = "ts") -> None:
    """All that a stream has now, as day files. A restart goes on from the checkpoint; a batch whose commit was lost is written again without a second copy."""
    query = events.writeStream.foreachBatch(lambda batch, number: write_batch(folder, day, batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_day_files(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of all batches, with the batch and the day; only the days asked for are read."""
    return spark.read.schema(f"{schema}, batch int, day date").json(folder)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_vectors(df: DataFrame, path: str, key: str, reset: bool = True) -> int:
    """Store or extend a vector table and return its row count; with reset, what was there is replaced."""
    df.withColumn("point_id", point_id(F.col(key))).write.mode("overwrite" if reset else "append").parquet(path)
    return df.sparkSession.read.parquet(path).count()


def write_json_array(df: DataFrame, path: str) -> None:
    """One file with one array, for settings and catalogs of a few thousand rows."""
    df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def migrate_vectors(spark: SparkSession, source: str, target: str, key: str) -> int:
    """The vectors of one store in another, in place of what was there; keys become the other store's point ids. Again gives the same store."""
    return write_vectors(spark.read.parquet(source).drop("point_id"), target, key)


def point_id(key: Column) -> Column:
    """A version-5 UUID of the key: SHA-1 over the namespace's bytes and the name, with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE.hex)), key.cast("string").cast("binary")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def latest_filings(filings: DataFrame, key: str, date: str, n: int, form: str = "10-K") -> DataFrame:
    """The last n filings of each key with exactly this form (amendments are other forms), and their fiscal year."""
    w = Window.partitionBy(key).orderBy(F.desc(date), F.desc("id"))
    ranked = filings.where(F.col("form") == form).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    return ranked.withColumn("fiscal_year", F.year("period_end"))
