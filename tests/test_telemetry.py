"""Span sweep, sketches, one-pass bootstrap and streamed day files."""

import random

import numpy as np
from pyspark.sql import functions as F

from docquarry.operators import statistics, telemetry
from docquarry.sources import readers


def parents(rows):
    out = []
    for t, i, s, d in rows:
        found = [(d2, i2) for t2, i2, s2, d2 in rows if t2 == t and None not in (s, d, s2, d2) and i2 > i and s2 < s and s + d <= s2 + d2]
        out.append((t, i, min(found)[1] if found else None))
    return sorted(out, key=str)


def test_spans_against_all_pairs(spark):
    rng = random.Random(4)
    rows = [(f"t{rng.randrange(4)}", n, float(rng.randrange(60)), float(rng.choice((0, 1, 5, 20, 60)))) for n in range(400)] + [(None, 1, 2.0, 3.0), (None, 2, 1.0, 9.0), ("t1", 900, None, 1.0), ("one", 0, 0.0, 0.0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "trace_id string, idx int, start_ms double, duration_ms double, parent_idx string").repartition(5)
    assert sorted(map(tuple, telemetry.span_parents(df).collect()), key=str) == parents(rows)
    assert telemetry.span_parents(df.limit(0)).collect() == []


def test_sketches_merge(spark):
    rng = np.random.default_rng(1)
    rows = [(g, int(d), float(x)) for g, size in (("a", 20_000), ("b", 300), ("c", 1)) for d, x in zip(rng.integers(0, 9, size), rng.lognormal(3, 2, size))] + [("a", 0, None), ("d", 1, None)]
    df = spark.createDataFrame(rows, "g string, day int, v double")
    daily = telemetry.daily_sketches(df, ["g"], F.col("day"), "v")
    errors = telemetry.rank_errors(df, telemetry.merged_sketches(daily, ["g"]), ["g"], "v", [0.01, 0.5, 0.99]).collect()
    assert len(errors) == 9 and max(r.error for r in errors) <= 0.02 and {(r.g, r.n) for r in errors} == {("a", 20_000), ("b", 300), ("c", 1)}
    some = telemetry.merged_sketches(daily.where("day < 3"), ["g"])  # any range of days
    assert max(r.error for r in telemetry.rank_errors(df.where("day < 3"), some, ["g"], "v", [0.5]).collect()) <= 0.02


def test_bootstrap_in_one_pass(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(0.3, 1, 500)
    df = spark.createDataFrame([(n, float(x), None if n % 5 else 1.0) for n, x in enumerate(a)], "k long, a double, b double").repartition(3)
    means = statistics.replicate_means(df, "k", ["a", "b"], 400)
    rows = means.collect()
    assert len(rows) == 400 and all(r.b == 1.0 for r in rows)
    assert "BroadcastNestedLoopJoin" not in means._jdf.queryExecution().toString() and "CartesianProduct" not in means._jdf.queryExecution().toString()
    i = statistics.replicate_interval(means, "a", 400).first()
    half = 1.96 * a.std() / 500**0.5
    assert abs(i.low - (a.mean() - half)) < 0.03 and abs(i.high - (a.mean() + half)) < 0.03 and i.not_over == 0.0
    weights = spark.range(20_000).select(statistics.poisson_weight(F.lit(7), F.col("id")).alias("w")).groupBy("w").count().collect()
    assert all(abs(r["count"] / 20_000 - np.exp(-1) / np.prod(np.arange(1, r.w + 1))) < 0.02 for r in weights)


def test_a_batch_that_comes_again_leaves_no_second_copy(spark, tmp_path):
    schema = "event_id long, ts timestamp, value double"
    for n in range(3):
        spark.createDataFrame([(n * 10 + k, k) for k in range(10)], "event_id long, k int").select("event_id", F.timestamp_add("HOUR", "k", F.lit("2024-01-01 20:00:00").cast("timestamp")).alias("ts"), F.lit(1.5).alias("value")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for _ in range(2):
        readers.stream_day_files(stream, out, checkpoint)
    rows = readers.read_day_files(spark, out, schema).collect()
    assert len(rows) == 30 and {r.batch for r in rows} == {0, 1, 2} and {str(r.day) for r in rows} == {"2024-01-01", "2024-01-02"}
    again = spark.createDataFrame([(r.event_id, r.ts, r.value) for r in rows if r.batch == 1], schema)
    readers.write_batch(out, "ts", again, 1)
    assert sorted(r.event_id for r in readers.read_day_files(spark, out, schema).collect()) == list(range(30))
