"""Reports against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from docquarry.operators import reports, telemetry


def test_exported_attributes_are_redacted_before_they_are_cut(spark):
    long = "x" * 3990 + " a@b.co " + "y" * 50
    rows = [(1, long, 4111111111111111, ["a@b.co", "c"], None, True), (2, None, None, None, 0.5, None), (3, "", 0, [], 1.0, False)]
    df = spark.createDataFrame(rows, "key long, text string, n long, odd array<string>, `a ``b` double, flag boolean")
    got = {(r.key, r.name): r.value for r in reports.export_attributes(df, "key", {"text": "rag.text"}).collect()}
    assert got == {
        (1, "rag.text"): ("x" * 3990 + " [EMAIL] " + "y" * 50)[:4000], (1, "n"): "4111111111111111", (1, "odd"): '["[EMAIL]","c"]', (1, "flag"): "true",
        (2, "a `b"): "0.5", (3, "rag.text"): "", (3, "n"): "0", (3, "odd"): "[]", (3, "a `b"): "1.0", (3, "flag"): "false",
    }
    assert reports.export_attributes(df.where("key > 9"), "key").collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 10, 11])
def test_upper_median(spark, n):
    rng = random.Random(n)
    values = [float(rng.randrange(5)) for _ in range(n)]
    df = spark.createDataFrame([(x,) for x in [*values, None]], "v double").repartition(3)
    assert df.agg(telemetry.upper_median("v")).first()[0] == sorted(values)[n // 2]


def test_threshold_sweep_like_python(spark):
    rng = random.Random(4)
    pairs = [(rng.random() < 0.5, rng.randrange(11) / 10, rng.random() < 0.6) for _ in range(80)]
    got = reports.threshold_sweep(spark.createDataFrame(pairs, "same boolean, similarity double, agrees boolean").repartition(3), [0.2, 0.9, 2.0]).collect()
    assert len(got) == 6
    for r in got:
        hits = [same for same, x, agrees in pairs if x >= r.threshold and (agrees or not r.guarded)]
        assert (r.right, r.wrong) == (sum(hits), len(hits) - sum(hits))
        assert r.precision == (round(sum(hits) / len(hits), 6) if hits else None)
        assert r.recall == round(sum(hits) / sum(p[0] for p in pairs), 6)


def test_load_report_without_tokens_and_approximate(spark):
    rows = [("a", float(i), 2.0 + i, None, i % 2 == 0, None) for i in range(5)] + [("b", 1.0, 1.0, 0.5, True, "exact")]
    df = spark.createDataFrame(rows, "s string, at double, total double, ttft double, ok boolean, cache string")
    for accuracy in (None, 10_000):
        got = {r.s: r for r in reports.load_report(df, "s", accuracy).collect()}
        assert (got["a"].n, got["a"].ok, got["a"].cache_hits, got["a"].throughput_rps, got["a"].p50_s, got["a"].ttft_p50_s) == (5, 3, 0, 0.5, 4.0, None)
        assert (got["b"].cache_hits, got["b"].ttft_p95_s) == (1, 0.5)


def test_answer_runs_without_hits_or_trace(spark):
    runs = spark.createDataFrame([(1, "x [2] [2] [7]"), (2, None), (3, "y [9]")], "run long, answer string")
    hits = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (3, 2, "d"), (3, 1, "c")], "run long, n int, source string")
    spans = spark.createDataFrame([(1, 10, 0.1), (1, None, 0.2), (2, 0, None)], "run long, input_tokens long, cost_usd double")
    got = {r.run: tuple(r)[1:] for r in reports.answer_runs(runs, hits, spans).collect()}
    assert got == {1: (2, "b", 0.3, 10, 1), 2: (0, "", 0.0, 0, 0), 3: (2, "c, d", None, None, None)}


def test_gate_and_refusals_without_rows(spark):
    none = spark.createDataFrame([], "metric string, ok boolean")
    assert tuple(reports.gate_outcome(none).first()) == (0, True, "")
    cases = spark.createDataFrame([], "should_refuse boolean, refused boolean")
    assert tuple(reports.refusal_scores(cases).first()) == (0, 0, 0, None, None)


def test_a_trace_counts_rows_without_another_job(spark, tmp_path):
    trace = reports.Trace(spark, "t", "n")
    out = trace.stage("some", spark.range(100).where(F.col("id") % 3 == 0), str(tmp_path / "some"))
    assert out.count() == 34
    row = trace.rows().first()
    assert (row.trace_id, row.name, row.idx, row.stage, row.rows) == ("t", "n", 0, "some", 34) and row.duration_ms > 0
