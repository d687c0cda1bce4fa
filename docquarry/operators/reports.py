"""Reports on runs: load tests, caches, refusals, verdicts, behaviour, gates, golden items, and a trace of a batch's stages."""

from __future__ import annotations

import time
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import pii
from docquarry.functions import text as T
from docquarry.operators.blocks import in_arrow
from docquarry.operators.telemetry import upper_median

#: Characters of an exported attribute.
MOST_CHARACTERS = 4000
#: Characters of a quote that can be evidence.
LEAST_EVIDENCE = 20


def _percentile(column: str, p: float, accuracy: int | None) -> Column:
    return F.percentile(column, F.lit(p)) if accuracy is None else F.percentile_approx(column, p, accuracy)


def load_report(requests: DataFrame, by: str, accuracy: int | None = None) -> DataFrame:
    """requests: by, at (seconds), total, ttft (seconds, null without a token), ok, cache (exact, semantic or null).

    One row a scenario. Percentiles interpolate and keep a scenario's distinct values; with an accuracy they are approximate and bounded.
    """
    p = lambda column, x: F.round(_percentile(column, x, accuracy), 2)
    wall = F.max(F.col("at") + F.col("total")) - F.min("at")
    return requests.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if("ok").alias("ok"), F.count_if(F.col("cache").isin("exact", "semantic")).alias("cache_hits"), F.round(F.try_divide(F.count("*"), wall), 2).alias("throughput_rps"),
        p("total", 0.5).alias("p50_s"), p("total", 0.95).alias("p95_s"), p("ttft", 0.5).alias("ttft_p50_s"), p("ttft", 0.95).alias("ttft_p95_s"),
    )


def export_attributes(df: DataFrame, key: str, names: dict[str, str] | None = None) -> DataFrame:
    """key, name, value: each column of df as an attribute that may leave.

    Nulls are dropped, structs, arrays and maps become JSON, personal data in texts and JSON is redacted, texts are cut
    at MOST_CHARACTERS after that, and columns in `names` are renamed.
    """
    each = []
    for f in df.schema.fields:
        if f.name != key:
            kind, c = f.dataType.simpleString(), F.col(f"`{f.name.replace('`', '``')}`")
            nested = kind.startswith(("struct<", "array<", "map<"))
            each.append(F.struct(F.lit((names or {}).get(f.name, f.name)).alias("name"), (F.to_json(c) if nested else c.cast("string")).alias("value"), F.lit(nested or kind == "string").alias("said")))
    rows = df.select(key, F.explode(F.array(*each)).alias("x")).select(key, "x.*").where("value IS NOT NULL")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [pii.redact(v)[0][:MOST_CHARACTERS] if said else v for v, said in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.string())], [key, "name", "value"])

    return in_arrow(rows, of, f"{key} {df.schema[key].dataType.simpleString()}, name string, value string")


def threshold_sweep(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """pairs: same (the answer is the same), similarity, agrees (the guard lets it through).

    For each threshold, without and with the guard: right and wrong hits, precision (null without hits) and recall.
    One pass over the pairs; the thresholds are columns.
    """
    counts, out = [F.count_if("same").alias("n")], []
    for i, t in enumerate(thresholds):
        for guarded in (False, True):
            hit = (F.col("similarity") >= t) & (F.col("agrees") if guarded else F.lit(True))
            right, wrong = f"right{i}{guarded}", f"wrong{i}{guarded}"
            counts += [F.count_if(hit & F.col("same")).alias(right), F.count_if(hit & ~F.col("same")).alias(wrong)]
            precision, recall = F.try_divide(F.col(right), F.col(right) + F.col(wrong)), F.try_divide(F.col(right), F.col("n"))
            out.append(F.struct(F.lit(float(t)).alias("threshold"), F.lit(guarded).alias("guarded"), F.col(right).alias("right"), F.col(wrong).alias("wrong"), F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall")))
    return pairs.agg(*counts).select(F.inline(F.array(*out)))


def guard_blocks(pairs: DataFrame, by: str) -> DataFrame:
    """by, same, n, median similarity, and how many pairs the guard blocks."""
    return pairs.groupBy(by, "same").agg(F.count("*").alias("n"), F.round(F.percentile("similarity", F.lit(0.5)), 6).alias("median"), F.count_if(~F.col("agrees")).alias("blocked"))


def refusal_scores(cases: DataFrame) -> DataFrame:
    """cases: should_refuse, refused. One row: right, false and missed refusals, precision and recall (null where there is nothing to divide by)."""
    right, false, missed = F.col("right"), F.col("false_refusals"), F.col("missed")
    c = cases.agg(F.count_if(F.col("should_refuse") & F.col("refused")).alias("right"), F.count_if(~F.col("should_refuse") & F.col("refused")).alias("false_refusals"), F.count_if(F.col("should_refuse") & ~F.col("refused")).alias("missed"))
    return c.withColumn("precision", F.round(F.try_divide(right, right + false), 6)).withColumn("recall", F.round(F.try_divide(right, right + missed), 6))


def verdicts(runs: DataFrame) -> DataFrame:
    """runs: pipeline, verdict, numbers_ok (null where the reference has no figures).

    pipeline, verdict, n, share, and of those with figures how many have them all and how often that agrees with the verdict.
    """
    total = runs.groupBy("pipeline").agg(F.count("*").alias("total"))
    correct = F.col("verdict") == "correct"
    each = runs.groupBy("pipeline", "verdict").agg(F.count("*").alias("n"), F.count("numbers_ok").alias("with_figures"), F.count_if("numbers_ok").alias("figures_present"), F.count_if(F.col("numbers_ok") == correct).alias("agrees"))
    return each.join(F.broadcast(total), "pipeline").select("pipeline", "verdict", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), "with_figures", "figures_present", "agrees")


def behaviour(runs: DataFrame, *by: str) -> DataFrame:
    """runs: by..., llm_calls, prompt_tokens, cost_usd (means leave nulls out), latency_s: what a run costs on average."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return runs.groupBy(*by).agg(F.count("*").alias("n"), mean("llm_calls").alias("calls"), mean("prompt_tokens").alias("tokens"), mean("cost_usd").alias("usd"), F.round(upper_median("latency_s"), 6).alias("p50"))


def stop_reasons(runs: DataFrame, stops: DataFrame, run: str) -> DataFrame:
    """reason, runs: why runs ended; one without a stop answered."""
    return runs.select(run).distinct().join(stops.select(run, "reason"), run, "left").groupBy(F.coalesce("reason", F.lit("answered")).alias("reason")).agg(F.count("*").alias("runs"))


def gate_outcome(gated: DataFrame) -> DataFrame:
    """One row over a regression gate's metrics: passed, and the failed ones in order of name. Without metrics it has passed."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("metric"))))
    return gated.agg(F.count("*").alias("metrics"), failed.alias("f")).select("metrics", (F.size("f") == 0).alias("passed"), F.array_join("f", ", ").alias("failed"))


def answer_runs(runs: DataFrame, hits: DataFrame, spans: DataFrame) -> DataFrame:
    """runs: run, answer; hits: run, n (place in the context), source; spans: run, input_tokens, cost_usd.

    run, n_evidence, passages (sources that the answer cites, in order; all of them if it cites none there is), and
    from the trace cost_usd, prompt_tokens and llm_calls (spans with input tokens); these are null without a trace.
    """
    cited = runs.select("run", F.explode(T.citations(F.col("answer"))).alias("n")).withColumn("cited", F.lit(True))
    met = hits.join(cited, ["run", "n"], "left")
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda s: s["source"])
    place = F.struct("n", "source")
    evidence = met.groupBy("run").agg(F.count("*").alias("n_evidence"), in_order(F.when(F.col("cited"), place)).alias("some"), in_order(place).alias("every"))
    spent = spans.groupBy("run").agg(F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("cost_usd"), F.sum(F.coalesce("input_tokens", F.lit(0))).alias("prompt_tokens"), F.count_if(F.col("input_tokens") > 0).alias("llm_calls"))
    passages = F.array_join(F.when(F.size("some") > 0, F.col("some")).otherwise(F.col("every")), ", ")
    out = runs.select("run").join(evidence, "run", "left").join(spent, "run", "left")
    return out.select("run", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), F.coalesce(passages, F.lit("")).alias("passages"), F.round("cost_usd", 9).alias("cost_usd"), "prompt_tokens", "llm_calls")


def golden_outcomes(items: DataFrame, passages: DataFrame) -> DataFrame:
    """items: item, passage_id, usable, kind (numeric or text), answer, evidence; passages: passage_id, text.

    item, outcome: unusable, bad_evidence (the quote is short or not in its passage, white space aside), bad_numbers
    (a numeric answer has no figures, or others than the quote), or kept.
    """
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    quote, said = flat(F.col("evidence")), T.numbers(F.coalesce("answer", F.lit("")))
    known = T.numbers(F.coalesce("evidence", F.lit("")), skip_trivial=False)
    found = (F.length(quote) >= LEAST_EVIDENCE) & F.contains(flat(F.col("text")), quote)
    figures = (F.col("kind") != "numeric") | ((F.size(said) > 0) & (F.size(F.array_except(said, known)) == 0))
    outcome = F.when(~F.col("usable"), F.lit("unusable")).when(~found, F.lit("bad_evidence")).when(~figures, F.lit("bad_numbers")).otherwise(F.lit("kept"))
    return items.join(passages.select("passage_id", "text"), "passage_id", "left").select("item", outcome.alias("outcome"))


def estimate_errors(estimates: DataFrame, by: str) -> DataFrame:
    """estimates: by, estimate, actual. n, the median, least and greatest relative error, and the actual sizes' median, 95th percentile and maximum; rows without an actual size do not count."""
    e = estimates.where("actual > 0").withColumn("error", (F.col("estimate") - F.col("actual")) / F.col("actual"))
    return e.groupBy(by).agg(
        F.count("*").alias("n"), F.round(upper_median("error"), 6).alias("error"), F.round(F.min("error"), 6).alias("least"), F.round(F.max("error"), 6).alias("most"),
        upper_median("actual").cast("long").alias("actual"), F.round(F.percentile("actual", F.lit(0.95)), 6).alias("p95"), F.max("actual").alias("longest"),
    )


class Trace:
    """Records a row a stage of a batch: its name, when it began, how long it took, and how many rows it gave.

    A stage's rows are counted by the job that computes them (an observation), not by a job of their own.
    """

    def __init__(self, spark: SparkSession, trace_id: str, name: str):
        self._spark, self._trace_id, self._name, self._rows = spark, trace_id, name, []

    def stage(self, name: str, df: DataFrame, path: str) -> DataFrame:
        """df, computed now, written to path and read again."""
        counted, began, clock = Observation(f"{self._trace_id}-{len(self._rows)}"), datetime.now(timezone.utc), time.perf_counter()
        df.observe(counted, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        self._rows.append((self._trace_id, self._name, len(self._rows), name, began.isoformat(), (time.perf_counter() - clock) * 1000, counted.get["rows"]))
        return self._spark.read.schema(df.schema).parquet(path)

    def rows(self) -> DataFrame:
        return self._spark.createDataFrame(self._rows, "trace_id string, name string, idx int, stage string, started_at string, duration_ms double, rows long")
