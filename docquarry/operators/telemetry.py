"""Operational measures: cost, span trees, buckets, drift, histograms."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# US dollars for a million tokens in and out.
PRICES = {"gpt-4o-mini": (0.15, 0.60), "gpt-4.1": (2.00, 8.00), "gpt-4.1-mini": (0.40, 1.60), "text-embedding-3-small": (0.02, 0.0)}
LEAST_SHARE = 1e-4


def cost_usd(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Null for a model without a price."""
    price = F.create_map(*(x for m, (a, b) in PRICES.items() for x in (F.lit(m), F.array(F.lit(a), F.lit(b)))))
    p = F.try_element_at(price, model)
    return (tokens_in * F.get(p, F.lit(0)) + tokens_out * F.get(p, F.lit(1))) / 1e6


def upper_median(column: str) -> Column:
    """The element at half the count, without interpolation (evaluation reports), as a double; dashboards interpolate. Distinct values are counted before the shuffle."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}` DESC)")


def span_parents(spans: DataFrame) -> DataFrame:
    """trace_id, idx, parent_idx: the shortest span that is recorded later, starts strictly earlier and ends no earlier (of equals the one recorded first); null for roots.

    Spans are swept by their start, those still open being kept: a span that has ended before another starts cannot
    contain it, nor any that start later. So a trace streams through its task, which holds its open spans at most.
    """
    schema = "trace_id string, idx int, parent_idx int"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trace: object = _NO_TRACE
        open_: list[tuple[float, int, float, float]] = []  # duration, idx, start, end
        for batch in batches:
            rows = [c.to_pylist() for c in batch.columns]
            parents: list[int | None] = []
            for own, idx, start, ms in zip(*rows):
                if own != trace:
                    trace, open_ = own, []
                if start is None or ms is None:
                    parents.append(None)
                    continue
                end = start + ms
                open_ = [s for s in open_ if s[3] >= start]
                parents.append(min((s[:2] for s in open_ if s[1] > idx and s[2] < start and end <= s[3]), default=(0, None))[1])
                open_.append((ms, idx, start, end))
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int32()), pa.array(parents, pa.int32())], ["trace_id", "idx", "parent_idx"])

    source = spans.select("trace_id", F.col("idx").cast("int").alias("idx"), F.col("start_ms").cast("double").alias("start_ms"), F.col("duration_ms").cast("double").alias("duration_ms"))
    return source.repartition("trace_id").sortWithinPartitions("trace_id", "start_ms", "idx").mapInArrow(of, schema)


_NO_TRACE = object()
#: Of a sketch: its accuracy grows with it (a rank error of about 1.3 % at 200).
SKETCH_K = 200


def daily_sketches(df: DataFrame, by: list[str], day: Column, value: str) -> DataFrame:
    """by..., day, n, sketch: a quantile sketch of some kilobytes for each group and day, made in the tasks and merged in the shuffle."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, day.alias("day")).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), SKETCH_K).alias("sketch"))


def merged_sketches(daily: DataFrame, by: list[str]) -> DataFrame:
    """by..., n, days, sketch over all days: any range of days is merged from stored sketches, without the rows."""
    return daily.groupBy(*by).agg(F.sum("n").alias("n"), F.count("*").alias("days"), F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"))


def rank_errors(df: DataFrame, merged: DataFrame, by: list[str], value: str, levels: list[float]) -> DataFrame:
    """by..., level, n, days, estimate, error: how far the exact rank of each estimated quantile is from its level; ties count as far as need be."""
    each = F.array(*(F.struct(F.lit(x).alias("level"), F.kll_sketch_get_quantile_double("sketch", F.lit(x)).alias("estimate")) for x in levels))
    estimates = merged.select(*by, "n", "days", F.inline(each))
    counted = df.where(F.col(value).isNotNull()).join(F.broadcast(estimates), by).groupBy(*by, "level", "n", "days", "estimate")
    ranks = counted.agg(F.count_if(F.col(value) < F.col("estimate")).alias("under"), F.count_if(F.col(value) <= F.col("estimate")).alias("upto"))
    error = F.greatest(F.col("under") / F.col("n") - F.col("level"), F.col("level") - F.col("upto") / F.col("n"), F.lit(0.0))
    return ranks.select(*by, "level", "n", "days", "estimate", error.alias("error"))


def bucket_counts(df: DataFrame, value: str, edges: list[float], by: list[str]) -> DataFrame:
    """by..., edge, n: how many values lie at or under each edge."""
    counts = [F.count_if(F.col(value) <= e).alias(str(i)) for i, e in enumerate(edges)]
    wide = df.groupBy(*by).agg(*counts)
    return wide.select(*by, F.explode(F.array(*(F.struct(F.lit(float(e)).alias("edge"), F.col(str(i)).alias("n")) for i, e in enumerate(edges)))).alias("x")).select(*by, "x.edge", "x.n")


def stability_index(baseline: DataFrame, current: DataFrame, value: str, bins: int = 10, least: int = 20) -> DataFrame:
    """One row: psi over the baseline's quantile bins; null if either side has fewer than `least` values. The edges are a dozen numbers."""
    steps = F.array(*(F.lit(i / bins) for i in range(bins + 1)))
    edges = baseline.select(F.percentile(value, steps).alias("e")).select(F.array_distinct("e").alias("e"))
    # inner edges only: the first and last bins are open
    inner = edges.select(F.slice("e", 2, F.greatest(F.size("e") - 2, F.lit(0))).alias("inner"))

    def shares(df: DataFrame, name: str) -> DataFrame:
        placed = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(inner)).select(F.size(F.filter("inner", lambda e: e <= F.col(value))).alias("bin"))
        return placed.groupBy("bin").agg(F.count("*").alias(name))

    all_bins = inner.select(F.explode(F.sequence(F.lit(0), F.size("inner"))).alias("bin"))
    both = all_bins.join(shares(baseline, "b"), "bin", "left").join(shares(current, "c"), "bin", "left").fillna(0, ["b", "c"])
    totals = both.agg(F.sum("b").alias("nb"), F.sum("c").alias("nc"))
    part = lambda n, total: F.greatest(F.try_divide(F.col(n), F.col(total)), F.lit(LEAST_SHARE))
    b, c = part("b", "nb"), part("c", "nc")
    return both.crossJoin(F.broadcast(totals)).agg(F.when((F.max("nb") >= least) & (F.max("nc") >= least), F.round(F.sum((c - b) * F.ln(c / b)), 6)).alias("psi"))


def equal_bins(df: DataFrame, value: str, bins: int, by: list[str]) -> DataFrame:
    """by..., bin, n over `bins` equal bins from floor(min) to ceil(max) of all rows; the top edge is in the last bin."""
    span = df.agg(F.floor(F.min(value)).cast("double").alias("lo"), F.ceil(F.max(value)).cast("double").alias("hi"))
    at = F.least(F.width_bucket(F.col(value), F.col("lo"), F.col("hi"), F.lit(bins)), F.lit(bins))
    return df.crossJoin(F.broadcast(span)).groupBy(*by, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
