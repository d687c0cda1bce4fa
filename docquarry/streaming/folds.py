"""Stateful operators as folds over events in order: the same step serves batches and streams.

A fold has a first state and a step (state, event) -> (state, result). Batches are folded key by key in Arrow
batches of rows sorted by key and time; streams keep the state between micro-batches with transformWithState.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fold:
    start: Callable[[], dict]
    step: Callable[[dict, dict], tuple[dict, dict]]
    schema: str  # of the results


def run(events: DataFrame, fold: Fold, key: str, order: list[str]) -> DataFrame:
    """Rows of `events` with the results, state by key. Keys are sorted within hash partitions and streamed, so a hot key is never held at once."""
    names, kinds = events.columns, {f.name: f.dataType.simpleString() for f in events.schema}
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", " + fold.schema

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), {}
        for pdf in frames:
            results = []
            for row in pdf.to_dict("records"):
                own = None if pd.isna(row[key]) else row[key]  # null keys are one key, as in a stream
                if own != now:
                    now, state = own, fold.start()
                state, out = fold.step(state, row)
                results.append(out)
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(results)], axis=1) if results else pdf.iloc[:0]

    return events.repartition(key).sortWithinPartitions(key, *order).mapInPandas(of, schema)


def run_stream(events: DataFrame, fold: Fold, key: str, order: list[str]) -> DataFrame:
    """The same over a stream: state in the state store as JSON, events of a micro-batch in order."""
    from pyspark.sql.streaming import StatefulProcessor

    names, kinds = events.columns, {f.name: f.dataType.simpleString() for f in events.schema}
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", " + fold.schema

    class Keeper(StatefulProcessor):
        def init(self, handle):
            self.kept = handle.getValueState("state", "json string")

        def handleInputRows(self, key_, rows, timers):  # noqa: N802  the interface's name
            state = json.loads(self.kept.get()[0]) if self.kept.exists() else fold.start()
            pdf = pd.concat(list(rows)).sort_values(order)
            results = []
            for row in pdf.to_dict("records"):
                state, out = fold.step(state, row)
                results.append(out)
            self.kept.update((json.dumps(state),))
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(results)], axis=1)[[*names, *results[0]]]

        def close(self):
            pass

    return events.groupBy(key).transformWithStateInPandas(Keeper(), schema, "Append", "None")


def token_bucket(time: str = "t", rpm: str = "rpm") -> Fold:
    """allowed, retry_after: rate rpm / 60 a second, burst of ten seconds but one at least."""

    def step(s: dict, e: dict) -> tuple[dict, dict]:
        rate, capacity = e[rpm] / 60, max(1.0, e[rpm] / 6)
        left = capacity if "left" not in s else min(capacity, s["left"] + (e[time] - s["at"]) * rate)
        ok = left >= 1
        return {"left": left - ok, "at": e[time]}, {"allowed": bool(ok), "retry_after": 0.0 if ok else (1 - left) / rate}

    return Fold(dict, step, "allowed boolean, retry_after double")


def spend_limit(limit: str = "limit_usd", estimate: str = "estimate", actual: str = "actual", day: str = "day") -> Fold:
    """granted, spent: the estimate is reserved for the day it is asked on, then settled to the actual cost of that day."""

    def step(s: dict, e: dict) -> tuple[dict, dict]:
        spent = s["spent"] if s.get("day") == e[day] else 0.0
        ok = spent + e[estimate] <= e[limit] + 1e-12
        spent += e[actual] if ok else 0.0
        return {"day": e[day], "spent": spent}, {"granted": bool(ok), "spent": spent}

    return Fold(dict, step, "granted boolean, spent double")


def circuit_breaker(time: str = "t", failed: str = "failed", threshold: int = 3, cooldown: float = 30.0) -> Fold:
    """allowed, state: open after `threshold` failures in a row for `cooldown` seconds, then one trial; a failed trial opens it again."""

    def step(s: dict, e: dict) -> tuple[dict, dict]:
        failures, opened = s.get("failures", 0), s.get("opened")
        state = "closed" if opened is None else "half_open" if e[time] - opened >= cooldown else "open"
        if state != "open":
            if e[failed]:
                failures += 1
                opened = e[time] if failures >= threshold or opened is not None else None
            else:
                failures, opened = 0, None
        return {"failures": failures, "opened": opened}, {"allowed": state != "open", "state": state}

    return Fold(dict, step, "allowed boolean, state string")


def ttl_cache(time: str = "t", item: str = "question", most: int = 10_000, ttl: float = 86_400.0) -> Fold:
    """hit: the item was put within `ttl` seconds and is among the `most` last used."""

    def step(s: dict, e: dict) -> tuple[dict, dict]:
        kept = dict(s.get("kept", {}))
        put = kept.pop(e[item], None)
        hit = put is not None and e[time] - put <= ttl
        kept[e[item]] = put if hit else e[time]
        while len(kept) > most:
            kept.pop(next(iter(kept)))
        return {"kept": kept}, {"hit": bool(hit)}

    return Fold(dict, step, "hit boolean")


def semantic_cache(vector: str = "vector", signature: str = "signature", item: str = "item", threshold: float = 0.95, most: int = 1000) -> Fold:
    """hit_item, similarity: the nearest stored vector (unit length) of the same signature, if it is at `threshold` or more. What misses is stored, and the oldest goes beyond `most`. The key is the scope: scopes share nothing."""

    def step(s: dict, e: dict) -> tuple[dict, dict]:
        kept = s.get("kept", [])
        own = [float(x) for x in e[vector]]
        near = [(sum(a * b for a, b in zip(own, v)), -n, i) for n, (sig, v, i) in enumerate(kept) if sig == e[signature]]
        similarity, _, found = max(near, default=(None, 0, None), key=lambda x: x[:2])
        hit = similarity is not None and similarity >= threshold
        if not hit:
            kept = [*kept, [e[signature], own, e[item]]][-most:]
        return {"kept": kept}, {"hit_item": found if hit else None, "similarity": round(similarity, 6) if hit else None}

    return Fold(dict, step, "hit_item string, similarity double")


def admission(allowed: list[str], most_calls: int = 12, similar: float = 0.8) -> Fold:
    """decision for each tool call: off the list, over budget, a near-repeat (same tool and arguments, word sets of Jaccard `similar` or more), or admitted. A refused call is not remembered."""
    import re

    def step(s: dict, e: dict) -> tuple[dict, dict]:
        seen = s.get("seen", [])
        words = sorted(set(re.findall("[a-z0-9]+", e["query"].lower())))
        if e["tool"] not in allowed:
            decision = "not allowed"
        elif len(seen) >= most_calls:
            decision = "budget"
        else:
            def alike(w: list[str]) -> bool:
                both = len(set(words) & set(w))
                return w == words or bool(words and w and both / (len(words) + len(w) - both) >= similar)

            decision = "repeat" if any(k == [e["tool"], e["args"]] and alike(w) for k, w in seen) else "admitted"
        if decision == "admitted":
            seen = [*seen, [[e["tool"], e["args"]], words]]
        return {"seen": seen}, {"decision": decision}

    return Fold(dict, step, "decision string")


def windowed_latency(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Requests, errors and mean value by event type and window of event time, with a watermark. An addition: the stages of an event log as a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    grouped = timed.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")
