"""Personal data in texts: spans by type, without overlaps, and redaction."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from docquarry.operators.blocks import bounded, in_arrow

# A pattern for each type.
PATTERNS = {
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "SSN": r"\b(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b",
    "CARD": r"\b(?:\d[ -]?){12,18}\d\b",
    "PHONE": r"(?<![\w$.,])(?:\+?1[ .-]?)?\(?\b\d{3}\)?[ .-]\d{3}[ .-]\d{4}\b(?![.,]?\d)",
    "IBAN": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "IP": r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b",
}
_COMPILED = {k: re.compile(p) for k, p in PATTERNS.items()}
_ASCII = {k: re.compile(p, re.ASCII) for k, p in PATTERNS.items()}


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def spans(text: str) -> list[tuple[int, int, str]]:
    """start, end, type: earliest first, the longest of those that start together, none overlapping."""
    found = []
    for kind, pattern in _COMPILED.items():
        for m in pattern.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if kind != "CARD" or 13 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), kind))
    out, free = [], 0
    for start, end, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        if start >= free:
            out.append((start, end, kind))
            free = end
    return out


def redact(text: str) -> tuple[str, list[str]]:
    """The text with each span as [TYPE], and the types in order; values never leave."""
    out, at, kinds = [], 0, []
    for start, end, kind in spans(text):
        out += [text[at:start], f"[{kind}]"]
        kinds.append(kind)
        at = end
    return "".join(out) + text[at:], kinds


def redacted(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, redacted, kinds (array) of every row; Arrow batches, nulls stay null."""
    kind = df.schema[key].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            done = [(None, []) if t is None else redact(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.list_(pa.string()))], [key, "redacted", "kinds"])

    return in_arrow(df.select(key, text), of, f"{key} {kind}, redacted string, kinds array<string>")


def matched(df: DataFrame, key: str, text: str, kinds: tuple[str, ...]) -> DataFrame:
    """key and for each kind how often its own pattern matches, with ASCII digits and word edges as in SQL, whatever other kinds overlap it; nulls stay null."""
    kind = df.schema[key].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            texts = batch.column(1).to_pylist()
            counts = [pa.array([None if t is None else sum(1 for _ in _ASCII[k].finditer(t)) for t in texts], pa.int64()) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts], [key, *kinds])

    return in_arrow(df.select(key, text), of, ", ".join([f"{key} {kind}", *(f"{k} long" for k in kinds)]))
