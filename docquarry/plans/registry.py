"""Queries by name, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators.postings import Postings
from docquarry.session import scratch

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_indexes: dict[tuple[str, str], Postings] = {}


def search_postings(spark: SparkSession, sf_dir: str) -> Postings:
    """The stored index of every document with its language, its source, the year that its source stands for, and its kind (those with figures stand for tables), written once for each application and folder and read by its searches."""
    name = (spark.sparkContext.applicationId, sf_dir)
    if name not in _indexes:
        docs = table(spark, sf_dir, "documents").withColumn("kind", F.when(F.col("text").rlike("[0-9]"), F.lit("table")).otherwise(F.lit("prose"))).withColumn("year", F.lit(2000) + F.substring("source", 4, 9).cast("int"))
        _indexes[name] = Postings.write(docs, scratch(spark, "index"), keep=("lang", "source", "kind", "year"))
    return _indexes[name]


def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, toks, words (the tokens, joined), lang, source of every document in the stored index."""
    return search_postings(spark, sf_dir).docs.select("doc_id", "toks", "words", "lang", "source")


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float)):
        return repr(x)
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(_literal, x)) + "]"
    return "'" + str(x).replace("'", "''") + "'"


class Fixture:
    """A few literal rows, as a DataFrame and as SQL."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows
        self.columns = [c.strip().split(" ")[0] for c in _fields(schema)]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def sql(self) -> str:
        kinds = [_duck_type(c.strip().split(" ", 1)[1]) for c in _fields(self.schema)]
        rows = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in self.rows)
        casts = ", ".join(f"CAST({c} AS {k}) AS {c}" for c, k in zip(self.columns, kinds))
        return f"(SELECT {casts} FROM (VALUES {rows}) AS _v({', '.join(self.columns)}))"


def _fields(schema: str) -> list[str]:
    out, depth = [""], 0
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


def _duck_type(kind: str) -> str:
    kind = kind.strip().lower()
    if kind.startswith("array<"):
        return _duck_type(kind[6:-1]) + "[]"
    return {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}[kind]
