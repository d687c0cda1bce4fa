"""Relations between organisations: resolution, mutual edges, shared neighbours, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Legal endings and other names of organisations.
LEGAL = r"(?i)(?:\s+(?:inc|incorporated|corp|corporation|company|co|ltd|llc|plc|limited|holdings))+$"
OTHER_NAMES = {
    "alphabet": "Google", "google": "Google", "google cloud": "Google", "amazon web services": "Amazon", "aws": "Amazon", "amazon": "Amazon", "microsoft": "Microsoft", "azure": "Microsoft", "apple": "Apple",
    "nvidia": "NVIDIA", "tesla": "Tesla", "taiwan semiconductor manufacturing company": "TSMC", "taiwan semiconductor manufacturing": "TSMC", "tsmc": "TSMC", "meta platforms": "Meta", "meta": "Meta", "facebook": "Meta",
    "advanced micro devices": "AMD", "amd": "AMD", "intel": "Intel", "openai": "OpenAI", "samsung": "Samsung", "samsung electronics": "Samsung", "huawei": "Huawei", "byd": "BYD", "hon hai precision industry": "Foxconn", "foxconn": "Foxconn",
    "contemporary amperex technology": "CATL", "space exploration technologies": "SpaceX", "xai": "xAI", "salesforce": "Salesforce", "oracle": "Oracle", "ibm": "IBM",
}


def resolve(name: Column) -> Column:
    """Parentheses, punctuation and legal endings off, then the known name."""
    n = F.trim(F.regexp_replace(F.regexp_replace(name, "[.,]", ""), r"\s*\([^)]*\)", ""))
    n = F.regexp_replace(n, LEGAL, "")
    known = F.create_map(*(F.lit(x) for kv in OTHER_NAMES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, F.lower(n)), n)


def usable_triples(raw: DataFrame) -> DataFrame:
    """Companies only: no generic (lower-case) objects, no parts of the filer, no self edges after resolution."""
    r = raw.where("kind = 'company' AND NOT part_of_filer").where(~F.col("raw").rlike(r"^\p{Ll}")).withColumn("object", resolve(F.col("raw")))
    return r.where(F.col("object") != F.col("subject"))


def mutual(edges: DataFrame) -> DataFrame:
    """a, b, both_ways for each linked pair a < b."""
    pairs = edges.select(F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b"), (F.col("subject") < F.col("object")).alias("forward")).where("a != b")
    return pairs.groupBy("a", "b").agg((F.max("forward") & F.max(~F.col("forward"))).alias("both_ways"), F.count("*").alias("links"))


def mutual_sources(edges: DataFrame) -> DataFrame:
    """a, b, way, source: each linked pair a < b, who names whom, and a row for each source of either edge."""
    forward = F.col("subject") < F.col("object")
    pairs = edges.where("subject != object").select(F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b"), forward.alias("forward"), "source")
    ways = pairs.groupBy("a", "b").agg(F.max("forward").alias("f"), F.max(~F.col("forward")).alias("r"))
    way = F.when(F.col("f") & F.col("r"), F.lit("both ways")).when(F.col("f"), F.concat("a", F.lit(" names "), "b")).otherwise(F.concat("b", F.lit(" names "), "a"))
    return pairs.select("a", "b", "source").distinct().join(ways, ["a", "b"]).select("a", "b", way.alias("way"), "source")


def shared_neighbours(edges: DataFrame, least: int = 2) -> DataFrame:
    """object, n, subjects (sorted) of objects that `least` or more subjects name."""
    g = edges.groupBy("object").agg(F.array_sort(F.collect_set("subject")).alias("subjects"))
    return g.withColumn("n", F.size("subjects").cast("long")).where(F.col("n") >= least)


def lookup(edges: DataFrame, subject: str | None, relation: str | None, part: str | None, most: int = 25) -> DataFrame:
    """Up to `most` matching edges, and in more how many are left out."""
    e = edges
    if subject is not None:
        e = e.where(F.col("subject") == subject)
    if relation is not None:
        e = e.where(F.col("relation") == relation)
    if part is not None:
        e = e.where(F.lower("object").contains(part.lower()))
    order = Window.orderBy("subject", "relation", "object")
    total = e.agg(F.count("*").alias("total"))
    top = e.orderBy("subject", "relation", "object").limit(most).withColumn("row", F.row_number().over(order))
    return top.crossJoin(F.broadcast(total)).select("subject", "relation", "object", "row", F.greatest(F.col("total") - most, F.lit(0)).alias("more"))
