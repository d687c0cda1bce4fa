"""Connected components of a link table, without gathering links on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import checkpointed


def _with_least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) and the least v of each u. The minimum is combined before the shuffle; the join back may be split where u is hot."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u")


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest reachable node) for every node of a link between different nodes.

    Alternating stars: every node hangs its larger neighbours under its least neighbour, then its smaller
    neighbours and itself under the least of them, until nothing changes; the rounds grow with the logarithm
    of the longest chain. Each round is checkpointed. Self links and nulls are ignored; no links give no rows.
    """
    edges = checkpointed(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    )

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    was = mark(edges)
    for _ in range(most_rounds if was[0] else 0):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        small = _with_least(large.where("u != v").distinct())
        edges = checkpointed(
            small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        )
        now = mark(edges)
        if now == was:
            break
        was = now
    else:
        if was[0]:
            raise RuntimeError("the links did not settle; raise most_rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
