"""Session settings, and cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of ids (some tens of bytes each) that are broadcast at most.
BROADCAST_ROWS = 200_000


def session(app: str = "docquarry", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution on; other settings are the caller's."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.master(master) if master else builder
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset a local session takes a temporary folder, and a cluster, whose machines share none, is an error."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="docquarry-checkpoint-")
        spark.sparkContext.setCheckpointDir(known)
    return known


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A table of ids that was written already: broadcast if its rows are counted to be few, so that the other side of its join, texts as a rule, is not shuffled."""
    return F.broadcast(df) if df.count() <= most else df


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder. What is written there is not removed: its readers may be lazy."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def union(*frames: DataFrame) -> DataFrame:
    """The rows of all frames.

    Spark 4.1 takes a union of inputs that are dealt out alike as dealt out itself. In unions of unions adaptive
    execution merges the inputs' partitions differently, so that does not hold, and what is grouped or joined above
    comes out wrong (rows of one group are not merged). The session is told not to rely on it; rows do not change.
    """
    frames[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return reduce(DataFrame.unionByName, frames)
