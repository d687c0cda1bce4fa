"""Searches of many queries against all rows: queries go out in blocks, and each task keeps its best rows only."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from docquarry.session import checkpointed, union

#: Bytes of Arrow data that Python objects are made of at a time.
BYTES_AT_A_TIME = 1 << 20
#: Bytes of a batch that Spark sends to a worker at most; its own bound is 64 MB, and a worker has up to two batches of each step.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(rows: DataFrame) -> DataFrame:
    """rows, whose Python steps get batches of BATCH_BYTES at most, or fewer if the session asks for fewer; the session keeps the bound, as plans look it up when they run."""
    conf = rows.sparkSession.conf
    now = conf.get(_BATCH).rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(_BATCH, f"{BATCH_BYTES}b")
    return rows


def in_arrow(rows: DataFrame, of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """rows.mapInArrow in small batches."""
    return in_small_batches(rows).mapInArrow(of, schema)


def bounded(batches: Iterator[pa.RecordBatch], size: int = BYTES_AT_A_TIME) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in their order, in batches of at most `size` bytes, or of one row."""
    for whole in batches:
        rest = [whole]
        while rest:
            batch = rest.pop()
            if batch.num_rows > 1 and batch.nbytes > size:
                half = batch.num_rows // 2
                rest += [batch.slice(half), batch.slice(0, half)]
            else:
                yield batch


def in_blocks(rows: Iterator, size: int, search: Callable[[list], DataFrame]) -> DataFrame | None:
    """The results of all blocks of `size` queries; None without queries.

    The driver holds one block and the next. Where there are several, each block's result is written before the
    one after it is searched.
    """
    block, out = list(islice(rows, size)), None
    while block:
        following = list(islice(rows, size))
        found = search(block)
        if out is not None or following:
            found = checkpointed(found)
        out = found if out is None else union(out, found)
        block = following
    return out


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(df.schema[column].dataType)


class Best:
    """The k best (score, then smaller key) of each of `n` queries, over all that was added."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.query, self.key, self.score = np.empty(0, np.int64), None, np.empty(0)

    def add(self, scores: np.ndarray, keys: np.ndarray, queries: np.ndarray | None = None, places: int | None = None) -> None:
        """scores[query, row], of all queries or of some; what is not finite is no candidate. places: positive scores are candidates only, and are rounded to so many places, which is done for those few that may be among the best."""
        k, least = self.k, self.least if queries is None else self.least[queries]
        if scores.shape[1] > 4 * k and np.isinf(least).any():
            least = np.maximum(least, np.partition(scores, scores.shape[1] - k, axis=1)[:, -k])
        if places is None:
            query, row = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
            score = scores[query, row]
        else:
            unit = 10.0**-places  # rounding changes no order, but makes equals of scores less than this apart
            query, row = np.nonzero(scores >= np.maximum(least - unit, unit / 4)[:, None])
            score = np.round(scores[query, row], places)
            some = score > 0
            query, row, score = query[some], row[some], score[some]
        if not len(query):
            return
        key = keys[row] if self.key is None else np.concatenate((self.key, keys[row]))
        score, query = np.concatenate((self.score, score)), np.concatenate((self.query, query if queries is None else queries[query]))
        order = np.lexsort((key, -score, query))
        query, key, score = query[order], key[order], score[order]
        first = np.searchsorted(query, query)
        place = np.arange(len(query)) - first
        keep = place < k
        self.query, self.key, self.score = query[keep], key[keep], score[keep]
        full = place == k - 1
        self.least[query[full]] = score[full]
