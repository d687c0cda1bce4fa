"""Many texts searched for in many documents at once.

The texts become an automaton (a trie with failure links), which reads a document once however many texts there are.
Texts go out in parts of a bounded size, each part in one pass over the documents; nothing is shuffled but what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.operators.blocks import arrow_type, bounded, in_arrow, in_blocks

#: Characters and texts of a part. An automaton takes some 30 bytes for each character at most.
PART_CHARACTERS, PART_TEXTS = 4_000_000, 50_000


def _parts(rows: Iterator) -> Iterator[list[tuple]]:
    part, size = [], 0
    for key, text in rows:
        part.append((key, text))
        size += len(text)
        if size >= PART_CHARACTERS or len(part) >= PART_TEXTS:
            yield part
            part, size = [], 0
    if part:
        yield part


_built: dict = {}


def _automaton(number: int, texts: list[tuple]):
    """The automaton of a part, and the keys of empty texts; kept in the worker for its next task."""
    import ahocorasick

    if number not in _built:
        by_text: dict[str, list] = {}
        for key, text in texts:
            by_text.setdefault(text, []).append(key)
        everywhere, automaton = by_text.pop("", []), ahocorasick.Automaton()
        for text, keys in by_text.items():
            automaton.add_word(text, keys)
        if by_text:
            automaton.make_automaton()
        _built.clear()
        _built[number] = automaton if by_text else None, everywhere
    return _built[number]


def containing(docs: DataFrame, patterns: DataFrame, key: str = "doc_id", text: str = "text", pattern: str = "pattern") -> DataFrame:
    """qid, key: the patterns (qid, pattern) that each document contains, as they are written. An empty pattern is in every text; nulls match nothing. A pair comes as often as its rows do."""
    spark = docs.sparkSession
    schema = f"qid {patterns.schema['qid'].dataType.simpleString()}, {key} {docs.schema[key].dataType.simpleString()}"
    qid_type, key_type = arrow_type(patterns, "qid"), arrow_type(docs, key)
    source = docs.select(key, text).where(F.col(text).isNotNull())

    def of_part(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(block[0])
        number = shared._jbroadcast.id()

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton, everywhere = _automaton(number, shared.value)
            for batch in bounded(batches):
                qids, keys = [], []
                for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found = {id(x): x for _, x in automaton.iter(body)} if automaton else {}
                    mine = [q for x in found.values() for q in x] + everywhere
                    qids += mine
                    keys += [k] * len(mine)
                yield pa.RecordBatch.from_arrays([pa.array(qids, qid_type), pa.array(keys, key_type)], ["qid", key])

        return in_arrow(source, of, schema)

    rows = map(tuple, patterns.where(F.col(pattern).isNotNull()).select("qid", pattern).toLocalIterator())
    found = in_blocks(_parts(rows), 1, of_part)
    return spark.createDataFrame([], schema) if found is None else found
