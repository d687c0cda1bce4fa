"""Alignment of two tokenizers over the same bytes.

Python tokenises and gives each token's id and byte range; all else is array functions of Spark. Offsets
where tokens of both end (`array_intersect` of the ends) cut a text into groups. Two tokens are linked if their byte
ranges overlap: between two neighbouring ends of either kind lies exactly one token of each, so every end of either
kind is one link (`array_except` gives those that are not shared). The tokens are also given by byte, each repeated over its bytes, which tells the two of a link.

A token of the first kind is written start * 2^34 + id * 2^17, one of the second id - start * 2^34. Their sum has the
pair of ids in its lower 34 bits, and nothing above these if both begin at the same byte; so a sum at a common end
tells at once whether the group is one token of each.

Links are written once, with a number for each row. A pair's count is then looked up in two ways that together hold
all pairs: pairs with at least a `HEAVY`th of all links, so at most `HEAVY` of them, are broadcast; the others, none of
which is frequent, are joined by a shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.llm.common import as_text, checkpoint_folder, slices, table, text_column
from docquarry.llm.tokens import BYTE_OF_CHARACTER, scratch_folder, tokenizer_path
from docquarry.session import union

#: Pairs that are broadcast at most.
HEAVY = 200_000
#: Bits of an id, and of a pair of ids.
ID_BITS, PAIR_BITS = 17, 34
#: Tokens of a batch, more or less; words in each half of a Python worker's cache; words that are tokenised at a time.
BATCH_TOKENS, WORDS, AT_A_TIME = 1 << 18, 300_000, 2000
#: Fixed value: how byte-level tokenizers of this kind cut a text before merging.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteLevel:
    """Ids by a byte-level tokenizer file, strings of special tokens being plain text, and each id's bytes.

    If merges are ranked by the ids they make, tiktoken gives the same ids sooner.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes[i] = bytes(BYTE_OF_CHARACTER.get(c, 0) for c in name)
        self.fast = self._fast(json.loads(self.tokenizer.to_str()))

    @staticmethod
    def _fast(file: dict):
        model, cuts = file["model"], file["pre_tokenizer"] or {}
        made = [model["vocab"].get("".join(x.split(" ") if isinstance(x, str) else x)) for x in model.get("merges", ())]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not plain or file["normalizer"] or cuts.get("type") != "ByteLevel" or cuts.get("add_prefix_space") or not cuts.get("use_regex", True) or None in made or made != sorted(made):
            return None
        import tiktoken

        special = {x["content"] for x in file["added_tokens"]}
        ranks = {bytes(BYTE_OF_CHARACTER[c] for c in k): v for k, v in model["vocab"].items() if k not in special}
        return tiktoken.Encoding("of-file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """Ids of space + text."""
        if self.fast:
            return self.fast.encode_to_numpy(" " + text, disallowed_special=())
        return np.array(self.tokenizer.encode(" " + text, add_special_tokens=False).ids, np.uint32)


class Pieces:
    """Ids by a SentencePiece model that adds a space in front, and each id's bytes."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(self.model.serialized_model_proto())
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(names)]
        #: Without a piece that goes on after a space, and without normalization, words may be encoded apart.
        self.by_word = spec.normalizer_spec.name == "identity" and not spec.normalizer_spec.remove_extra_whitespaces and not any(re.search("[^\u2581]\u2581", p) for p in names)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), np.uint32)


class Both:
    """Ids of space + text by both tokenizers. Words that both cut at the same single spaces are remembered."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        if max(len(self.a.bytes), len(self.b.bytes)) > 1 << ID_BITS:
            raise ValueError(f"ids of more than {ID_BITS} bits")
        self.sizes = [np.array([len(x) for x in t.bytes], np.int32) for t in (self.a, self.b)]
        self.spaced = [np.array([x[:1] == b" " for x in t.bytes]) for t in (self.a, self.b)]
        self.words: dict[str, tuple[bytes, bytes] | None] = {}
        self.old: dict[str, tuple[bytes, bytes] | None] = {}

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of space + text; None if the tokens' bytes are not those of space + text."""
        data = b" " + text.encode("utf-8", "surrogatepass")
        found = self.a.encode(text), self.b.encode(text)
        same = (b"".join([t.bytes[i] for i in ids.tolist()]) == data for t, ids in zip((self.a, self.b), found))
        return found if all(same) else None

    def _learn(self, words: list[str]) -> None:
        """Tokenise words at one go, as a text with single spaces between them, and take the ids apart where tokens begin with a space."""
        found, cuts = self._whole(" ".join(words)), []
        if found:
            cuts = [np.flatnonzero(spaced[ids]) for spaced, ids in zip(self.spaced, found)]
        if found and all(len(c) == len(words) for c in cuts):
            parts = []
            for ids, c in zip(found, cuts):
                data, at = ids.tobytes(), [*(c * ids.itemsize).tolist(), ids.nbytes]
                parts.append([data[i:j] for i, j in zip(at, at[1:])])
            self.words.update(zip(words, zip(*parts)))
        elif len(words) > 1:
            self._learn(words[: len(words) // 2])
            self._learn(words[len(words) // 2 :])
        else:
            self.words[words[0]] = found and (found[0].tobytes(), found[1].tobytes())

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of each text by both tokenizers; both empty if it has no tokens.

        A text with a space beside other white space, where the tokenizers may not cut, is tokenised whole.
        """
        split = [x.split(" ") if x and self.b.by_word else () for x in texts]
        if len(self.words) >= WORDS:
            self.old, self.words = self.words, {}
        words, old, new = self.words, self.old, []
        for w in set().union(*split).difference(words):
            if w in old:
                words[w] = old[w]
            elif not w or w[0].isspace() or w[-1].isspace():
                words[w] = None
            else:
                new.append(w)
        for k in range(0, len(new), AT_A_TIME):
            self._learn(new[k : k + AT_A_TIME])
        none = np.zeros(0, np.uint32)
        for text, parts in zip(texts, split):
            ids = [words[w] for w in parts]
            if ids and None not in ids:
                yield tuple(np.frombuffer(b"".join(x), np.uint32) for x in zip(*ids))
            else:
                yield (text and self._whole(text)) or (none, none)


_both: dict[tuple[str, str], Both] = {}


def tokenised(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key as `id`, and of the tokens of space + text by both tokenizers the ends in bytes, and the token (see above) that holds the n-th byte, with nothing at 0. What has no tokens has no ends."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a_path, b_path) not in _both:
            _both[a_path, b_path] = Both(a_path, b_path)
        both = _both[a_path, b_path]

        def out(keys: pa.Array, rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            columns = [keys]
            for k, size_of in enumerate(both.sizes):
                lengths, ids = np.array([len(r[k]) for r in rows]), np.concatenate([r[k] for r in rows])
                first, sizes = np.cumsum(lengths) - lengths, size_of[ids]
                ends = np.cumsum(sizes, dtype=np.int64)
                before = np.append(0, ends)
                start = before[:-1] - np.repeat(before[first], lengths)
                tokens = ids - (start << PAIR_BITS) if k else (start << PAIR_BITS) + (ids.astype(np.int64) << ID_BITS)
                by_byte = np.repeat(np.insert(tokens, first, 0), np.insert(sizes, first, 1))
                of_bytes = before[first + lengths] - before[first]
                columns.append(pa.ListArray.from_arrays(np.append(first, len(ids)).astype(np.int32), (start + sizes).astype(np.int32)))
                columns.append(pa.ListArray.from_arrays(np.append(0, np.cumsum(of_bytes + 1)).astype(np.int32), by_byte))
            return pa.RecordBatch.from_arrays(columns, ["id", "a_ends", "at_a", "b_ends", "at_b"])

        for batch in slices(batches):
            rows, first, size = [], 0, 0
            for k, row in enumerate(both.encode(as_text(batch.column(1)))):
                rows.append(row)
                size += len(row[0])
                if size >= BATCH_TOKENS or k + 1 == batch.num_rows:
                    yield out(batch.column(0).slice(first, len(rows)), rows)
                    rows, first, size = [], k + 1, 0

    chosen = docs.select(F.col(key).alias("id"), text_column(text))
    arrays = ", ".join(f"{c}_ends array<int>, at_{c} array<long>" for c in "ab")
    return chosen.mapInArrow(of, f"id {chosen.schema['id'].dataType.simpleString()}, {arrays}")


def _let(value: Column, of) -> Column:
    """of(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), of)[0]


def _if(condition: Column, value: Column, other: Column) -> Column:
    """value or other: fewer steps than a case of one branch, where expressions are interpreted."""
    return F.call_function("if", condition, value, other)


def _id_of_a(x: Column) -> Column:
    return F.shiftright(x, ID_BITS).bitwiseAND((1 << ID_BITS) - 1).cast("string")


def _id_of_b(x: Column) -> Column:
    return x.bitwiseAND((1 << ID_BITS) - 1).cast("string")


def aligned(tokens: DataFrame) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, groups_sha256 and links (the pair in the lower 34 bits) of tokenised texts."""

    # The sets of ends are columns of their own, and used twice, so that Spark compiles them for ints; within a lambda it would interpret them over objects.
    shared = F.array_intersect("a_ends", "b_ends").alias("shared")
    sets = tokens.select("*", shared).select("*", F.array_except(F.concat("a_ends", "b_ends"), "shared").alias("inside"), F.size("shared").alias("n_groups"))

    def found(at_a: Column, at_b: Column, shared: Column) -> Column:
        """A link for each end of either kind, those of shared ends first, which are also the groups."""

        def several(k: Column) -> Column:
            """The k-th group from the tokens over its bytes."""
            before = _if(k > 0, shared[k - 1], F.lit(0))
            ids = (F.array_join(F.transform(F.array_distinct(F.slice(at, before + 2, shared[k] - before)), of), ",") for at, of in ((at_a, _id_of_a), (at_b, _id_of_b)))
            return F.concat(next(ids), F.lit("|"), next(ids))

        def group(x: Column, k: Column) -> Column:
            return _if(F.shiftright(x, PAIR_BITS) == 0, F.concat(F.shiftright(x, ID_BITS).cast("string"), F.lit("|"), _id_of_b(x)), several(k))

        def both(of_shared: Column) -> Column:
            groups = F.array_join(F.transform(of_shared, group), ";")
            return F.struct(_if(F.col("n_groups") > 0, F.sha2(groups, 256), F.lit("")).alias("groups_sha256"), F.concat(of_shared, sums(F.col("inside"))).alias("links"))

        def sums(ends: Column) -> Column:
            return F.transform(ends, lambda end: at_a[end] + at_b[end])

        return _let(sums(shared), both)

    x = _let(F.col("at_a"), lambda at_a: _let(F.col("at_b"), lambda at_b: _let(F.col("shared"), lambda shared: found(at_a, at_b, shared))))
    counts = [F.size("a_ends").alias("n_a"), F.size("b_ends").alias("n_b"), "n_groups", (F.col("n_groups") + F.size("inside")).alias("n_links")]
    return sets.select("id", *counts, x.alias("x")).select("id", "n_a", "n_b", "n_groups", "n_links", "x.groups_sha256", "x.links")


def cross_align(docs: DataFrame, a_path: str, b_path: str, folder: str, key: str = "doc_id", text: str = "text", heavy: int = HEAVY) -> DataFrame:
    """How two tokenizers cut the same texts: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row.

    A link joins two token occurrences whose bytes overlap; a pair of ids counts as often as it is linked in all rows.
    n_best counts links whose pair is the most frequent one of its second id (ties included), count_sum adds up the
    pairs' counts. What lies between is written to `folder`.

    A null or empty text, and one whose bytes the tokenizers do not give back, has zeros and ''. Very long texts are
    aligned whole, in one row of arrays of some 40 bytes for each byte of text. Repeated rows each count and each
    have a row; a null key is kept. Other columns do not matter, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    aligned(tokenised(docs, a_path, b_path, key, text)).withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(f"{folder}/links")
    rows = spark.read.parquet(f"{folder}/links")
    links = rows.select("row", F.explode("links").alias("pair")).select("row", F.col("pair").bitwiseAND((1 << PAIR_BITS) - 1).alias("pair"))
    best = F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND((1 << ID_BITS) - 1)))  # at most as many rows as the first tokenizer has ids
    links.groupBy("pair").agg(F.count("*").alias("n")).withColumn("best", (F.col("n") == best).cast("long")).write.parquet(f"{folder}/pairs")
    pairs = spark.read.parquet(f"{folder}/pairs")
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.broadcast(pairs.where(F.col("n") >= F.lit(-(-total // heavy))))
    sums = [F.sum("best").alias("n_best"), F.sum("n").alias("count_sum")]
    found = [
        links.join(often, "pair").groupBy("row").agg(*sums),
        links.join(often, "pair", "left_anti").join(pairs, "pair").groupBy("row").agg(*sums),
    ]
    both = union(*found).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    whole = rows.drop("links").join(both, "row", "left")
    counts = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return whole.select("id", *counts, "groups_sha256")


def op13_cross_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the byte-level tokenizer and the SentencePiece model cut each of `documents`."""
    folder = scratch_folder(checkpoint_folder(spark), "alignment")
    out = cross_align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), folder)
    return out.withColumnRenamed("id", "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))


QUERIES = {"op13_cross_alignment": op13_cross_alignment}
ORACLES: dict[str, str] = {}
