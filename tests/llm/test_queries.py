"""The registered queries over the smallest tables, against brute force on every row."""

import html
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from docquarry.llm import line_dedup as ld
from docquarry.llm.common import words
from docquarry.llm.packing import cut
from docquarry.llm.queries import QUERIES
from docquarry.llm.tokens import tokenizer_path
from tests.llm.test_quality import slow as slow_statistics
from tests.llm.test_sharding import jump
from tests.llm.test_simhash import slow_components, slow_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return QUERIES[name](spark, SF).collect()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, docs):
    flat = lambda t: b" " + b" ".join(words(t)) + b" "
    items = {r.item_id: flat(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    expected = {(d, i) for d, t in docs.items() for i, x in items.items() if x in flat(t)}
    assert expected and {(r.doc_id, r.item_id) for r in run(spark, "op1_bm25_decontamination")} == expected


def test_op2(spark, docs):
    ids = sorted(docs)
    fps = [slow_fingerprint(docs[i]) for i in ids]
    parts = slow_components(ids, fps)
    assert sorted(map(tuple, run(spark, "op2_simhash_dedup"))) == [(i, f"{f:016x}", parts[i]) for i, f in zip(ids, fps)]


def test_op3(spark, docs):
    notices = {"Apache-2.0": "licensed under the apache license version 2 0", "MIT": "released under the mit license", "CC-BY-NC-4.0": "licensed under cc by nc 4 0", "GPL-3.0": "this work is licensed under the gnu general public license version 3"}
    expected = {(d, n) for d, t in docs.items() for n, x in notices.items() if x.encode() in b" ".join(words(t))}
    assert expected and {(r.doc_id, r.license) for r in run(spark, "op3_patience_licenses")} == expected


def test_op4(spark, docs):
    plain, expected, used = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), [], defaultdict(list)
    for i, t in docs.items():
        ids, at = plain.encode(t, add_special_tokens=False).ids + [2], 0
        for k, n in enumerate(cut(len(ids), 1024)):
            expected.append((i, k, at, n, crc(ids[at : at + n])))
            at += n
    out = run(spark, "op4_best_two_fit")
    assert sorted(tuple(r)[:5] for r in out) == sorted(expected)
    for r in out:
        used[r.sequence_id].append((r.offset, r.length))
    for places in used.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 1024


def test_op5(spark, docs):
    out = {r.doc_id: r for r in run(spark, "op5_boosted_quality")}
    assert out.keys() == docs.keys()
    for i, t in docs.items():
        r = out[i]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == slow_statistics(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


def test_op6(spark, docs):
    slots = defaultdict(list)
    for r in run(spark, "op6_jump_sharding"):
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.shard, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "key", jump(r.doc_id, 40), jump(r.doc_id, 41))
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == len(docs) and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_op7(spark):
    pages = {r.page_id: (r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in run(spark, "op7_wrapper_extraction"):
        url, page = pages.pop(r.page_id)
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:h1|p|div|ul|li)>", article))
        text = "\n".join(p for p in parts if p)
        assert (r.url, r.text, r.n_chars) == (url, text, len(text))
    assert not pages


def test_op8(spark, docs):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = {r.doc_id: r.rejected for r in run(spark, "op8_chain_toxicity")}
    assert out.keys() == docs.keys()
    assert np.mean([out[i] == bool(t) for i, t in toxic.items()]) > 0.9


def test_op9(spark, docs):
    lines = sorted((i, k, ld.words_of(x)) for i, t in docs.items() for k, x in enumerate(t.split("\n")) if len(ld.words_of(x)) >= 5)
    by_size, gone = defaultdict(list), set()
    for i, k, w in lines:
        if any(ld.within_one_edit(w, v) for n in (len(w) - 1, len(w), len(w) + 1) for v in by_size[n]):
            gone.add((i, k))
        by_size[len(w)].append(w)
    expected = []
    for i, t in docs.items():
        rows = t.split("\n")
        kept = "\n".join(x for k, x in enumerate(rows) if (i, k) not in gone)
        expected.append((i, len(rows), sum((i, k) in gone for k in range(len(rows))), len(kept), zlib.crc32(kept.encode())))
    assert gone and sorted(map(tuple, run(spark, "op9_deletion_line_dedup"))) == sorted(expected)


def test_op10(spark, docs):
    plain, expected, at = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), [], 0
    for i in sorted(docs):
        ids = plain.encode(docs[i], add_special_tokens=False).ids + [1]
        expected.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, run(spark, "op10_dac_tokens"))) == expected
