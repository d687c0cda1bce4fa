import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from docquarry.llm import decontam
from docquarry.llm.tokens import tokenizer_path
from docquarry.llm.toxicity import LOW_QUALITY_THEN_TOXIC, score
from tests.llm.test_line_dedup import slow as slow_lines
from tests.llm.test_simhash import slow_components, slow_fingerprint


def make(tmp_path, spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    text = lambda: "\n".join(" ".join(word() for _ in range(rng.randrange(3, 25))) for _ in range(rng.randrange(1, 8)))
    items = [(i, " ".join(word() for _ in range(20)) + ". " + " ".join(word() for _ in range(6)) + ".") for i in range(10)]
    rows = []
    for i in range(150):
        t = text()
        if i % 5 == 0:
            t += " vile rotten vile awful"
        if i % 11 == 3:
            t += "\n" + items[i % 10][1]
        if i % 13 == 4:
            t = rows[i - 4][1]
        if i % 17 == 6:
            t = rows[i - 3][1] + " one more"
        rows.append((i, t, "en", "src", len(t)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "src", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int("vile" in rows[i][1])) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return [(i, t) for i, t, *_ in rows], items


def test_stages_equal_brute_force(spark, tmp_path):
    rows, items = make(tmp_path, spark)
    docs, sf = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    toxic = {r.doc_id for r in score(docs, spark.read.parquet(f"{sf}/labels.parquet"), tuple(LOW_QUALITY_THEN_TOXIC), LOW_QUALITY_THEN_TOXIC).collect() if r.rejected}
    assert toxic == {i for i, t in rows if t and "vile" in t}
    kept = slow_lines([r for r in rows if r[0] not in toxic])
    ids = [i for i, _ in kept]
    components = slow_components(sorted(ids), [slow_fingerprint(dict(kept)[i] or "") for i in sorted(ids)])
    kept = [(i, t) for i, t in kept if components[i] == i]
    leaked = lambda t: any(" ".join(w.decode() for w in decontam.words(x)) in " ".join(w.decode() for w in decontam.words(t or "")) for _, x in items)
    kept = [(i, t) for i, t in kept if not leaked(t)]
    plain = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    expected = []
    for i, t in kept:
        tokens = plain.encode(t or "", add_special_tokens=False).ids + [2]
        expected.append((i, 0, 0, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
    out = corpus_pipeline.run(spark, sf)
    assert sorted(tuple(r)[:5] for r in out.collect()) == sorted(expected)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def odd(spark, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns of clashing names."""
    rng = random.Random(3)
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    same, item = say(60), say(20) + ". " + say(6) + "."
    rows = [(1, same), (1, same), (1, say(50)), (2, same), (3, None), (4, ""), (5, " \n\n "), (None, say(40)), (None, None), (6, say(30_000)), (7, say(20) + "\n" + item), (8, item), (8, item), (9, "vile rotten " * 9 + say(30))]
    rows += [(100 + i, say(30) + (" vile rotten vile awful" if i % 3 == 0 else "")) for i in range(60)]
    names = ["doc_id", "text", "lang", "n_chars", "_id", "_gone", "fp", "score", "c0", "odd `name`", "item_id", "length", "t"]
    docs = spark.createDataFrame([(i, t, None, None if t is None else len(t), 1, None, 2, 0.5, "c", "o", None, None, "t") for i, t in rows], "a long, b string, c string, d long, e int, f string, g int, h double, i string, j string, k string, l int, m string").toDF(*names)
    spark.createDataFrame([(100 + i, 1, int(i % 3 == 0)) for i in range(60)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, docs.repartition(3), item


def test_every_stage_on_odd_rows(spark, tmp_path):
    rows, docs, item = odd(spark, tmp_path)
    key = lambda r: (str(r[0]), str(r[1]))
    kept = {name: sorted(((r[0], r[1]) for r in stage(spark, docs, str(tmp_path)).collect()), key=key) for name, stage in corpus_pipeline.STAGES[:-1]}
    assert kept["toxicity"] == sorted([r for r in rows if "vile" not in (r[1] or "")], key=key)
    assert kept["line_dedup"] == sorted(slow_lines(rows), key=key)
    first, seen = [], set()  # of texts that are not near one another, equal ones are the groups; all without words are one
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is None)):
        if (group := (t or "").strip()) not in seen:
            seen.add(group), first.append((i, t))
    assert kept["simhash"] == sorted(first + [r for r in rows if r[0] is None], key=key)
    assert kept["decontamination"] == sorted([r for r in rows if item not in (r[1] or "")], key=key)
    out = corpus_pipeline.packing(spark, docs, str(tmp_path)).collect()
    assert sorted((str(r.doc_id) for r in out if r.piece == 0)) == sorted(str(i) for i, _ in rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        result = stage(spark, docs, str(tmp_path))
        assert result.columns == docs.columns, name
        assert all(tuple(r)[4:] == (1, None, 2, 0.5, "c", "o", None, None, "t") for r in result.collect()), name


def test_every_stage_on_an_empty_table_and_without_labels_or_items(spark, tmp_path):
    _, docs, _ = odd(spark, tmp_path)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("doc_id < 0"), str(tmp_path)).collect() == [], name
    empty = tmp_path / "none"
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    for stage in (corpus_pipeline.toxicity, corpus_pipeline.decontamination):
        assert stage(spark, docs, str(empty)).count() == docs.count()
