"""How far the sources of a language differ in the words they use.

Occurrences are summed by language, source and term before each shuffle; then a term becomes one wide row, an array
with a place for each source of its language. Array functions turn counts into smoothed shares and give the
contribution of the term to every pair of sources, and sums within the tasks leave one row for each pair and task.

A wide row has as many places as the language has sources, and there are as many contributions as pairs of sources
for each term: that is what the audit is about, and it does not grow with documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.llm.common import checkpoint_folder, table
from docquarry.llm.tokens import scratch_folder
from docquarry.session import union

#: Terms in fewer documents of a language do not count; ranks of terms that are reported.
LEAST_DOCS, TOP_TERMS = 10, 10
#: Languages (each with its list of sources) and sources in all that are broadcast; beyond, languages are joined in parts.
BROADCAST_SOURCES, PARTS = 100_000, 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All of ASCII but letters.
_BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


def _plain(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with the term)."""
    words = F.sort_array(F.split(F.translate(_plain(text), _UPPER, _LOWER), _BETWEEN))
    sorted_words = docs.select(_plain(lang).alias("lang"), _plain(source).alias("source"), words.alias("words"))
    # Each word beside the one before it: where they differ, a document has a term for the first time.
    pairs = F.arrays_zip(F.col("words").alias("term"), F.concat(F.array(F.lit("")), "words").alias("before"))
    each = sorted_words.select("lang", "source", F.inline(pairs).alias("term", "before")).where("term <> ''")
    return each.groupBy("lang", "source", "term").agg(F.count("*").alias("n"), F.sum((F.col("term") != F.col("before")).cast("long")).alias("docs"))


def wide_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term and by_source (source, n) of the terms in enough documents of their language; a list is as long as the language has sources, at most."""
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("by_source"))
    return terms.where(F.col("docs") >= least_docs).drop("docs")


def _scaled(n: Column, of: Column) -> Column:
    """floor(10^9 * n / of), for n up to `of` and `of` up to 9 * 10^15, three digits at a time."""
    total: Column = F.lit(0).cast("long")
    for _ in range(3):
        total, n = total * 1000 + F.call_function("div", n * 1000, of), n * 1000 % of
    return total


def _share(n: Column, all_n: Column, terms: Column) -> Column:
    return _scaled(n + 2, all_n + terms * 2) + 1


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _languages(docs: DataFrame, kept: DataFrame, lang: str, source: str) -> DataFrame:
    """lang, terms (kept ones), n (their occurrences) and sources, a sorted list of (source, n), sources without terms among them."""
    groups = docs.select(_plain(lang).alias("lang"), _plain(source).alias("source"), F.lit(0).cast("long").alias("n")).distinct()
    found = kept.select("lang", F.inline("by_source")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sources = union(groups, found).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    by_lang = sources.groupBy("lang").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("sources"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    return by_lang.join(terms, "lang", "left").select("lang", F.coalesce("terms", F.lit(0).cast("long")).alias("terms"), "n", "sources")


def _beside(terms: DataFrame, languages: DataFrame) -> DataFrame:
    """Each term with the row of its language; a large table of languages is copied into parts, so that the terms of one language meet it in many tasks."""
    if languages.agg(F.count("*") + F.coalesce(F.sum(F.size("sources")), F.lit(0))).first()[0] <= BROADCAST_SOURCES:
        return terms.join(F.broadcast(languages), "lang")
    part = F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int")
    copies = languages.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return terms.withColumn("part", part).join(copies, ["lang", "part"]).drop("part")


def divergence(docs: DataFrame, folder: str, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: for each source every other one by how far they differ (part `pair`), and the terms it uses more than its language does (part `term`, ranks up to `top`).

    What lies between is written to `folder`. Null texts, languages and sources are ''. Sources without a term have
    rows of part `pair`; a language without kept terms has the value 0 throughout. Ties are broken by item, very long
    texts count whole, repeated rows each. Other columns do not matter, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    wide_terms(term_counts(docs, lang, source, text), least_docs).write.parquet(f"{folder}/terms")
    kept = spark.read.parquet(f"{folder}/terms")
    _languages(docs, kept, lang, source).write.parquet(f"{folder}/languages")
    languages = spark.read.parquet(f"{folder}/languages")

    known = F.map_from_entries("by_source")
    vectors = _beside(kept.withColumn("known", known), languages).select(
        "lang", "term", "sources", F.transform("sources", lambda s: F.coalesce(F.col("known")[s.source], F.lit(0).cast("long"))).alias("counts"),
        F.transform("sources", lambda s: _share(F.coalesce(F.col("known")[s.source], F.lit(0).cast("long")), s.n, F.col("terms"))).alias("p"),
        _share(F.aggregate("by_source", F.lit(0).cast("long"), lambda total, s: total + s.n), F.col("n"), F.col("terms")).alias("q"),
    )

    pairs = F.transform("p", lambda x, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda y, k: F.struct(i.alias("i"), (i + 1 + k).alias("j"), _gap(x, y).alias("value"))))
    sums = vectors.select("lang", F.inline(F.flatten(pairs))).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    ones = languages.select("lang", F.transform("sources", lambda s: s.source).alias("others"), F.posexplode("sources").alias("a", "s")).select("lang", F.col("s.source").alias("source"), "a", "others").repartition("lang", "a")
    twos = ones.select("lang", "source", "a", F.posexplode("others").alias("b", "item")).where("a <> b").withColumns({"i": F.least("a", "b"), "j": F.greatest("a", "b")})
    by_pair = twos.join(sums, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))

    each = vectors.select("lang", "term", "q", F.inline(F.arrays_zip("sources", "counts", "p"))).where("counts > 0 and p > q")
    by_term = each.select("lang", F.col("sources.source").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return union(by_pair.withColumn("rank", rank), by_term.withColumn("rank", rank).where(F.col("rank") <= top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all sources of `documents`, by language."""
    return divergence(table(spark, sf_dir, "documents"), scratch_folder(checkpoint_folder(spark), "divergence"))


QUERIES = {"op12_source_divergence": op12_source_divergence}
ORACLES = {
    "op12_source_divergence": rf"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= {LEAST_DOCS}),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM groups LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (t.n + 2 * s.v) AS p,
    1 + 1000000000::HUGEINT * (k.n + 2) // (s.n + 2 * s.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN sizes s USING (lang) JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
gaps AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN gaps x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
}
