"""Queries of parsing, sections, tables and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.operators import chunk, parse
from docquarry.plans.registry import Fixture, query, table
from docquarry.session import union

FILINGS = Fixture("filing string, text string", [
    ("A", "cover line\nItem 1. | Business | 3\nITEM 1. Business overview\n" + "We sell things. " * 20 + "\nItem 1A | Risk Factors\n" + "Risks are many. " * 20 + "\nitem 7. discussed below\n12\nItem 6. [Reserved]\nshort"),
    ("B", "c" * 250 + "\nItem 7: Management Discussion\n" + "Results grew. " * 30),
])
LINES = Fixture("id long, text string", [(1, "12\nTable of Contents\nkept\nPART II\nItem 8\n-----\nApple Inc. | 2025 Form 10-K | 48\npart of it\n1234"), (2, ""), (3, "  7 \nitem 9b\nItems")])
TABLES = Fixture("id long, rows array<string>, n_header int, groups string", [
    (1, ["Years ended | 2025 | 2024", "Revenue | 10 | 9", "Costs:", "Rent | 1 | 2"], 1, "Costs:"), (2, ["(in millions)", "Sept. 27, 2025 | Sept. 28, 2024", "Cash | 5"], 2, ""), (3, ["Alpha | 5", "Beta | 6"], 0, ""),
    (4, ["2025", "Sales | 3", "2024", "Sales | 2"], 0, "2025;2024"), (5, ["Note (1) | 3 months", "ASSETS", "Cash | 1"], 1, "ASSETS"), (6, ["plain words only"], 0, ""),
])
PAGES_FIXTURE = Fixture("id long, html string, text string", [
    (1, "<p>One&nbsp;two<br>three</p><p>12</p><table><tr><th>Year<th>2025</tr><tr><td>Sales</td><td>$</td><td>10</td></tr></table><div style='display: none'>x<div>y</div></div>end", "One two\nthree\n\nYear | 2025\nSales | 10\n\nend"),
    (2, "<script>a<b</script><ul><li>•<p>first</ul>", "• first"), (3, "", ""),
])


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(html, '<head>.*?</head>', '', 'gs'), '<!--.*?-->', '', 'gs') AS h FROM pages),
t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '</?(p|div|li|h[1-6]|table)(\s[^>]*)?>', chr(10) || chr(10), 'g'), '<br>', chr(10), 'g'), '<[a-zA-Z/!][^>]*>', '', 'g') AS x FROM p),
u AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS x FROM t),
v AS (SELECT page_id, regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g') AS x FROM u)
SELECT page_id, md5(trim(regexp_replace(array_to_string(list_filter(string_split(x, chr(10)), lambda l: NOT regexp_matches(trim(l), '(?i)^(?:\d{1,3}|table of contents|part\s+i{1,3}v?|item\s+\d{1,2}[a-c]?|[_\-=]{3,})$')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || ' ')) AS text FROM v""")
def pages_to_text(spark, sf_dir):
    return parse.pages_to_text(table(spark, sf_dir, "pages")).select("page_id", F.md5(F.col("text").cast("binary")).alias("text"))


@query(f"SELECT id, text FROM {PAGES_FIXTURE.sql}")
def page_cases(spark, sf_dir):
    return parse.pages_to_text(PAGES_FIXTURE.df(spark), "id")


_NOISE_SQL = parse.NOISE.replace("'", "''")


@query(f"SELECT id, array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(trim(l), '{_NOISE_SQL}')), chr(10)) AS text FROM (SELECT * FROM {LINES.sql} UNION ALL SELECT doc_id + 100, text FROM documents)")
def drop_noise_lines(spark, sf_dir):
    both = LINES.df(spark).unionByName(table(spark, sf_dir, "documents").select((F.col("doc_id") + 100).alias("id"), "text"))
    return both.select("id", parse.drop_noise_lines(F.col("text")).alias("text"))


_SECTION_ROWS = Fixture("filing string, n long, item string, title string, chars long", [("A", 1, "Item 1", "Business overview", 319), ("A", 2, "Item 1A", "Risk Factors", 347), ("B", 0, "Cover", "Cover page", 250), ("B", 1, "Item 7", "Management Discussion", 419)])


@query(f"SELECT * FROM {_SECTION_ROWS.sql}")
def sections(spark, sf_dir):
    return parse.sections(FILINGS.df(spark), "filing").select("filing", "n", "item", "title", F.length("body").cast("long").alias("chars"))


@query(f"SELECT id, n_header, groups FROM {TABLES.sql}")
def table_headers(spark, sf_dir):
    t = TABLES.df(spark).drop("n_header", "groups")
    labels = t.select("id", F.array_join(F.filter("rows", parse.is_group_label), ";").alias("groups"))
    return parse.header_rows(t, "id").join(labels, "id")


@query(f"SELECT id, 'Table: T' || id || chr(10) || array_to_string(rows, chr(10)) AS body FROM (SELECT id, rows FROM {TABLES.sql} UNION ALL SELECT doc_id + 1000, string_split(text, chr(10)) FROM documents)")
def render_tables(spark, sf_dir):
    """The fixed tables, and every document's lines as the rows of one."""
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("id"), F.split("text", "\n").alias("rows"))
    t = TABLES.df(spark).select("id", "rows").unionByName(docs)
    return t.select("id", parse.render_table(F.concat(F.lit("T"), F.col("id").cast("string")), F.slice("rows", 1, 1), F.slice("rows", F.lit(2), F.size("rows"))).alias("body"))


_WINDOWS = "w AS (SELECT doc_id, lang, source, t, unnest(range(0, greatest(len(t) - 10, 1), 40)) AS i FROM (SELECT doc_id, lang, source, regexp_extract_all(text, '[^ \\n\\t\\r\\f\\v]+') AS t FROM documents)), c AS (SELECT doc_id, lang, source, CAST(i // 40 AS INTEGER) AS seq, array_to_string(t[i + 1:i + 50], ' ') AS body, CAST(len(t[i + 1:i + 50]) AS BIGINT) AS n FROM w)"


def _window_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    c = chunk.window_rows(docs, "text", 50, 10, ["doc_id", "lang", "source"])
    return c.withColumn("n", F.size(F.regexp_extract_all("body", F.lit(r"\S+"), F.lit(0))).cast("long"))


@query(f"WITH {_WINDOWS} SELECT source || '_' || doc_id || '_' || lpad(CAST(seq AS VARCHAR), 3, '0') AS id, n, md5(body) AS body FROM c")
def window_chunks(spark, sf_dir):
    c = _window_chunks(spark, sf_dir)
    name = F.concat_ws("_", "source", F.col("doc_id").cast("string"), F.when(F.col("seq") < 1000, F.lpad(F.col("seq").cast("string"), 3, "0")).otherwise(F.col("seq").cast("string")))
    return c.select(name.alias("id"), "n", F.md5(F.col("body").cast("binary")).alias("body"))


@query(f"WITH {_WINDOWS} SELECT lang, count(*) AS chunks, round(avg(n), 6) AS mean, median(n) AS median, min(n) AS least, max(n) AS most, CAST(sum(n) AS BIGINT) AS total, count_if(n > 45) AS over_limit FROM c GROUP BY lang")
def chunk_stats(spark, sf_dir):
    return _window_chunks(spark, sf_dir).groupBy("lang").agg(
        F.count("*").alias("chunks"), F.round(F.avg("n"), 6).alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("total"), F.count_if(F.col("n") > 45).alias("over_limit")
    )


@query(f"WITH {_WINDOWS}, k AS (SELECT doc_id AS parent, doc_id % 7 AS qid, row_number() OVER (PARTITION BY doc_id % 7 ORDER BY n DESC, doc_id, seq) AS rank FROM c QUALIFY rank <= 40) SELECT qid, parent, min(rank) AS best, array_to_string(list_sort(list(rank)), ',') AS via, row_number() OVER (PARTITION BY qid ORDER BY min(rank), parent) AS position FROM k GROUP BY qid, parent QUALIFY position <= 5")
def parent_expand(spark, sf_dir):
    w = Window.partitionBy("qid").orderBy(F.desc("n"), "doc_id", "seq")
    kids = _window_chunks(spark, sf_dir).withColumn("qid", F.col("doc_id") % 7).withColumn("rank", F.row_number().over(w)).where("rank <= 40").select("qid", F.col("doc_id").alias("parent"), "rank")
    return chunk.expand_to_parents(kids, 5).withColumn("via", F.array_join(F.col("via").cast("array<string>"), ","))


@query(f"WITH {_WINDOWS} SELECT doc_id, seq, coalesce(array_to_string(list_reverse(string_split(lag(body) OVER o, ' '))[1:8], ' '), '(start)') AS before, coalesce(array_to_string(string_split(lead(body) OVER o, ' ')[1:5], ' '), '(end)') AS after FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY seq)")
def neighbour_context(spark, sf_dir):
    return chunk.neighbours(_window_chunks(spark, sf_dir), ["doc_id"], "seq", "body", 8, 5).select("doc_id", "seq", "before", "after")


_COMPANY = Fixture("ticker string, name string", [("AAPL", "Apple Inc."), ("MSFT", "Microsoft Corporation"), ("TSLA", "Tesla, Inc.")])
_ITEMS = Fixture("item string, item_name string", [("Item 1", "Business"), ("Item 1A", "Risk Factors"), ("Item 7", "Management's Discussion and Analysis (MD&A)")])
_CHUNKS = Fixture("id long, ticker string, fiscal_year int, period_end string, item string, caption string", [(1, "AAPL", 2025, "2025-09-27", "Item 1A", ""), (2, "MSFT", 2024, "2024-06-30", "Cover", "Revenues"), (3, "XXXX", 2023, "2023-01-02", "Item 99", "c" * 200), (4, "TSLA", 2024, "2024-12-31", "Item 7", None)])


_DESCRIBED = f"(SELECT * FROM {_CHUNKS.sql} UNION ALL SELECT doc_id + 1000, ['AAPL', 'MSFT', 'TSLA', 'XXXX'][doc_id % 4 + 1], CAST(2000 + doc_id % 25 AS INTEGER), strftime(DATE '2024-01-31' - CAST(doc_id % 900 AS INTEGER), '%Y-%m-%d'), ['Item 1', 'Item 1A', 'Item 7', 'Cover', 'Item 99'][doc_id % 5 + 1], CASE WHEN doc_id % 3 = 0 THEN text END FROM documents)"


def _described(spark, sf_dir):
    """The fixed chunks, and one for each document."""
    pick = lambda n, *xs: F.get(F.array(*map(F.lit, xs)), (F.col("doc_id") % n).cast("int"))
    docs = table(spark, sf_dir, "documents").select(
        (F.col("doc_id") + 1000).alias("id"), pick(4, "AAPL", "MSFT", "TSLA", "XXXX").alias("ticker"), (2000 + F.col("doc_id") % 25).cast("int").alias("fiscal_year"),
        F.date_format(F.date_sub(F.lit("2024-01-31").cast("date"), (F.col("doc_id") % 900).cast("int")), "yyyy-MM-dd").alias("period_end"), pick(5, "Item 1", "Item 1A", "Item 7", "Cover", "Item 99").alias("item"), F.when(F.col("doc_id") % 3 == 0, F.col("text")).alias("caption"),
    )
    return _CHUNKS.df(spark).unionByName(docs)


@query(f"""SELECT c.id, '[' || coalesce(n.name, c.ticker) || ' (' || c.ticker || ') | Form 10-K, fiscal year ' || fiscal_year || ', ended ' || strftime(CAST(period_end AS DATE), '%B %-d, %Y') || ' | ' ||
CASE WHEN c.item = 'Cover' THEN 'Cover page' ELSE c.item || ': ' || coalesce(i.item_name, c.item) END || CASE WHEN caption <> '' THEN ' | Table: ' || caption[1:150] ELSE '' END || ']' AS header FROM {_DESCRIBED} c LEFT JOIN {_COMPANY.sql} n USING (ticker) LEFT JOIN {_ITEMS.sql} i USING (item)""")
def context_header(spark, sf_dir):
    c = _described(spark, sf_dir).join(F.broadcast(_COMPANY.df(spark)), "ticker", "left").join(F.broadcast(_ITEMS.df(spark)), "item", "left")
    item = F.when(F.col("item") == "Cover", F.lit("Cover page")).otherwise(F.concat("item", F.lit(": "), F.coalesce("item_name", "item")))
    parts = [F.concat(F.coalesce("name", "ticker"), F.lit(" ("), F.col("ticker"), F.lit(")")), F.concat(F.lit("Form 10-K, fiscal year "), F.col("fiscal_year").cast("string"), F.lit(", ended "), F.date_format(F.to_date("period_end"), "MMMM d, yyyy")), item, F.when(F.col("caption") != "", F.concat(F.lit("Table: "), F.substring("caption", 1, 150)))]
    return c.select("id", F.concat(F.lit("["), F.concat_ws(" | ", *parts), F.lit("]")).alias("header"))


@query("WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), h AS (SELECT doc_id, trim(string_split(text, chr(10))[1]) AS header FROM documents WHERE contains(text, '|')) SELECT h.doc_id, count_if(regexp_matches(d.line, '\\d') AND contains(d.line, '|')) AS numeric_rows, count_if(regexp_matches(d.line, '\\d') AND contains(d.line, '|') AND NOT contains(d.line, h.header)) AS lost FROM h JOIN d USING (doc_id) GROUP BY h.doc_id")
def lost_header(spark, sf_dir):
    """Numeric rows of pipe tables that lack the header of their text (here its first line)."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").contains("|"))
    lines = docs.select("doc_id", F.trim(F.element_at(F.split("text", "\n"), 1)).alias("header"), F.explode(F.split("text", "\n")).alias("line"))
    numeric = F.col("line").rlike(r"\d") & F.col("line").contains("|")
    return lines.groupBy("doc_id").agg(F.count_if(numeric).alias("numeric_rows"), F.count_if(numeric & ~F.contains("line", "header")).alias("lost"))


FOLDS = Fixture("id long, text string, seq int, chunk string", [
    (1, "a b c", 0, "a b c"), (2, "one two. three four. five six", 0, "one two. three four."), (2, "", 1, "five six\n."), (3, "x y z w v", 0, "x y z w"), (3, "", 1, "z w v\n."), (4, "  ", 0, None),
])


@query(f"SELECT id, seq, chunk FROM {FOLDS.sql} WHERE chunk IS NOT NULL")
def recursive_chunks(spark, sf_dir):
    texts = FOLDS.df(spark).where("seq = 0").select("id", "text")
    return chunk.chunked(texts, "id", "text", lambda t: chunk.recursive_chunks(t, 4, 2))


@query(None)
def structured_chunks(spark, sf_dir):
    blocks = lambda t: [{"kind": "text", "text": p} if "|" not in p else {"kind": "table", "caption": "Rows", "header": p.split("\n")[:1], "rows": p.split("\n")[1:]} for p in t.split("\n") if p]
    docs = table(spark, sf_dir, "documents")
    return chunk.chunked(docs, "doc_id", "text", lambda t: [f"{k}: {b}" for k, b in chunk.block_chunks(blocks(t), 60, 10)])


# ---- Blocks, chunk sets, parents by sub-question ------------------------------------------------------------------

_S, _E, _LONG = parse.TABLE_START, parse.TABLE_END, "point of a cell that is too long to name a column"
MARKED = Fixture("id long, text string", [
    (1, f"Intro sentence here.\n\nRESULTS\n\nRevenues\n\n{_S}\nYears ended | 2025 | 2024\nRevenue | 10 | 9\nCosts:\nRent | 1 | 2\n{_E}\n\nAfter it."),
    (2, f"{_S}\nfirst point\nsecond | {_LONG}\n{_E}\nTail"), (3, f"Loose {_E} mark\n\n\nand {_S} more"), (4, ""), (5, None), (6, f"Cash flows;\n\n{_S}\nCash | 5\n{_E}"), (7, f"A\n\nB\n\nC\n\n{_S}\n\n{_E}x{_S}\n2025\nSales | 3\n{_E}"),
])
_BLOCK_ROWS = Fixture("id long, n int, kind string, body string, caption string, header string", [
    (1, 0, "text", "Intro sentence here.", None, None), (1, 1, "text", "RESULTS", None, None), (1, 2, "text", "Revenues", None, None), (1, 3, "table", "Revenue | 10 | 9/Costs:/Rent | 1 | 2", "RESULTS — Revenues", "Years ended | 2025 | 2024"), (1, 4, "text", "After it.", None, None),
    (2, 0, "text", "first point", None, None), (2, 1, "text", f"second {_LONG}", None, None), (2, 2, "text", "Tail", None, None), (3, 0, "text", "Loose  mark", None, None), (3, 1, "text", "and  more", None, None),
    (6, 0, "text", "Cash flows;", None, None), (6, 1, "table", "Cash | 5", "", ""), (7, 0, "text", "A", None, None), (7, 1, "text", "B", None, None), (7, 2, "text", "C", None, None), (7, 3, "text", "x", None, None), (7, 4, "table", "Sales | 3", "C — x", "2025"),
])


@query(f"SELECT * FROM {_BLOCK_ROWS.sql} UNION ALL SELECT 100 + doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER), 'text', md5(x), NULL, NULL FROM (SELECT doc_id, generate_subscripts(parts, 1) AS i, regexp_replace(unnest(parts), '^[ \\t\\n\\v\\f\\r]+|[ \\t\\n\\v\\f\\r]+$', '', 'g') AS x FROM (SELECT doc_id, regexp_split_to_array(text, '\\n{{2,}}') AS parts FROM documents)) WHERE x <> ''")
def parse_blocks(spark, sf_dir):
    """Blocks of marked texts, and the paragraphs of every document."""
    of = lambda df: parse.blocks(df, "id").select("id", F.posexplode("blocks").alias("n", "x"))
    docs = of(table(spark, sf_dir, "documents").select((F.col("doc_id") + 100).alias("id"), "text"))
    body = F.coalesce("x.text", F.array_join("x.rows", "/"))
    marked = of(MARKED.df(spark)).select("id", "n", "x.kind", body.alias("body"), "x.caption", F.array_join("x.header", "/").alias("header"))
    return union(marked, docs.select("id", "n", "x.kind", F.md5(body.cast("binary")).alias("body"), "x.caption", F.array_join("x.header", "/").alias("header")))


@query("SELECT 'marked' AS source, 17 AS blocks, 3 AS tables, 2 AS with_header, 2 AS with_caption, 5 AS rows")
def structure_statistics(spark, sf_dir):
    return parse.structure_statistics(parse.blocks(MARKED.df(spark), "id").withColumn("source", F.lit("marked")), "source")


@query(None)
def chunk_sets(spark, sf_dir):
    """The four chunk sets of every document under a header that names its source."""
    docs = table(spark, sf_dir, "documents")
    marked = docs.select("doc_id", F.concat(F.lit("["), "source", F.lit(" | "), "lang", F.lit("]")).alias("header")).join(parse.blocks(docs, "doc_id"), "doc_id")
    return chunk.chunk_sets(marked, "doc_id")


@query(None)
def children_per_parent(spark, sf_dir):
    """How many parents have how many children, by kind. The sets have no SQL; the tests count by hand."""
    kids = chunk_sets(spark, sf_dir).where("variant = 'child'").groupBy("doc_id", "parent", "kind").agg(F.count("*").alias("children"))
    return kids.groupBy("kind", "children").agg(F.count("*").alias("parents"))


CHILDREN = Fixture("qid long, sub int, parent string, rank int", [(1, 0, "p1", 1), (1, 0, "p2", 2), (1, 0, "p1", 3), (1, 0, "p3", 4), (1, 1, "p2", 1), (1, 1, "p1", 2), (1, 1, "p4", 3), (1, 1, "p5", 4), (2, 0, "p9", 2), (2, 0, "p8", 1), (2, 0, "p7", 3), (2, 0, "p6", 4), (2, 0, "p5", 5)])
_PARENTS = Fixture("qid long, sub int, parent string, best int, via string, position int", [(1, 0, "p1", 1, "1,3", 1), (1, 0, "p2", 2, "2", 2), (1, 1, "p4", 3, "3", 3), (1, 1, "p5", 4, "4", 4), (2, 0, "p8", 1, "1", 1), (2, 0, "p9", 2, "2", 2), (2, 0, "p7", 3, "3", 3), (2, 0, "p6", 4, "4", 4)])


@query(f"SELECT * FROM {_PARENTS.sql}")
def plan_parents(spark, sf_dir):
    """Parents for each sub-question; the second one passes over those that the first one took."""
    return chunk.expand_plan(CHILDREN.df(spark), 4).withColumn("via", F.array_join(F.col("via").cast("array<string>"), ","))
