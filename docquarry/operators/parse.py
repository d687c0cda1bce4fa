"""Pages to text, noise lines, sections, and blocks of prose and tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.operators.blocks import bounded, in_arrow

# Marks around tables, lines that are page furniture, section headings.
TABLE_START, TABLE_END = "⟦TABLE⟧", "⟦/TABLE⟧"
NOISE = r"(?i)^(?:\d{1,3}|table of contents|part\s+i{1,3}v?|item\s+\d{1,2}[a-c]?|[_\-=]{3,}|[^|]{2,60}\|\s*\d{4}\s+form\s+10-k\s*\|\s*\d{1,3})$"
ITEM = r"(?i)^item\s+(\d{1,2}[a-c]?)\s*[.:\-–—]?\s*(.*)$"
_MONTHS = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
YEAR = r"\b(?:19|20)\d{2}\b"
DATE = rf"(?i)\b{_MONTHS}\s+\d{{1,2}},?(?:\s+(?:19|20)\d{{2}})?|\b\d{{1,2}}/\d{{1,2}}/(?:19|20)?\d{{2}}\b"
HEADER_WORDS = rf"(?i)\b(?:{_MONTHS}|year|years|ended|months|weeks|quarter|fiscal|in millions|in thousands|in billions|dollars|except|change|% change|as of)\b"
_DURATION = r"(?i)\(\d\)|\b\d+\s+(?:months|weeks|days|years)\b"
_DROPPED_CELLS = {"", "$", "%", ")"}
_BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "table"}
_SKIPPED = {"ix:header", "script", "style", "head", "title"}
_NO_END = {"br", "meta", "link", "img", "input", "hr", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Reader(HTMLParser):
    """Collects text; blocks stand between blank lines, table rows become cells joined by bars."""

    def __init__(self, mark_tables: bool):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.cells: list[str] | None = None
        self.skip: list[str] = []
        self.mark = mark_tables

    def handle_starttag(self, tag, attrs):
        if self.skip:
            if tag == self.skip[0] and tag not in _NO_END:
                self.skip.append(tag)
            return
        style = (dict(attrs).get("style") or "").replace(" ", "")
        if tag in _SKIPPED or ("display:none" in style and tag not in _NO_END):
            self.skip = [tag]
        elif tag == "tr":
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append("")
        elif tag == "br":
            self.handle_data("\n" if self.cells is None else " ")
        elif tag in _BLOCKS and self.cells is None:
            self.out.append("\n\n" + (f"{TABLE_START}\n" if tag == "table" and self.mark else ""))

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[0]:
                self.skip.pop()
        elif tag == "tr" and self.cells is not None:
            kept = [c for c in (" ".join(x.split()) for x in self.cells) if c not in _DROPPED_CELLS]
            self.out.append(" | ".join(kept) + "\n" if kept else "")
            self.cells = None
        elif tag in _BLOCKS and self.cells is None:
            self.out.append((f"\n{TABLE_END}" if tag == "table" and self.mark else "") + "\n\n")

    def handle_data(self, data):
        if not self.skip:
            if self.cells is None:
                self.out.append(data)
            elif self.cells:
                self.cells[-1] += data


def page_text(page: str, mark_tables: bool = False) -> str:
    """Readable lines of a page without scripts, hidden parts and page furniture."""
    reader = _Reader(mark_tables)
    reader.feed(page)
    reader.close()
    text = re.sub(r"[ \t]+", " ", "".join(reader.out).replace("\xa0", " "))
    lines = [x for x in re.sub(r" *\n *", "\n", text).split("\n") if not re.match(NOISE, x.strip())]
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(lines))
    return re.sub(r"^([•●▪])\n+", r"\1 ", text, flags=re.M).strip()


def pages_to_text(pages: DataFrame, key: str = "page_id", page: str = "html", mark_tables: bool = False) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([page_text(x or "", mark_tables) for x in batch.column(1).to_pylist()], pa.string())], [key, "text"])

    return in_arrow(pages.select(key, page), of, f"{key} {pages.schema[key].dataType.simpleString()}, text string")


def drop_noise_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.trim(x).rlike(NOISE)), "\n")


def sections(filings: DataFrame, key: str, text: str = "text", least: int = 200) -> DataFrame:
    """key, n, item, title, body: a running count of headings numbers the sections; those of `least` characters or fewer go.

    A heading is a short line "Item N. Title" (or two cells of a table row); a row that ends in a page number is
    of the table of contents.
    """
    lines = filings.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    cells = F.transform(F.split("line", r"\|"), lambda c: F.trim(c))
    joined, n = F.array_join(cells, " "), F.size(cells)
    toc = (n > 1) & F.element_at(cells, -1).rlike(r"^\d+$")
    title = F.trim(F.regexp_extract(joined, ITEM, 2))
    heading = ~toc & (n <= 2) & joined.rlike(ITEM) & (F.length("line") < 200) & (F.length(title) >= 4) & ~title.rlike(r"^\p{Ll}")
    w = Window.partitionBy(key).orderBy("at")
    marked = lines.withColumn("h", heading).withColumn("n", F.sum(F.col("h").cast("int")).over(w))
    name = F.max(F.when(F.col("h"), F.concat(F.lit("Item "), F.upper(F.regexp_extract(joined, ITEM, 1)))))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("h"), F.struct("at", "line")))), lambda s: s["line"]), "\n")
    found = marked.groupBy(key, "n").agg(F.coalesce(name, F.lit("Cover")).alias("item"), F.coalesce(F.max(F.when(F.col("h"), title)), F.lit("Cover page")).alias("title"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"))
    return found.where(F.length("body") > least)


def cell_is_label(cell: Column) -> Column:
    """A cell without digits other than in dates, years, footnote marks and durations."""
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(cell, DATE, " "), YEAR, " "), _DURATION, " ")
    return ~rest.rlike(r"\d")


def row_is_header(row: Column) -> Column:
    return F.forall(F.transform(F.split(row, r"\|"), lambda c: F.trim(c)), cell_is_label)


def row_names_columns(row: Column) -> Column:
    cells = F.transform(F.split(row, r"\|"), lambda c: F.trim(c))
    return row.rlike(YEAR) | row.rlike(DATE) | row.rlike(HEADER_WORDS) | ((F.size(cells) >= 2) & F.forall(cells, lambda c: (F.length(c) > 0) & (F.length(c) <= 40)))


def is_period_row(row: Column) -> Column:
    return ~row.contains("|") & (row.rlike(DATE) | F.regexp_replace(row, r"^[ ,:]+|[ ,:]+$", "").rlike(r"^(?:19|20)\d{2}$"))


def is_group_label(row: Column) -> Column:
    upper = (F.upper(row) == row) & row.rlike(r"\p{L}")
    return ~row.contains("|") & (F.length(row) <= 80) & cell_is_label(row) & (row.endswith(":") | upper | is_period_row(row))


def header_rows(tables: DataFrame, key: str, rows: str = "rows", most: int = 5) -> DataFrame:
    """key, n_header: leading rows of labels, less trailing ones that name no columns; a date row of one of several panels belongs to the body."""
    return _with_header(tables.select(key, rows), [key], rows, most).select(key, "n_header")


def _with_header(tables: DataFrame, keep: list[str], rows: str, most: int = 5) -> DataFrame:
    """The columns to keep, the rows, n_header, and h: of each row whether it has labels only."""
    flags = lambda f: F.transform(rows, f)
    t = tables.select(*keep, F.col(rows).alias(rows), flags(row_is_header).alias("h"), flags(row_names_columns).alias("c"), flags(is_period_row).alias("p"))
    steps = F.sequence(F.lit(0), F.least(F.size(rows), F.lit(most)))
    lead = F.array_max(F.filter(steps, lambda n: F.forall(F.slice("h", 1, n), lambda x: x)))
    t = t.withColumn("lead", lead)
    named = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), F.col("lead")), lambda n: (n == 0) | F.try_element_at("c", F.greatest(n, F.lit(1))))), F.lit(0))
    t = t.withColumn("n", named)
    last = F.coalesce(F.try_element_at("p", F.greatest("n", F.lit(1))), F.lit(False)) & (F.col("n") > 0)
    later = F.exists(F.slice("p", F.col("n") + 1, F.greatest(F.size(rows) - F.col("n"), F.lit(0))), lambda x: x)
    return t.select(*keep, rows, "h", (F.col("n") - F.when(last & later, 1).otherwise(0)).cast("int").alias("n_header"))


def is_heading(paragraph: Column) -> Column:
    """A short paragraph of one line that does not end like a sentence."""
    return (F.length(paragraph) <= 100) & ~paragraph.contains("\n") & ~paragraph.contains("|") & ~paragraph.rlike(r"[.;,]\s*$")


#: Stands around tables while a text is split.
_CUT = "\ue000⟦CUT⟧\ue000"
BLOCK = "struct<kind: string, text: string, caption: string, header: array<string>, rows: array<string>>"


def blocks(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, blocks: paragraphs of prose, and the tables between the marks, in order. key is unique.

    A text is split around its tables. Rows between a pair of marks are a table: its header the leading
    label rows, its caption the one or two headings before it, which stay in the prose too. Without a header and
    without a number it is layout, and each row a paragraph. A mark without its other half is dropped. Texts
    without blocks, null ones too, have none.
    """
    pair = rf"(?s)^{TABLE_START}\n(.*?)\n?{TABLE_END}$"
    apart = F.regexp_replace(text, rf"(?s){TABLE_START}\n.*?{TABLE_END}", f"{_CUT}$0{_CUT}")
    cut = F.posexplode_outer(F.split(apart, _CUT, -1)).alias("at", "part")
    split_up = texts.select(key, cut).withColumn("table", F.coalesce(F.col("part").rlike(pair), F.lit(False)))
    lines = F.when(F.col("table"), F.filter(F.transform(F.split(F.regexp_extract("part", pair, 1), "\n"), lambda r: F.trim(r)), lambda r: r != "")).otherwise(F.array().cast("array<string>"))
    found = _with_header(split_up.withColumn("rows", lines), [key, "at", "part", "table"], "rows")
    whole = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    prose = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce("part", F.lit("")), f"{TABLE_START}|{TABLE_END}", ""), r"\n{2,}"), whole), lambda p: p != "")
    none = F.lit(None).cast("array<string>")
    written = lambda t: F.struct(F.lit("text").alias("kind"), t.alias("text"), F.lit(None).cast("string").alias("caption"), none.alias("header"), none.alias("rows")).cast(BLOCK)
    body = F.slice("rows", F.col("n_header") + 1, F.size("rows"))
    layout = (F.col("n_header") == 0) & F.forall("h", lambda x: x)
    data = F.struct(F.lit("table").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit("").alias("caption"), F.slice("rows", F.lit(1), F.col("n_header")).alias("header"), body.alias("rows")).cast(BLOCK)
    own = F.when(~F.col("table"), F.transform(prose, written)).when(layout, F.transform("rows", lambda r: written(F.replace(r, F.lit(" | "), F.lit(" "))))).otherwise(F.array(data))
    each = found.select(key, "at", own.alias("own")).groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "own"))), lambda s: s["own"])).alias("b"))

    def captioned(block: Column, i: Column) -> Column:
        one, two = F.get("b", i - 1), F.get("b", i - 2)
        heads = lambda x: F.coalesce((x["kind"] == "text") & is_heading(x["text"]), F.lit(False))
        caption = F.when(heads(one) & heads(two), F.concat_ws(" — ", two["text"], one["text"])).when(heads(one), one["text"]).otherwise(F.lit(""))
        return F.when(block["kind"] == "table", block.withField("caption", caption)).otherwise(block)

    return each.select(key, F.transform("b", captioned).alias("blocks"))


def structure_statistics(structured: DataFrame, by: str) -> DataFrame:
    """by, blocks, tables, with_header, with_caption, rows of texts with blocks."""
    t = structured.select(by, F.explode_outer("blocks").alias("x"))
    table = F.col("x.kind") == "table"
    return t.groupBy(by).agg(
        F.count("x").alias("blocks"), F.count_if(table).alias("tables"), F.count_if(table & (F.size("x.header") > 0)).alias("with_header"),
        F.count_if(table & (F.col("x.caption") != "")).alias("with_caption"), F.coalesce(F.sum(F.when(table, F.size("x.rows").cast("long"))), F.lit(0)).alias("rows"),
    )


def render_table(caption: Column, header: Column, rows: Column) -> Column:
    return F.concat_ws("\n", F.when(caption != "", F.concat(F.lit("Table: "), caption)), header, rows)
