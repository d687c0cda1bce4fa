"""Text functions as columns: tokens, normal forms, numbers, citations, patterns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The token pattern and the stop words of the sparse index.
TOKEN = r"[a-z0-9]+(?:[.,\-'][a-z0-9]+)*"
STOP_WORDS = """
a an and are as at be been but by can could did do does for from had has have how i if in into is it its
of on or our over such than that the their them then there these they this those to under up was we were
what when where which while who whom why will with would you your also any all may more most other some
""".split()
# Words left out of question words.
QUESTION_STOP_WORDS = "what was were the and did does how much many its for in of their which with from that this year fiscal company compare".split()
# Company aliases of the rule-based filters.
ALIASES = {"AAPL": ["apple", "aapl", "iphone"], "MSFT": ["microsoft", "msft", "azure"], "NVDA": ["nvidia", "nvda"], "TSLA": ["tesla", "tsla"], "AMZN": ["amazon", "amzn", "aws"]}
FISCAL_YEAR = r"(?i)\b(?:fy\s?|fiscal\s+(?:year\s+)?)'?(20\d\d)\b"
FISCAL_YEAR_FORM = r"\b(?:fy\s?|fiscal\s+(?:year\s+)?)(20\d\d)\b"
# Words about time and what they stand for.
TEMPORAL = {"latest": "latest", "recent": "latest", "current": "latest", "last": "latest", "prior": "prior", "previous": "prior", "first": "first", "next": "next"}
# The number pattern, and the refusal that answers are compared with.
NUMBER = r"(?U)(?<![\w.\-])\$?\d[\d,]*(?:\.\d+)?%?(?![\w\-])"
REFUSAL = "i don't know based on the provided filings"
# Patterns of injected instructions.
INJECTION = {
    "override": r"\b(ignore|disregard|forget|override)\b[^.\n]{0,40}\b(previous|prior|above|earlier|all|any|the|your)\b[^.\n]{0,30}\b(instructions?|prompts?|rules|guidelines|context)\b",
    "new_instructions": r"\b(new|updated|real|actual|additional)\s+(system\s+)?(instructions?|directives?|rules)\b",
    "role_tag": r"(<\s*/?\s*(system|assistant|user|instructions?)\s*>|^\s*(system|assistant)\s*:|\[/?(INST|SYS)\])",
    "addresses_ai": r"\b(dear|attention|note to|message (to|for)|instructions? (to|for))\s+(the\s+)?(ai|assistant|chatbot|language model|llm|model|gpt)\b",
    "you_are_now": r"\byou\s+(are|must)\s+now\b|\bfrom now on\b|\bact as\b|\bpretend (to be|you)\b",
    "output_control": r"\b(respond|reply|answer|say|output|print|write)\s+(only\s+)?(with\s*[:\"“']|exactly\b|the\s+(word|phrase|following)\b)",
    "exfil_markup": r"!\[[^\]]*\]\(https?://|<img\s|https?://\S+\?(q|data|d|x)=",
}


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def straight(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("’"), F.lit("'"))


def tokens(c: Column) -> Column:
    """Index tokens: lower case, possessive endings off, stop words out."""
    own = F.lit("'s")
    found = F.transform(all_matches(straight(c), TOKEN), lambda t: F.when(F.endswith(t, own), F.left(t, F.length(t) - 2)).otherwise(t))
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS))


# What a byte is lowered to; which bytes tokens are made of, and which join parts of a token.
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
_WORD, _JOINT = (bytes(y in x for y in range(256)) for x in (b"abcdefghijklmnopqrstuvwxyz0123456789", b".,-'"))
_STOP_SIZE = max(map(len, STOP_WORDS))
_STOP = np.sort([int.from_bytes(w.encode(), "little") for w in STOP_WORDS])
#: What becomes an ASCII character when it is lowered or made straight; nothing else outside ASCII does.
_BECOMES = {"’": "'", "\u212a": "k", "\u0130": "i\u0307"}


def joined_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The index tokens of each text with a space between, and how many they are; the same as `tokens`, on the bytes of all texts at once.

    A joint is part of a token if it has a character of a word on both sides, so tokens are told by neighbouring bytes.
    """
    whole = pc.binary_join_element_wise(texts.cast(pa.binary()), pa.scalar(b""), pa.scalar(b" "), null_handling="replace", null_replacement=b"")
    data = whole.buffers()[2].to_pybytes() if len(whole) else b""
    for a, b in _BECOMES.items():
        if a.encode() in data:
            whole = pc.replace_substring(whole, a.encode(), b.encode())
    n = len(whole)
    if not n:
        return pa.array([], pa.string()), np.empty(0, np.int32)
    at = np.frombuffer(whole.buffers()[1], np.int32, n + 1, whole.offset * 4).astype(np.int64)
    low = bytearray(whole.buffers()[2])[at[0] : at[-1]].translate(_LOWER)  # a space ends each text
    at -= at[0]
    b, kept = np.frombuffer(low, np.uint8), np.frombuffer(low.translate(_WORD), bool)
    kept[1:-1] |= np.frombuffer(low.translate(_JOINT), bool)[1:-1] & kept[:-2] & kept[2:]
    own = np.flatnonzero((b[:-2] == ord("'")) & kept[:-2] & (b[1:-1] == ord("s")) & ~kept[2:])
    kept[own] = kept[own + 1] = False
    edge = np.flatnonzero(kept[1:] != kept[:-1]) + 1
    edge = np.concatenate(([0], edge)) if kept[0] else edge
    start, end = edge[::2], edge[1::2]
    short = np.flatnonzero(end - start <= _STOP_SIZE)
    first, size, word = start[short], (end - start)[short], np.zeros(len(short), np.int64)
    for j in range(_STOP_SIZE):
        word += np.where(j < size, b[np.minimum(first + j, len(b) - 1)].astype(np.int64) << 8 * j, 0)
    stop = _STOP[np.minimum(np.searchsorted(_STOP, word), len(_STOP) - 1)] == word
    for j in range(_STOP_SIZE):
        kept[first[stop & (j < size)] + j] = False
    there = np.ones(len(start), bool)
    there[short[stop]] = False
    start, end = start[there], end[there]
    up_to = np.searchsorted(start, at)  # tokens before each text
    number = np.diff(up_to)
    b[end] = ord(" ")
    kept[end] = True
    kept[end[up_to[1:][number > 0] - 1]] = False  # none after the last
    places = (np.concatenate(([0], np.cumsum(end - start + 1)))[up_to] - np.concatenate(([0], np.cumsum(number > 0)))).astype(np.int32)
    valid = None if not texts.null_count else pa.py_buffer(np.packbits(texts.is_valid().to_numpy(zero_copy_only=False), bitorder="little"))
    return pa.Array.from_buffers(pa.string(), n, [valid, pa.py_buffer(places), pa.py_buffer(b[kept])]), number.astype(np.int32)


def split_tokens(joined: pa.Array) -> pa.Array:
    """The lists of joined tokens."""
    lists = pc.split_pattern(joined, " ")
    none = pc.fill_null(pc.equal(joined, ""), True)
    if not pc.any(none).as_py():
        return lists
    # Not by pc.if_else, which takes wrong bytes from slices (Arrow 23).
    flat, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False) * ~none.to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), flat.filter(pc.not_equal(flat, "")))


def apart(c: Column) -> Column:
    """The tokens of a joined column."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def question_words(c: Column) -> Column:
    return F.array_except(F.array_distinct(all_matches(F.lower(c), "[a-z0-9]{3,}")), strings(QUESTION_STOP_WORDS))


def word_set(c: Column) -> Column:
    return F.array_distinct(all_matches(F.lower(c), "[a-z0-9]+"))


def jaccard(a: Column, b: Column) -> Column:
    """Equal sets are 1, also if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def coverage(a: Column, b: Column) -> Column:
    """Share of a's distinct members that are in b; 0 for none."""
    n = F.size(F.array_distinct(a))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(n, F.lit(1)))


def normalize_question(c: Column) -> Column:
    q = F.regexp_replace(straight(c), FISCAL_YEAR_FORM, "fiscal $1")
    q = F.regexp_replace(q, r"[^\p{L}\p{N}_\s%$.']", " ")
    q = F.regexp_replace(q, r"(?<!\d)\.|\.(?!\d)", " ")
    return F.trim(F.regexp_replace(q, r"\s+", " "))


def tickers(c: Column) -> Column:
    low = F.lower(c)
    return F.array_compact(F.array(*(F.when(low.rlike(rf"\b(?:{'|'.join(names)})\b"), F.lit(t)) for t, names in ALIASES.items())))


def fiscal_years(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(all_matches(c, FISCAL_YEAR, 1), lambda y: y.cast("int"))))


def years(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(all_matches(c, r"\b(20\d\d)\b", 1), lambda y: y.cast("int"))))


def temporal_words(c: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in TEMPORAL.items() for x in kv))
    found = F.transform(all_matches(normalize_question(c), "[a-z]+"), lambda w: F.try_element_at(known, w))
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def is_refusal(c: Column) -> Column:
    return straight(c).contains(REFUSAL)


def without_citations(c: Column) -> Column:
    return F.regexp_replace(c, r"\[\d+\]", " ")


def norm_number(c: Column) -> Column:
    s = F.replace(F.regexp_replace(F.regexp_replace(c, r"^\$+", ""), "%+$", ""), F.lit(","), F.lit(""))
    return F.when(s.contains("."), F.regexp_replace(F.regexp_replace(s, "0+$", ""), r"\.$", "")).otherwise(s)


def numbers(c: Column, skip_trivial: bool = True) -> Column:
    """Distinct numbers in normal form; answers leave out years and lone digits."""
    raw = F.transform(all_matches(c, NUMBER), lambda m: F.regexp_replace(m, ",+$", ""))
    if skip_trivial:
        def fact(m: Column) -> Column:
            n = norm_number(m)
            year = n.rlike(r"^(19\d\d|20\d\d|2100)$") & ~m.contains(",")
            return ~(year | (n.rlike(r"^\d$") & ~m.endswith("%")))

        raw = F.filter(raw, fact)
    return F.filter(F.array_distinct(F.transform(raw, norm_number)), lambda n: n != "")


def citations(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(all_matches(c, r"\[(\d+)\]", 1), lambda n: n.cast("int"))))


def by_length(c: Column) -> Column:
    """Texts ordered by length, then by themselves."""
    return F.transform(F.array_sort(F.transform(c, lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))), lambda s: s["x"])


def injections(c: Column) -> Column:
    return F.array_compact(F.array(*(F.when(c.rlike("(?im)" + p), F.lit(name)) for name, p in INJECTION.items())))


def expand_terms(text: Column, ticker: Column) -> Column:
    """Synonyms of the filings' vocabulary, appended in parentheses if the text lacks them."""
    extra = F.array_compact(F.array(*(
        F.when(text.rlike("(?i)" + p) & ~F.lower(text).contains(term) & (F.lit(True) if who is None else F.coalesce(ticker == who, F.lit(False))), F.lit(term)) for who, p, term in VOCABULARY
    )))
    return F.when(F.size(extra) > 0, F.concat(text, F.lit(" ("), F.array_join(extra, ", "), F.lit(")"))).otherwise(text)


# Whose vocabulary, pattern, term.
VOCABULARY = [
    (None, r"\b(workforce|headcount|staff)\b", "employees"),
    (None, r"\bbuybacks?\b", "share repurchases"),
    (None, r"\b(capex|capital expenditures?)\b", "purchases of property and equipment"),
    ("AMZN", r"\brevenues?\b", "net sales"),
    ("AAPL", r"\brevenues?\b", "net sales"),
    ("TSLA", r"\brevenues?\b", "total revenues"),
]
