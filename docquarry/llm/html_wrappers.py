"""Main text of web pages by wrappers inferred as union-free regular expressions.

Pages of one host are made from one template. A wrapper is inferred from some pages of the host: the token stream
of the first page is its first form, and each further page is aligned with it. Texts that differ become text
slots, runs of alike elements (alone or in twos and threes) become repeated groups, and elements that one side
lacks become optional groups; no unions arise. The slots then tell where the host's article lies: the article or
main element that holds a fair share of them, else the innermost element that holds most of them. Boxes within it,
outside of article elements, that are equal on all pages are the template's. Headings and paragraphs are never
dropped for being equal on all pages.

A wrapper comes from a few pages. Whatever it would take away (boxes, and what lies beside an element that was
found by its slots alone) is confirmed on all pages of the host first, and the latter on each page as it is read.

Elements that are never article text (menus, headers, footers, sidebars, notices, adverts, scripts, styles) are
known by their tags and roles. Class names and forms are only taken for such a sign where the article does not lie
within: the element that the wrapper leads to is read whatever its class.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import as_text, checkpointed, slices, table, text_column

#: Pages of each host that its wrapper is inferred from, at most: the least and the greatest hash of each of half as many slices.
SAMPLE_PAGES = 8
#: Sampled pages whose keys are broadcast at most; beyond that they are joined by a shuffle.
BROADCAST_SAMPLE = 500_000
#: Bytes of wrappers that are broadcast at most; beyond that pages and wrappers are joined by host.
BROADCAST_BYTES = 32 << 20
#: An element must hold this share of its parent's slot text for the article to lie within it.
MAIN_SHARE = 0.7
#: An article or main element must hold this share of the host's slot text to be taken for its tag.
HINT_SHARE = 0.2
#: Boxes of the template are told apart from data only where so many different pages were aligned; longer ones are left as text.
LEAST_PAGES, BOX_CHARS = 3, 1000

# How HTML names its elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
BOXES = set("div section ul ol dl table fieldset details center".split())
CLOSES_P = BLOCKS - set("option optgroup caption td th tr tbody thead tfoot legend summary head html body".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
NEVER_TEXT = set("head script style noscript template textarea title iframe svg math nav header footer aside button select input option menu dialog canvas object audio video map".split())
NEVER_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
CHROME_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promos promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side aside footer header masthead cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus respond replies reviews widget widgets toolbar pagination pager skip hidden gdpr disclaimer tags".split()
)
#: A header of these is the article's own, not the site's.
ARTICLE_WORDS = set("article post entry story".split())
#: Articles of these classes are readers' or other pages' articles.
OTHER_ARTICLES = re.compile(r"(?:^|\s)(?:comment|related|recommended|promo|sponsored|teaser)", re.I)

PLAIN, DOUBTFUL, NEVER = 0, 1, 2

_OPENING = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|(!--)|(!\[CDATA\[)|[!?/])")
_ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)?+(\s*+=\s*+)?+")
_UNQUOTED = re.compile(r"[^\s>]*+")
_WANTED = {"class", "id", "role", "hidden", "aria-hidden"}
_PARTS = re.compile(r"[-_\s]+")
#: Classes that number their page.
_NUMBERED = re.compile(r".*[-_]\d+$")


@lru_cache(maxsize=20_000)
def kind_of(tag: str, classes: str, identity: str, role: str, hidden: bool) -> tuple[str, int]:
    """name, mark: the tag and its classes, as wrappers tell elements apart; whether it can hold article text."""
    name = ".".join([tag, *sorted(c for c in set(classes.split()) if not _NUMBERED.match(c))])
    if tag in NEVER_TEXT or hidden or role.lower() in NEVER_ROLES:
        return name, NEVER
    if tag in ("article", "main"):
        return name, DOUBTFUL if OTHER_ARTICLES.search(classes) else PLAIN
    if tag in ("html", "body"):
        return name, PLAIN
    for one in f"{classes} {identity}".split():
        words = [w.lower() for w in _PARTS.split(one) if w]
        own = {k + 1 for k, w in enumerate(words) if w in ARTICLE_WORDS}
        if any(w in CHROME_WORDS and not (w == "header" and k in own) for k, w in enumerate(words)):
            return name, DOUBTFUL
    return name, DOUBTFUL if tag == "form" or role.lower() == "form" else PLAIN


class Page:
    """Elements and decoded texts in order, the root first: tag, name, mark, parent, end (one past all that lies within), text (of elements: None), before (characters of all texts before)."""

    def __init__(self):
        self.tag, self.name, self.mark, self.parent, self.end, self.text = ["#root"], ["#root"], [PLAIN], [-1], [0], [None]

    def add(self, parent: int, tag: str, name: str, mark: int, text: str | None) -> int:
        self.tag.append(tag), self.name.append(name), self.mark.append(mark), self.parent.append(parent), self.end.append(0), self.text.append(text)
        return len(self.tag) - 1

    def kids(self, i: int) -> Iterator[int]:
        k = i + 1
        while k < self.end[i]:
            yield k
            k = self.end[k]

    def close(self) -> None:
        for i in range(len(self.tag) - 1, -1, -1):
            self.end[i] = max(self.end[i], i + 1)
            if i:
                p = self.parent[i]
                self.end[p] = max(self.end[p], self.end[i])
        self.before = list(accumulate((len(t.strip()) if t else 0 for t in self.text), initial=0))

    def size(self, i: int) -> int:
        return self.before[self.end[i]] - self.before[i]


def _attributes(page: str, at: int, dead: dict[str, bool]) -> tuple[dict[str, str], bool, int]:
    """The attributes wanted, whether the tag closes itself, and where it ends (-1: it does not). A quote that never ends is read as any other character."""
    found, size = {}, len(page)
    while True:
        m = _ATTRIBUTE.match(page, at)
        before, at = at, m.end()
        name = m[1]
        if m[2]:
            q = page[at : at + 1]
            if q in ('"', "'") and not dead.get(q):
                end = page.find(q, at + 1)
                if end < 0:
                    dead[q] = True
            if q in ('"', "'") and not dead.get(q):
                value, at = page[at + 1 : end], end + 1
            else:
                u = _UNQUOTED.match(page, at)
                value, at = u[0], u.end()
            if (low := name.lower()) in _WANTED:
                found.setdefault(low, value)
            name = None
        if name is not None and (low := name.lower()) in _WANTED:
            found.setdefault(low, "")
        if at >= size:
            return found, False, -1
        if page[at] == ">":
            return found, at > before and page[at - 1] == "/" and m[2] is None, at + 1


def parse(page: str) -> Page:
    """The page's elements and decoded texts. Missing end tags are taken as HTML takes them; stray ones are ignored. What lies in elements that are never text is left out."""
    out = Page()
    stack, tags, is_open, never = [0], ["#root"], Counter(), 0  # never: depth of the outermost open element that is never text
    at, size, last = 0, len(page), page.rfind(">")
    dead: dict[str, bool] = {}

    def text(a: int, b: int) -> None:
        if b > a and not never:
            out.add(stack[-1], "#text", "#text", PLAIN, html.unescape(page[a:b]) if "&" in page[a:b] else page[a:b])

    def cut(depth: int) -> None:
        nonlocal never
        for t in tags[depth:]:
            is_open[t] -= 1
        if never and depth <= never:
            never = 0
        for i in stack[depth:]:
            if i:
                out.end[i] = len(out.tag)
        del stack[depth:], tags[depth:]

    since = 0
    while True:
        m = _OPENING.search(page, at)
        if m is None or m.start() > last and m[3] is None and m[4] is None:
            break
        begin, at = m.start(), m.end()
        if m[3]:
            text(since, begin)
            end = page.find("-->", at - 2)
            at = since = size if end < 0 else max(at, end + 3)
            continue
        if m[4]:
            end = -1 if dead.get("]]>") else page.find("]]>", at)
            if end < 0:
                dead["]]>"] = True
                continue
            text(since, begin)
            if not never:
                out.add(stack[-1], "#text", "#text", PLAIN, page[at:end])
            at = since = end + 3
            continue
        if m[2] is None:
            text(since, begin)
            at = since = page.index(">", at) + 1
            continue
        if page[at : at + 1] == ">":
            attributes, closes, after = {}, False, at + 1
        else:
            attributes, closes, after = _attributes(page, at, dead)
        text(since, begin)
        if after < 0:  # the page ends within a tag
            since = size
            break
        at = since = after
        tag = m[2].lower()
        if m[1]:
            if is_open[tag]:
                depth = len(tags) - 1
                while tags[depth] != tag:
                    depth -= 1
                cut(depth)
            continue
        if tag in CLOSES_P or tag in CLOSED_BY:
            closing = CLOSED_BY.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            if any(is_open[t] for t in closing):
                bound = {"ul", "ol", "menu"} if tag == "li" else {"table"} if tag in ("tr", "td", "th", "tbody") else {"dl"} if tag in ("dt", "dd") else {"table", "td", "th", "button"}
                for k in range(len(tags) - 1, 0, -1):
                    if tags[k] in closing:
                        cut(k)
                        if tag not in ("tr", "tbody"):
                            break
                    elif tags[k] in bound or tags[k] in BLOCKS and tags[k] not in closing:
                        break
        name, mark = kind_of(tag, attributes.get("class", ""), attributes.get("id", ""), attributes.get("role", "").strip(), "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true")
        k = 0 if never else out.add(stack[-1], tag, name, mark, None)
        if tag in VOID or closes and tag not in BLOCKS:
            continue
        if tag in RAW:
            end = None if dead.get(tag) else re.compile(rf"</{re.escape(tag)}(?=[\s>/])[^>]*>", re.I).search(page, at)
            dead[tag] = end is None
            if end is not None:
                at = since = end.end()
            elif tag in ("script", "style", "textarea", "title", "iframe"):
                at = since = size
            continue
        if mark == NEVER and not never:
            never = len(stack)
        stack.append(k), tags.append(tag)
        is_open[tag] += 1
    text(since, size)
    out.close()
    return out


# A wrapper's element is [name, mark, groups]; a group is [nodes, optional, repeated].


class Text(list):
    """[what all pages have (None: a slot), characters, places]"""


def _name(node: list) -> str:
    return "#text" if isinstance(node, Text) else node[0]


def _names(group: list) -> tuple:
    return tuple(map(_name, group[0]))


def wrapper_of(page: Page) -> list:
    """The wrapper of one page: each element's children in order, runs of alike ones folded into repeated groups."""
    under: dict[int, list] = defaultdict(list)
    for i in range(len(page.tag) - 1, -1, -1):
        if page.text[i] is not None:
            words = " ".join(page.text[i].split())
            node = Text([words, len(words), 1]) if words else None
        else:
            node = [page.name[i], page.mark[i], _folded(under.pop(i, [])[::-1])]
        if node is not None and i:
            under[page.parent[i]].append(node)
    return node


def _folded(nodes: list) -> list:
    names, groups, at = [_name(n) for n in nodes], [], 0
    while at < len(nodes):
        for width in (1, 2, 3):
            times = 1
            while names[at : at + width] == names[at + times * width : at + (times + 1) * width] and at + width <= len(nodes):
                times += 1
            if times > 1 and names[at] != "#text":
                folded = nodes[at : at + width]
                for t in range(1, times):
                    folded = [_merge(a, b) for a, b in zip(folded, nodes[at + t * width : at + (t + 1) * width])]
                groups.append([folded, False, True])
                at += times * width
                break
        else:
            groups.append([[nodes[at]], False, False])
            at += 1
    return groups


def _merge(a: list, b: list) -> list:
    """b taken into a, both of one name: texts that differ make a slot; children are aligned, and what one side lacks is optional."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        if isinstance(x, Text):
            x[:] = x[0] if x[0] == y[0] else None, x[1] + y[1], x[2] + y[2]
            continue
        x[1] = max(x[1], y[1])
        ours, theirs, groups, i, j = x[2], y[2], [], 0, 0
        for p, q in [*common([_names(g) for g in ours], [_names(g) for g in theirs]), (len(ours), len(theirs))]:
            groups += [[g[0], True, g[2]] for g in ours[i:p]] + [[g[0], True, g[2]] for g in theirs[j:q]]
            if p < len(ours):
                groups.append([ours[p][0], ours[p][1] or theirs[q][1], ours[p][2] or theirs[q][2]])
                todo += zip(ours[p][0], theirs[q][0])
            i, j = p + 1, q + 1
        x[2] = groups
    return a


def _lengths(a: list, b: list) -> np.ndarray:
    """Of each beginning of b, the length of its longest common subsequence with a: one big-integer step for each item of a."""
    where: dict = defaultdict(int)
    for j, w in enumerate(b):
        where[w] |= 1 << j
    full = v = (1 << len(b)) - 1
    for w in a:
        u = v & where.get(w, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(-(-len(b) // 8), "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, in memory that grows with a and b alone: halves of a meet the cut of b that serves both best."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            out += [(a0, j) for j in range(b0, b1) if a[a0] == b[j]][:1]
            continue
        mid, part = (a0 + a1) // 2, b[b0:b1]
        split = b0 + int(np.argmax(_lengths(a[a0:mid], part) + _lengths(a[mid:a1][::-1], part[::-1])[::-1]))
        todo += [(a0, mid, b0, split), (mid, a1, split, b1)]
    return sorted(out)


def _preorder(root: list) -> list[tuple[list, int, bool, bool]]:
    """node, place of its parent, whether an element above it is doubtful, whether its group is repeated."""
    out, todo = [], [(root, -1, False, False)]
    while todo:
        node, parent, doubt, repeated = todo.pop()
        out.append((node, parent, doubt, repeated))
        if not isinstance(node, Text):
            todo += [(n, len(out) - 1, doubt or node[1] == DOUBTFUL, g[2]) for g in reversed(node[2]) for n in reversed(g[0])]
    return out


def _slots(nodes: list, pages: int, doubtful: bool) -> list[int]:
    """Of each node, the characters that vary: slots and texts that some page lacks. Doubtful elements count as empty unless asked for."""
    mass = [0] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        node, parent, _, _ = nodes[k]
        if isinstance(node, Text):
            mass[k] = node[1] if node[0] is None or node[2] < pages else 0
        if parent >= 0 and (doubtful or isinstance(node, Text) or node[1] == PLAIN):
            mass[parent] += mass[k]
    return mass


def infer(pages: list[str]) -> dict:
    """What is read from the wrapper of some pages of a host.

    path: names from the root to the element that holds the article (of one page: None); by_slots: no tag led there;
    boxes: [name, text] of what all pages have in it and no article element holds; constants: texts of all pages.
    """
    different = [parse(p) for p in dict.fromkeys(pages)]
    if len(different) < 2:
        return {"path": None, "by_slots": False, "boxes": [], "constants": []}
    whole = wrapper_of(different[0])
    for p in different[1:]:
        _merge(whole, wrapper_of(p))
    nodes = _preorder(whole)
    plain, full = _slots(nodes, len(different), False), _slots(nodes, len(different), True)
    doubtful = plain[0] < HINT_SHARE * full[0]
    mass = full if doubtful else plain
    kids: dict[int, list[int]] = defaultdict(list)
    for k, (node, parent, _, _) in enumerate(nodes):
        if not isinstance(node, Text):
            kids[parent].append(k)

    def tag(k: int) -> str:
        return nodes[k][0][0].split(".")[0]

    hints = [k for k, (n, _, under, _) in enumerate(nodes) if not isinstance(n, Text) and n[1] == PLAIN and tag(k) in ("article", "main") and full[k] >= (MAIN_SHARE if under else HINT_SHARE) * full[0] and full[k]]
    if hints:
        best = max(full[k] for k in hints)
        last = next(k for k in hints if full[k] >= MAIN_SHARE * best)
    else:
        last = 0
        while True:
            inside = [k for k in kids[last] if not nodes[k][3] and nodes[k][0][1] <= (DOUBTFUL if doubtful else PLAIN) and tag(k) in BLOCKS]
            top = max(inside, key=lambda k: mass[k], default=None)
            if top is None or not mass[last] or mass[top] < MAIN_SHARE * mass[last] or not any(tag(k) in BLOCKS for k in kids[top]):
                break
            last = top
    path, k = [], last
    while k > 0:
        path.insert(0, nodes[k][0][0])
        k = nodes[k][1]
    by_slots = bool(path) and not hints
    constants = {n[0] for n, _, _, _ in nodes if isinstance(n, Text) and n[0] is not None and n[2] >= len(different)}
    boxes: set[tuple[str, str]] = set()
    if len(different) >= LEAST_PAGES:
        boxes = set.intersection(*(_boxes(p, _regions(p, path)) for p in different))
    return {"path": path or None, "by_slots": by_slots, "boxes": sorted(map(list, boxes)), "constants": sorted(constants) if by_slots else []}


def _boxes(page: Page, regions: list[int]) -> set[tuple[str, str]]:
    """name, text of the boxes in the regions that lie in no article element; of BOX_CHARS at most."""
    out = set()
    for r in regions:
        k = r + 1
        while k < page.end[r] and page.tag[r] != "article":
            if page.tag[k] == "article" or page.text[k] is not None or page.mark[k] != PLAIN:
                k = page.end[k]
                continue
            if page.tag[k] in BOXES and 0 < page.size(k) <= BOX_CHARS and (text := "\n".join(blocks(page, k))):
                out.add((page.name[k], text))
            k += 1
    return out


def _seen(text: str, wrapper: dict) -> list[tuple[int, str, int, int]]:
    """depth, text, 1, characters: of each element on the path (or the last one alone) all that it holds (text ""), the wrapper's constants, and its boxes (depth -1)."""
    page, path, constants, out = parse(text), wrapper["path"] or [], set(wrapper["constants"]), []
    for depth in range(0 if wrapper["by_slots"] else len(path), len(path) + 1):
        found = [b for r in _regions(page, path[:depth]) for b in blocks(page, r)]
        out.append((depth, "", int(bool(found)), sum(map(len, found))))
        out += [(depth, c, 1, len(c) * found.count(c)) for c in constants.intersection(found)]
    there = _boxes(page, _regions(page, path)) if wrapper["boxes"] else set()
    return out + [(-1, json.dumps(b), 1, 0) for b in wrapper["boxes"] if tuple(b) in there]


def _settled(wrapper: dict, seen: dict[tuple[int, str], tuple[int, int]]) -> dict:
    """The wrapper as far as all pages bear it out: the path up to the last element that holds MAIN_SHARE of what varies around it, and boxes that no page lacks."""
    path, last = wrapper["path"] or [], len(wrapper["path"] or [])

    def varying(depth: int) -> int:
        pages, chars = seen.get((depth, ""), (0, 0))
        return chars - sum(m for (d, c), (n, m) in seen.items() if d == depth and c and n >= pages)

    pages = seen.get((last, ""), (0, 0))[0]
    boxes = [b for b in wrapper["boxes"] if pages and seen.get((-1, json.dumps(b)), (0, 0))[0] >= pages]
    if wrapper["by_slots"]:
        held = path[: next((d for d in range(last) if varying(d + 1) < MAIN_SHARE * varying(d)), last)]
        path, boxes = held, boxes if held == path else []
    everywhere = seen.get((0, ""), (0, 0))[0]
    return {"path": path or None, "by_slots": wrapper["by_slots"], "boxes": boxes, "constants": [c for c in wrapper["constants"] if wrapper["by_slots"] and seen.get((0, c), (0, 0))[0] >= everywhere]}


def _regions(page: Page, path: list[str]) -> list[int]:
    found = [0]
    for name in path:
        found = [k for f in found for k in page.kids(f) if page.name[k] == name and page.mark[k] != NEVER]
    return found


def _own_regions(page: Page) -> list[int]:
    """Where a page's text lies by its tags alone: its outermost main elements, else its articles, else the whole page. Those in doubtful elements count if they hold most of the page."""
    for doubt in (False, True):
        for wanted in ("main", "article"):
            out, k = [], 1
            while k < len(page.tag):
                if page.mark[k] == DOUBTFUL and not doubt:
                    k = page.end[k]
                elif page.tag[k] == wanted and page.mark[k] == PLAIN:
                    out.append(k)
                    k = page.end[k]
                else:
                    k += 1
            if out and (not doubt or sum(map(page.size, out)) >= MAIN_SHARE * page.size(0)):
                return out
    return [0]


def blocks(page: Page, of: int, boxes: frozenset | set = frozenset()) -> list[str]:
    """The text of each block of an element in order, white space folded; without what is never text and, outside of article elements, the boxes (name, text) given."""
    out: list[str] = []
    line: list[str] = []
    ends: list[int] = []  # where the open blocks end
    names = {n for n, _ in boxes}
    article = page.end[of] if page.tag[of] == "article" else 0

    def close() -> None:
        if words := " ".join("".join(line).split()):
            out.append(words)
        line.clear()

    k = of + 1
    while k < page.end[of]:
        while ends and k >= ends[-1]:
            close()
            ends.pop()
        tag = page.tag[k]
        if page.text[k] is not None:
            line.append(page.text[k])
        elif page.mark[k] != PLAIN:
            k = page.end[k]
            continue
        elif tag == "br" or tag in ("td", "th"):
            line.append(" ")
        elif tag in BLOCKS:
            close()
            if names and k >= article and page.name[k] in names and page.size(k) <= BOX_CHARS and (page.name[k], "\n".join(blocks(page, k))) in boxes:
                k = page.end[k]
                continue
            ends.append(page.end[k])
            if tag == "article":
                article = max(article, page.end[k])
        k += 1
    close()
    return out


def _held(page: Page, path: list[str], constants: set[str]) -> list[str]:
    """The path up to the last element that holds MAIN_SHARE of this page's own text around it."""
    sizes = [sum(len(b) for r in _regions(page, path[:d]) for b in blocks(page, r) if b not in constants) for d in range(len(path) + 1)]
    return path[: next((d for d in range(len(path)) if sizes[d + 1] < MAIN_SHARE * sizes[d]), len(path))]


def main_text(text: str, wrapper: dict | None) -> str:
    """The article's blocks, joined by line breaks. A page that lacks the wrapper's article is read by its own main or article element, else whole."""
    page = parse(text)
    path, boxes = (wrapper["path"], {tuple(b) for b in wrapper["boxes"]}) if wrapper else (None, set())
    if path and wrapper["by_slots"]:
        held = _held(page, path, set(wrapper["constants"]))
        path, boxes = held, boxes if held == path else set()
    regions = _regions(page, path) if path else []
    found = [b for r in regions for b in blocks(page, r, boxes)]
    if not found:
        found = [b for r in _own_regions(page) for b in blocks(page, r)]
    return "\n".join(found)


def _host(url: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _confirmed(placed: DataFrame, found: DataFrame) -> DataFrame:
    """host, wrapper: those that would take text away (open) as far as all pages (host, html) bear them out. Counts are summed before the shuffle."""
    ready, todo = found.where("NOT open").select("host", "wrapper"), found.where("open").select("host", "wrapper")
    size = todo.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0]
    if size is None:
        return ready
    joined = placed.select("host", "html").where("html != ''").join(F.broadcast(todo) if size <= BROADCAST_BYTES else todo, "host")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            total: dict[tuple, list[int]] = {}
            for host, page, w in zip(*(batch.column(c).to_pylist() for c in range(3))):
                for depth, text, n, chars in _seen(page, json.loads(w)):
                    sums = total.setdefault((host, depth, text), [0, 0])
                    sums[0] += n
                    sums[1] += chars
            rows = [(*k, *v) for k, v in total.items()]
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["host", "depth", "text", "n", "chars"])

    sums = joined.select("host", "html", "wrapper").mapInArrow(count, "host string, depth int, text string, n long, chars long").groupBy("host", "depth", "text").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))

    def of(pdf):
        import pandas as pd

        seen = {(d, t): (n, m) for d, t, n, m in zip(pdf["depth"], pdf["text"], pdf["n"], pdf["chars"])}
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(_settled(json.loads(pdf["wrapper"].iloc[0]), seen))]})

    return ready.unionByName(sums.join(todo, "host").groupBy("host").applyInPandas(of, "host string, wrapper string"))


def wrappers(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", sample: int = SAMPLE_PAGES) -> DataFrame:
    """host, wrapper (JSON) of every host, from `sample` of its pages at most, confirmed on all of them. The pages are chosen by an aggregate of hashes, of which each task sends on one row a host."""
    placed = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"), _host(url).alias("host"), F.col(page).cast("string").alias("html"))
    order, parts = F.xxhash64("k", "u"), max(1, sample // 2)
    hashed = placed.select("host", order.alias("h")).select("host", "h", F.pmod("h", F.lit(parts)).alias("part"))
    ends = hashed.groupBy("host").agg(*(f(F.when(F.col("part") == n, F.col("h"))).alias(f"{f.__name__}{n}") for n in range(parts) for f in (F.min, F.max)))
    some = checkpointed(ends.select("host", F.explode(F.array_distinct(F.array(*ends.columns[1:]))).alias("h")).where("h IS NOT NULL"))
    if some.count() <= BROADCAST_SAMPLE:
        some = F.broadcast(some)
    taken = placed.withColumn("h", order).join(some, ["host", "h"], "left_semi").groupBy("host", "k", "u").agg(F.min("html").alias("html"))

    def of(pdf):
        import pandas as pd

        w = infer([x for x in pdf.sort_values(["k", "u"])["html"] if x])
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(w)], "open": [w["by_slots"] or bool(w["boxes"])]})

    return _confirmed(placed, checkpointed(taken.groupBy("host").applyInPandas(of, "host string, wrapper string, open boolean")))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", sample: int = SAMPLE_PAGES) -> DataFrame:
    """key, url, text, n_chars of every page.

    A null or empty page has an empty text; a page without a host is of the host "". Hosts with one page, and
    pages that do not fit their host's wrapper, are read by their own main or article element. Repeated rows are
    read each. An empty table gives no rows.
    """
    found = checkpointed(wrappers(pages, key, url, page, sample))
    size = found.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    placed = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), text_column(page).alias("html"), _host(url).alias("host"))
    joined = placed.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "host", "left")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in slices(batches):
            out = []
            for p, w in zip(as_text(batch.column(2)), batch.column(3).to_pylist()):
                if w is not None and w not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[w] = json.loads(w)
                out.append(main_text(p, known.get(w)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], [key, url, "text", "n_chars"])

    return joined.select("k", "u", "html", "wrapper").mapInArrow(of, f"{key} {kinds[key]}, {url} {kinds[url]}, text string, n_chars long")


def op7_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op7_wrapper_extraction": op7_wrapper_extraction}
ORACLES: dict[str, str] = {}
