import random

from docquarry.llm import html_wrappers as hw

CHROME = (
    "<html><head><title>T {n}</title><style>p{{}}</style><script>if (a<b) x='</p>';</script></head><body><header><h2>Site</h2></header>"
    "<nav><ul><li><a href=/a>A{n}</a><li><a href='/b'>B</a></ul></nav><div class='cookie-notice'>We use cookies {n}</div><!-- ad <p>x</p> -->{body}"
    "<aside>More {n}</aside><form><p>Search<input name=q></p></form><section id=comments><p>First! {n}</p></section><footer>&copy; site</footer></body></html>"
)


def test_articles_without_the_rest():
    rng = random.Random(1)
    pages, expected = [], []
    for n in range(12):
        paragraphs = [" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(5, 30))) for _ in range(rng.randrange(1, 7))]
        body = f"<article><h1>Head {n}</h1>" + "".join(f"<p>{p}" + ("</p>" if rng.random() < 0.5 else "") for p in paragraphs) + "<div class=share>Share</div></article>"
        pages.append(CHROME.format(n=n, body=body))
        expected.append("\n".join([f"Head {n}", *paragraphs]))
    wrapper = hw.infer(pages[:6])
    assert wrapper["path"] == ["html", "body", "article"]
    assert [hw.main_text(p, wrapper) for p in pages] == expected
    assert [hw.main_text(p, None) for p in pages] == expected


def test_a_host_without_article_elements():
    """The innermost element that holds the slots is found by alignment; headings that all pages have stay."""
    make = lambda n: CHROME.format(n=n, body=f"<div class=top><b>Daily {n}</b></div><div id=x class=c7><div class=c8><h1>Title {n}</h1><h2>By the desk</h2><p>{f'text{n} ' * 40}</p>" + (f"<ul><li>one {n}<li>two {n}</ul>" if n % 2 else "") + f"<p>End {n}.</p></div></div>")
    pages = [make(n) for n in range(8)]
    wrapper = hw.infer(pages[:5])
    assert wrapper["path"] == ["html", "body", "div.c7", "div.c8"] and wrapper["by_slots"] and not wrapper["boxes"]
    for n, p in enumerate(pages):
        lists = [f"one {n}", f"two {n}"] if n % 2 else []
        assert hw.main_text(p, wrapper) == "\n".join([f"Title {n}", "By the desk", f"text{n} " * 39 + f"text{n}", *lists, f"End {n}."])


def test_alignment_makes_slots_optional_and_repeated_groups():
    a = hw.wrapper_of(hw.parse("<div><h1>x</h1><p>a</p><p>b</p><dl><dt>1<dd>2<dt>3<dd>4</dl></div>"))
    b = hw.wrapper_of(hw.parse("<div><h1>y</h1><i>new</i><p>a</p></div>"))
    (div,), optional, repeated = hw._merge(a, b)[2][0]
    assert div[0] == "div" and not optional and not repeated
    assert [(hw._names(g), g[1], g[2]) for g in div[2]] == [(("h1",), False, False), (("i",), True, False), (("p",), False, True), (("dl",), True, False)]
    assert div[2][0][0][0][2][0][0][0][0] is None  # the heading is a slot
    assert [(hw._names(g), g[2]) for g in div[2][3][0][0][2]] == [(("dt", "dd"), True)]


def test_broken_markup_and_references():
    read = lambda p: hw.main_text(p, None)
    assert read("<article><h1>A &amp; B&am</h1><p><b>bold <i>x</b>  y<br>z\n\t &#233;&eacute;&nbsp;&lt;p&gt;<p>2</article>tail") == "A & B&am\nbold x y z éé <p>\n2"
    assert read("") == "" and read("plain  text") == "plain text" and read("a < b <3 & c") == "a < b <3 & c"
    assert read("<p title='a>b'>x<p>y<table><tr><td>1<td>2<tr><td>3</table>") == "x\ny\n1 2\n3"
    assert read("<script>never closed <p>x") == "" and read("<!-- open <p>x") == ""
    assert read("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>end") == "deep\nend"
    assert read("<article><p>" + "long " * 100_000 + "</article>") == ("long " * 100_000).strip()
    assert read("<article>one</article><article>two</article>") == "one\ntwo"


def test_pages_of_a_table(spark, monkeypatch):
    rows = [(n, f"https://A.example.org:8080/p/{n}", CHROME.format(n=n, body=f"<article><p>Body {n}</p></article>"), "x") for n in range(30)]
    rows += [(100, "http://b.example.net", "<main>solo</main>", "x"), (101, None, "<p>no url</p>", "x"), (102, "https://a.example.org/none", None, "x"), (103, "https://a.example.org/e", "", "x"), (None, "https://a.example.org/q", "<div>other</div>", "x"), rows[3], rows[3]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    expected = sorted([(n, u, f"Body {n}", len(f"Body {n}")) for n, u, _, _ in [*rows[:30], rows[3], rows[3]]] + [(100, "http://b.example.net", "solo", 4), (101, None, "no url", 6), (102, rows[32][1], "", 0), (103, rows[33][1], "", 0), (None, rows[34][1], "other", 5)], key=str)
    assert sorted(map(tuple, hw.extract(pages).collect()), key=str) == expected
    monkeypatch.setattr(hw, "BROADCAST_BYTES", 0), monkeypatch.setattr(hw, "BROADCAST_SAMPLE", 0)
    assert sorted(map(tuple, hw.extract(pages).collect()), key=str) == expected
    assert hw.extract(pages.where("page_id = 999")).collect() == []


def test_nothing_that_varies_beyond_the_sample_goes(spark):
    """Of 60 pages a host few are sampled; the page that differs from all others is not among them."""
    top = lambda n: f"<div class=top><b>{'long teaser ' * 30 if n == 7 else 'Daily'} {n}</b></div>"
    kinds = {
        "article": lambda n: f"<article><h1>Title {n}</h1><h2>{'A guest' if n == 7 else 'By the desk'}</h2><p>{f'text{n} ' * 9}</p></article>",
        "plain": lambda n: f"{top(n)}<div class=c7><h1>Title {n}</h1><h2>{'A guest' if n == 7 else 'By the desk'}</h2><h3>Always</h3><p>{f'text{n} ' * 40}</p><div class=q><p>On every page</p></div><div class=q><p>{'Here else' if n == 7 else 'Nearly so'}</p></div></div>",
        "moved": lambda n: "<div class=w>" + (f"<div class=c7><h1>Title {n}</h1><p>{f'text{n} ' * 40}</p></div>" if n % 20 == 7 else "") + f"<div class=c8><h1>Head {n}</h1><p>{f'word{n} ' * (4 if n % 20 == 7 else 9)}</p></div></div>",
    }
    rows = [(n, f"https://{kind}.org/{n}", CHROME.format(n=n, body=make(n))) for kind, make in kinds.items() for n in range(60)]
    got = {(r.url.split("/")[2], r.page_id): r.text.split("\n") for r in hw.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), sample=4).collect()}
    for n in range(60):
        desk = "A guest" if n == 7 else "By the desk"
        assert got["article.org", n] == [f"Title {n}", desk, " ".join([f"text{n}"] * 9)]
        teaser = [(("long teaser " * 30) + " 7").replace("  ", " "), f"Title {n}", desk] if n == 7 else [f"Title {n}", desk]  # most of page 7 is its teaser, so all of it is read
        # a heading is never dropped for being on every page, a box is
        assert got["plain.org", n] == [*teaser, "Always", " ".join([f"text{n}"] * 40), *(["On every page"] if n == 7 else []), "Here else" if n == 7 else "Nearly so"]
        moved = [f"Title {n}", " ".join([f"text{n}"] * 40)] if n % 20 == 7 else []
        assert set(moved) <= set(got["moved.org", n]) and f"Head {n}" in got["moved.org", n]


def test_boxes_in_an_article_element_stay():
    pages = [f"<main><h2>Latest</h2><div><p>Our paper</div><article><div><h2>Summary</h2></div><p>{f'text{n} ' * 20}</p></article></main>" for n in range(5)]
    wrapper = hw.infer(pages)
    assert wrapper["path"] == ["main"] and wrapper["boxes"] == [["div", "Our paper"]]
    assert hw.main_text(pages[0], wrapper).split("\n") == ["Latest", "Summary", " ".join(["text0"] * 20)]
    assert hw.infer([p.replace("main", "div") for p in pages])["boxes"] == []


def test_repeated_headings_and_paragraphs_stay():
    """What all sampled pages have is not dropped elsewhere either."""
    pages = [f"<div class=a><div class=b><h2>Summary</h2><p>{f'text{n} ' * 20}</p></div></div>" for n in range(6)]
    wrapper = hw.infer(pages)
    assert [hw.main_text(p, wrapper).split("\n")[0] for p in pages] == ["Summary"] * 6
    other = "<div class=a><div class=b><p>own own own</p><p>Summary</p></div></div>"
    assert hw.main_text(other, wrapper) == "own own own\nSummary"


def test_nothing_is_lost_or_kept_by_depth():
    read = lambda p: hw.main_text(p, None)
    deep, up = "<div>" * 300, "</div>" * 300
    assert read(f"<article>{deep}in<nav>menu</nav>{up}<p>after</p></article><p>out") == "in\nafter"
    pages = [f"<body>{deep}<h1>T{n}</h1><p>{f'w{n} ' * 30}</p>{up}<p>after {n}</p></body>" for n in range(4)]
    wrapper = hw.infer(pages)
    assert len(wrapper["path"]) > 200
    assert [hw.main_text(p, wrapper).split("\n")[0] for p in pages] == [f"T{n}" for n in range(4)]
    assert read("<div>" * 30_000 + "x<p>y") == "x\ny"


def test_class_names_of_what_is_no_article():
    """A word for an article beside one for something else does not make it one."""
    for name in "main-nav main-menu related-content newsletter-content cookie-content content-ad post-share article-tags story-promo".split():
        assert hw.main_text(f"<article><p>x</p><div class='a {name}'>no<p>none</p></div><p>y</article>", None) == "x\ny", name
    for name in "entry-header post-title content article-body".split():
        assert hw.main_text(f"<article><p>x</p><div class='a {name}'>yes</div><p>y</article>", None) == "x\nyes\ny", name


def test_attributes_are_read_as_html_reads_them():
    read = lambda p: hw.main_text(p, None)
    assert read("<article><p class=don't>a</p><p>b</p><img alt=O'Neil><p>c'd</p></article>") == "a\nb\nc'd"
    assert read('<article><p class="open>a</p><p>b</p></article>') == "a\nb"  # the quote never ends
    assert read("<p title = 'a>b' class = x data-q=\"it's\">t</p><p hidden>no</p><p class>u<br/>v") == "t\nu v"
    assert read("a <b") == "a <b" and read("x<p class='q'") == "x<p class='q'" and read("<p>x<a <p>y") == "xy"
    for odd in ('<p class="a>' * 20_000, "<" * 100_000, "<ul><li><span>" * 9_000, "<![CDATA[" * 20_000, "<a b='" * 20_001 + ">", "<script>" * 20_000, "<svg>" * 20_000):
        read(odd)  # in time that grows with the page


def test_the_wrapper_decides_without_article_elements():
    """Hosts of plain, oddly named elements: a page alone cannot tell its text from the rest, the wrapper can."""
    rng = random.Random(7)
    say = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    kinds = {
        "table": lambda n, t: f"<table class=t1><tr><td class=l><p>Home<p>News<p>Shop</td><td class=r><div class=z1><h1>Head {n}</h1><p>{t}</p><h3>Notes</h3><p>Note {n} {t}</p></div></td></tr></table><div class=z9><p>Call us<p>Or write</div>",
        "form": lambda n, t: f"<form id=page><div class=k1><p>Home<p>News</div><div class=k2><h1>Head {n}</h1><p>{t}</p><h3>Notes</h3><p>Note {n} {t}</p></div><div class=k3><p>Terms</div></form>",
        "odd": lambda n, t: f"<div class='has-sidebar'><div class=q1><p>Home<p>News</div><div class='post-{n} q2'><h1>Head {n}</h1><p>{t}</p><h3>Notes</h3><p>Note {n} {t}</p><div class=main-nav><p>Older {n}</div></div><div class=q3>All rights</div></div>",
    }
    for kind, make in kinds.items():
        texts = [say(40) for _ in range(9)]
        pages = [f"<html><body>{make(n, t)}</body></html>" for n, t in enumerate(texts)]
        wrapper = hw.infer(pages[:5])
        expected = ["\n".join([f"Head {n}", t, "Notes", f"Note {n} {t}"]) for n, t in enumerate(texts)]
        assert [hw.main_text(p, wrapper) for p in pages] == expected, kind
        assert all(hw.main_text(p, None) != x for p, x in zip(pages, expected)), kind


def test_alignment_is_longest_at_any_size():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(0, 25))] for _ in range(2))
        pairs = hw.common(a, b)
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                best[i][j] = best[i - 1][j - 1] + 1 if x == y else max(best[i - 1][j], best[i][j - 1])
        assert len(pairs) == best[-1][-1] and all(a[i] == b[j] for i, j in pairs)
        assert all(p < r and q < s for (p, q), (r, s) in zip(pairs, pairs[1:]))
    a, b = ([rng.choice("abc") for _ in range(3000)] for _ in range(2))  # nine million cells
    assert len(hw.common(a, b)) == hw._lengths(a, b)[-1] > 1500
