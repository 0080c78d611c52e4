"""Main texts of pages against the standard library's parser, and of written pages."""

from html.parser import HTMLParser

import pytest

from lakekit.llm import maintext, queries

TABLES = "/root/testdata/sf0.01"


class Article(HTMLParser):
    """All text inside article elements, with a space at each tag that is no inline one."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.gap(tag)

    def handle_endtag(self, tag):
        self.gap(tag)
        self.depth -= tag == "article"

    def gap(self, tag):
        if tag not in ("b", "i", "a", "em", "strong", "span"):
            self.parts.append(" ")

    def handle_data(self, data):
        if self.depth:
            self.parts.append(data)


def test_query(spark):
    pages = spark.read.parquet(f"{TABLES}/pages.parquet").collect()
    rows = {r.page_id: r for r in queries.QUERIES["op11_main_text"](spark, TABLES).collect()}
    assert len(rows) == len(pages)
    for page in pages:
        parser = Article()
        parser.feed(page.html or "")
        parser.close()
        text = " ".join("".join(parser.parts).split())
        assert (rows[page.page_id].url, rows[page.page_id].text, rows[page.page_id].n_chars) == (page.url, text, len(text))
    assert any(r.text for r in rows.values())


LONG = "Words of a story that goes on for a while, as stories do. " * 4

CASES = {
    "marked": (f"<body><nav>Menu</nav><header>Site</header><article><h1>T</h1><p>One<p>Two</article><footer>F</footer>{LONG}", "T One Two"),
    "inside": (
        "<article><p>a <b>b</b>c<br>d</p><aside>no</aside><div class='ad'>no</div><form>no<input></form><script>'</article>'</script>"
        "<p>e</p><div id=comments><p>no</p><article class=comment>no</article></div><ul><li>f<li>g</ul></article>",
        "a bc d e f g",
    ),
    "references": ("<article>&lt;p&gt;&nbsp;&amp;amp; &copy &eacute;&#x41;&#66; &nosuch; &am</article>", "<p> &amp; © éAB &nosuch; &am"),
    "space": ("<article>\n\t a    b\r\n</article>", "a b"),
    "unclosed": ("<nav>m</nav><article><p>one<div>two<!-- three", "one two"),
    "wrapped": ("<form id=page><div class='with-sidebar main-header'><article class='post has-comments'>x</article></div></form>", "x"),
    "readers": ("<section class=comments><article>no</article></section><article>yes</article>", "yes"),
    "main part": ("<div>no</div><main><p>yes</p><nav>no</nav></main>", "yes"),
    "hidden article": (f"<aside><article>no</article></aside><p>{LONG}</p>", LONG.strip()),
    "no marks": (
        f"<ul><li><a href=/>Home</a><li><a href=/x>Other pages of this site that one may want to read</a></ul><h1>Title</h1><p>{LONG}</p>"
        f"<p>Short.</p><p>{LONG}</p><footer>f</footer><p>&copy; 2020 us</p>",
        f"Title {LONG.strip()} Short. {LONG.strip()}",
    ),
    "little text": ("<p>Hello</p>", "Hello"),
    "only links": ("<ul><li><a href=/>Home</a></ul>", ""),
    "attributes": ("<article><p title='a > b' data-x=\"</article>\">text</p></article>", "text"),
    "quote never closed": ("<article>a<p title='>b</article>", "a b"),
    "not a tag": ("<article>1 < 2 <3 > 0</article>", "1 < 2 <3 > 0"),
    "upper case": ("<ARTICLE>x<SCRIPT>y</Script>z</ARTICLE>", "xz"),
    "empty": ("", ""),
    "none": (None, ""),
}


@pytest.mark.parametrize("case", CASES)
def test_written_pages(case):
    html, want = CASES[case]
    assert maintext.main_text(html or "")[0] == want


def test_rows(spark):
    rows = [(i, f"u{i}", html, "own", 1) for i, (html, _) in enumerate(CASES.values())]
    rows += [rows[0], (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    found = maintext.extract(df)
    assert found.columns == ["page_id", "url", "text", "n_chars", "stretches"]
    got = sorted(((r.page_id, r.text, r.n_chars) for r in found.collect()), key=str)
    texts = [want for _, want in CASES.values()]
    want = [(i, text, len(text)) for i, text in enumerate(texts)] + [(0, texts[0], len(texts[0])), (None, "", 0)]
    assert got == sorted(want, key=str)
    assert maintext.extract(df.limit(0)).count() == 0
    assert [c for c in maintext.extract(df, keep=["url"]).columns] == ["url", "text", "n_chars", "stretches"]


def test_surges_and_dives():
    assert maintext.surges([0, 0, 30, 80, 10, 0, 0, 0, 5, 0, 0, 0, 200], 3, 100) == [(2, 5), (12, 13)]
    assert maintext.surges([], 3, 100) == []
    assert maintext.surges([5, 0, 0, 7], 2, 0) == [(0, 1), (3, 4)]


def test_hostile_pages_take_linear_time():
    for html in ('<a "' * 100_000, "<div>" * 100_000 + "</div>" * 50_000, "<p title='x" * 50_000, "<li>" * 50_000, "<" * 200_000):
        maintext.main_text(html)
    words = "long text " * 200_000
    assert maintext.main_text(f"<article>{words}</article>")[0] == words.strip()
