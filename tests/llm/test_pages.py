import random
import time

import pyarrow.parquet as pq
import pytest

from terracefold.llm import html_text

WORDS = "word " * 50
PAGES = [
    ('<script>var a="<!--";</script><article><p>After one</p></article><footer>foot</footer>', "After one"),
    ("<script>if(a<b){x='it';}</script><article><p>This isn't lost</p><p>second</p></article>", "This isn't lost\nsecond"),
    ("<p title=it's>Body text</p><p>More isn't</p>", "Body text\nMore isn't"),
    ('<div class="page header-fixed"><nav><a>Home</a></nav><article><h1>T</h1><p>Hello there</p></article></div>', "T\nHello there"),
    ('<article><div class="entry-header"><h1>Title</h1></div><p>Hello</p></article>', "Title\nHello"),
    ('<div id="search-app"><article><p>Hello there my friend</p></article></div>', "Hello there my friend"),
    (f"<div><a href=/>Home</a> <a href=/n>News</a> <a>About</a></div><div><p>{WORDS}</p><p>Again words here.</p></div><div>&copy; 2024 Someone</div>", f"{WORDS.strip()}\nAgain words here."),
    ("<main><article><p>one part of it</p></article><article><p>other part of it</p></article></main>", "one part of it\nother part of it"),
    (f'<article><h1>A</h1><p>text text text</p><section class="comments"><h2>Comments</h2><article class="comment"><p>{WORDS}</p></article></section><p>tail text</p></article>', "A\ntext text text\ntail text"),
    ("<article><p>a &lt;b&gt; &amp; c&nbsp;d &copy 5</p></article>", "a <b> & c d © 5"),
    ("<p>5 < 6 and 7 > 3</p>", "5 < 6 and 7 > 3"),
    ("<body>just text", "just text"),
    (f'<article><p>x</p><aside><p>side</p></aside><form><input><label>Name</label></form><div class="ad">buy</div><p>y</p></article><div class="sidebar"><p>{WORDS}</p></div>', "x\ny"),
    (f"<div class=comments><p>no article here, {WORDS}</p></div>", ""),
    ('<ul class="menu"><li>One</li><li>Two</li></ul><div class="content"><h1>Big</h1><p>Some text in here.</p><p class="notice">We use cookies</p></div><div id="footer">Foot</div>', "Big\nSome text in here."),
    ("<article><p>cut off <b>here", "cut off here"),
    ("<article><p>a</p><!-- x > y <p>no</p> --><p>b</p><p>c <a href=x>link text</a>, d</p><table><tr><td>1</td><td>2</td></tr></table></article>", "a\nb\nc link text, d\n1\n2"),
    ("<article><p>before<p>after<ul><li>one<li>two</ul></article><p>Beside it stands a notice.</p>", "before\nafter\none\ntwo"),
    ("<article><p>text</p></article><!-- never ended <p>x</p>", "text"),
    ("", ""),
    (None, ""),
    (" \n\t", ""),
]


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_pages(k):
    page, want = PAGES[k]
    assert html_text.main_text(page) == want


def test_long_and_broken_pages():
    for page in ["<div>" * 50_000 + "x", "<p title='" * 50_000, "</b>" * 100_000, "<" * 200_000, "<a <a " * 50_000, "<!--" * 50_000, "<p><li>" * 30_000]:
        html_text.main_text(page)
    text = "w " * 500_000
    assert html_text.main_text(f"<nav>n</nav><article><p>{text}</p></article>") == text.strip()


def test_region_against_all_regions():
    r = random.Random(4)
    for _ in range(300):
        scores = [r.choice([-3.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]) for _ in range(r.randint(0, 14))]
        best, want = 0.0, (0, 0)
        for a in range(len(scores)):
            for b in range(a + 1, len(scores) + 1):
                if sum(scores[a:b]) > best:
                    best, want = sum(scores[a:b]), (a, b)
        a, b = html_text.best_region(scores)
        assert sum(scores[a:b]) == best == sum(scores[slice(*want)])


def test_scan_and_weights_decide_every_page(monkeypatch):
    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist()
    called, scan = [], html_text.best_region
    monkeypatch.setattr(html_text, "best_region", lambda s: called.append(1) or scan(s))
    whole = [html_text.main_text(p) for p in pages]
    assert len(called) == len(pages) and all(whole)
    weights, tag = html_text.weights()
    monkeypatch.setattr(html_text, "weights", lambda: ({k: -v for k, v in weights.items()}, tag))
    assert all(a != b for a, b in zip(whole, map(html_text.main_text, pages)))


def test_articles_of_the_table():
    """The table's pages mark their article: its text by another parser, blocks and white space aside."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.text = 0, []

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            self.text.append(" ")

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            self.text.append(" ")

        def handle_data(self, data):
            if self.inside:
                self.text.append(data)

    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        p = Article()
        p.feed(page)
        assert "".join(html_text.main_text(page).split()) == "".join("".join(p.text).split())


@pytest.mark.parametrize("between", ["<img>" * 60, "<br>" * 60, "<span></span>" * 3000, "<table>" + "<tr><td></td></tr>" * 400 + "</table>", "<div class=x><!-- --></div>" * 200])
def test_markup_without_text_parts_nothing(between):
    page = f"<article><p>one two three four</p>{between}<p>five six seven eight nine</p></article>"
    assert html_text.main_text(page) == "one two three four\nfive six seven eight nine"


@pytest.mark.parametrize("page", ["<span>" * 20_000 + "<option></option>" * 20_000, "<i>" * 20_000 + "<li>x</li>" * 5_000, "<div>" * 20_000 + "<p>x</p>" * 5_000, "<p>" * 20_000 + "</i>" * 20_000, "<td><tr>" * 20_000])
def test_deep_stacks_take_linear_time(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 5
