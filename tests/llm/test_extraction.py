"""Main text of pages: made pages of several layouts, odd markup and odd rows."""

import random

import pytest

from paperloom.llm import queries
from paperloom.llm.html_extraction import DEPTH, extract_main_text, main_text

STORY = [
    "The first paragraph, of some length, tells what happened & where.",
    "A second one.",
    "Third: it has “quotes”, commas, and a long tail of words that go on until the line has passed the hundred characters that count.",
    "Short",
]
JUNK = {
    "nav": "<nav><ul><li><a href=/a>Home, sweet</a><li><a href=/b>News</a><li><a href=/c>More, and more</a></ul></nav>",
    "header": "<header class=site><h1>The Site, of Sites</h1><p>Slogan, with, many, commas, in, it, here</p></header>",
    "ad": "<div class='box ad-slot'><p>Buy now, pay later, save much, be happy, and, so, on, for ever.</p></div>",
    "notice": "<div id=cookieConsent><p>We use cookies, as all do, to make, well, this better for you.</p><button>Fine</button></div>",
    "sidebar": "<div class=sidebar><h3>Latest</h3><p>Another story, about, other, things, entirely, elsewhere.</p></div>",
    "aside": "<aside><p>Aside, of, many, commas, and many more words in it than some.</p></aside>",
    "form": "<form action=/s><p>Your name, please, and, your, mail, address, too</p><input name=q><textarea>Old, text</textarea></form>",
    "script": "<script>if (a < b && c > d) document.write('<p>made, by, script</p>');</script><style>p > a {color:red}</style><!-- <p>hidden, comment</p> -->",
    "comments": "<section class='comments-area'><article class=comment><p>I think, as a reader, that, this, is, wrong, and, long, so, long.</p></article></section>",
    "hidden": "<div style='display: none'><p>Nobody, sees, this, text, at, all.</p></div>",
    "footer": "<footer><p>&copy; 2024, Some Company, all rights reserved, of course, and so on.</p></footer>",
}


def escaped(t):
    return t.replace("&", "&amp;").replace("<", "&lt;").replace("“", "&ldquo;").replace("”", "&#8221;")


def story(close=True):
    return "<h1>A  Title\n here</h1>" + "".join(f"<p>{escaped(t)}" + ("</p>" if close else "") for t in STORY)


WANT = "\n".join(["A Title here", *STORY])
LAYOUTS = {
    "article": lambda j: f"<html><head><title>No</title></head><body>{j['nav']}{j['ad']}<article>{story()}</article>{j['footer']}</body></html>",
    "unclosed": lambda j: f"<!DOCTYPE html><body>{j['header']}<article>{story(False)}{j['form']}</article>{j['comments']}",
    "main": lambda j: f"<body>{j['header']}<div class='page with-sidebar'><main>{j['notice']}{story()}{j['ad']}</main>{j['sidebar']}</div>{j['footer']}",
    "content": lambda j: f"<body><div id=wrap>{j['nav']}<div class=content>{story()}</div>{j['sidebar']}</div>{j['footer']}{j['script']}",
    "deep": lambda j: f"<body>{j['notice']}<div><div class=post><div class=text>{story()}</div>{j['comments']}</div>{j['aside']}</div>{j['hidden']}",
    "title outside": lambda j: f"<body>{j['nav']}<div class=story><h1>A Title here</h1><div class=text>{story().partition('</h1>')[2]}</div></div>{j['ad']}",
    "sections": lambda j: f"<body><article><section>{story()[:-len('<p>Short</p>')]}</section>{j['ad']}<section><p>Short</p></section></article>{j['comments']}",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(layout):
    assert main_text(LAYOUTS[layout](JUNK)) == WANT


def test_junk_anywhere():
    """Each kind of junk, in any number and order around and inside the article, in which a header is the article's own."""
    rng = random.Random(4)
    for _ in range(200):
        parts = ["", "", ""]
        for _ in range(rng.randrange(8)):
            at = rng.randrange(3)
            parts[at] += JUNK[rng.choice([kind for kind in JUNK if at != 1 or kind != "header"])]
        assert main_text(f"<body>{parts[0]}<div><article>{story(rng.random() < 0.5)}{parts[1]}</article></div>{parts[2]}") == WANT


def test_text_rules():
    assert main_text("<p> a&nbsp;&amp;\n b<br>c <b>d</b>e<i>f</i> &lt;p&gt; &#x41;&copy</p><p></p><p>g") == "a & b c def <p> A©\ng"
    assert main_text("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y<tr><td>z</table><pre>k\n  l</pre></article>") == "one\ntwo\nx\ny\nz\nk l"
    assert main_text("<article><p>See <a href=x>this page</a>, and that.</p><ul><li><a>m</a><li><a>n</a><li><a>o</a></ul></article>") == "See this page, and that."
    assert main_text("<p title='a > b'>x</p>") == "x" and main_text('<p title="open>x</p><p>y</p>') == "x\ny"
    assert main_text("1 < 2, <3 and a <b>bold</b> & <end") == "1 < 2, <3 and a bold &"


def test_broken_markup():
    for html in (None, "", " ", "<", "<!--", "<!-->", "<a", "</", "<script>x", "<title>t", "<div class=ad>x</div>", "<![CDATA[x", "<p", "</p>", "<>"):
        assert main_text(html) in ("", "<", "<>"), html
    assert set(main_text("<div>x " * (3 * DEPTH)).split()) == {"x"}
    assert main_text("<td>a<li>b<tr>c</div>d") == "a\nb\ncd"
    rng = random.Random(1)
    bits = list(JUNK.values()) + [story(), "<div>", "</div>", "<p>", "<a href='", '"', "<td>", "</a>", "<!--", "&am", "<form>", "</nav>"]
    for _ in range(300):
        assert isinstance(main_text("".join(rng.choice(bits)[: rng.randrange(1, 60)] for _ in range(30))), str)


def test_long_pages_take_linear_time():
    long = "<article>" + "".join(f"<p>Paragraph {i}, of many.</p>" for i in range(60_000)) + "</article>"
    assert main_text(long).count("\n") == 59_999
    for unit in ("<a ", '<p a="', "<div>x", "<li>", "</div>", "<a href='x'>", "<ul><li>"):
        main_text(unit * 100_000)


def test_rows(spark):
    rows = [(1, "u", None, "t"), (2, None, "", "t"), (3, "u", "<p>one</p>", "t"), (3, "u", "<p>one</p>", "t"), (None, "v", "<p>two", "t"), (4, "w", "<p>" + "long, " * 100_000, "t")]
    got = extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    want = [(1, "u", "", 0), (2, None, "", 0), (3, "u", "one", 3), (3, "u", "one", 3), (None, "v", "two", 3), (4, "w", ("long, " * 100_000).strip(), 599_999)]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert extract_main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    assert queries.op12_html_extraction(spark, "/root/testdata/sf0.001").columns == ["page_id", "url", "text", "n_chars"]
