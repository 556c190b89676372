import html
import math
import random
import re
import time

import pytest

from spanlight.llm import html_text as H


def test_article_without_its_surroundings():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">Buy &amp; buy</div><!-- x <p>no</p> -->
    <article><h1>Head&nbsp;line</h1><p><b>First  bold.<br><p>Second &lt;p&gt; &copy; text&hellip;</p><div class="ad">ad</div><ul><li>one<li>two</ul><form>f</form>
    <div id="comments"><p>I agree</p></div></article><aside>side</aside><div class="cookie-notice">ok?</div><footer>&copy; me</footer></body></html>"""
    assert H.article_text(page) == "Head line\nFirst bold.\nSecond <p> © text…\none\ntwo"


def test_without_article_element():
    text = "Words of the long main text, " * 20
    page = f"<body><div><a href=1>x</a> <a href=2>y</a> <a href=3>z</a></div><div id=main><h2>Title</h2><p>{text}</p><p>Short.</p></div><ul class=menu><li>m</ul></body>"
    assert H.article_text(page) == f"Title\n{text.strip()}\nShort."


def test_odd_pages():
    for page in (None, "", "<", "<p", "<!-- open", "<script>x", "</p></div>", "<nav>only</nav>"):
        assert H.article_text(page) in ("", "<", "<p")
    assert H.article_text("just text &amp; more") == "just text & more"
    assert H.article_text("<div>" * 5000 + "deep") == "deep"


def plain(page):
    """Another way for pages of one article: the article element, line by line."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    lines = re.split(r"</?(?:p|h1)>", inner.replace("<br>", " ").replace("<b>", "").replace("</b>", ""))
    return "\n".join(t for x in lines if (t := " ".join(html.unescape(x).split())))


def test_whole_table_against_the_plain_way(spark):
    out = H.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").selectExpr("*", "html AS raw", "1 AS n_chars")).collect()
    assert len(out) == 250
    for r in out:
        assert r["text"] == plain(r["raw"]) and r["n_chars"] == len(r["text"])


def test_empty_table(spark):
    assert H.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_the_dense_part_wins_without_an_article_element():
    long = " ".join(["words of the text, and more of them"] * 12)
    page = f"""<body><div class="top-stories"><a href=/1>One story</a> <a href=/2>Another story</a> <a href=/3>A third one</a></div>
    <div><h1>The head</h1></div><div class="content sidebar-right"><div><p>{long}</p><p>Short.</p></div><div><p>{long}!</p></div><p>End.</p></div>
    <div><a href=/a>Elsewhere</a><a href=/b>Further</a></div><div class=comments><p>{long * 9}</p></div></body>"""
    assert H.article_text(page) == f"The head\n{long}\nShort.\n{long}!"  + "\nEnd."


def test_an_article_element_without_text_does_not_win():
    long = "Text that a reader came for, sentence after sentence. " * 9
    assert H.article_text(f"<body><article><a href=1>More</a> <a href=2>News</a></article><div><p>{long}</p></div></body>") == long.strip()


def density(x, whole):
    """Characters per tag, lowered by links, from the definitions, for well-formed nested lists [tag, item...]."""
    def count(y, what):
        if isinstance(y, str):
            return what(y, None)
        return sum(count(i, what) for i in y[1:]) + what(None, y[0])

    chars = count(x, lambda t, tag: len(t.strip()) if t else 0)
    inner = count(x, lambda t, tag: bool(tag)) - 1
    def links(y, on):
        if isinstance(y, str):
            return (len(y.strip()) if on else 0), 0
        here = [links(i, on or y[0] == "a") for i in y[1:]]
        return sum(a for a, _ in here), sum(b for _, b in here) + sum(1 for i in y[1:] if not isinstance(i, str) and (i[0] == "a" or on or y[0] == "a"))
    lc, lt = links(x, False)
    if not chars:
        return 0.0
    ratio = chars / max(lc, 1) * max(inner, 1) / max(lt, 1)
    return chars / max(inner, 1) * max(math.log(ratio) / math.log(chars / max(chars - lc, 1) * lc + whole * chars + math.e), 0.0)


def test_densities_against_their_definition():
    rng = random.Random(5)

    def tree(depth):
        tag = rng.choice(["div", "b", "span", "a", "section"]) if depth else "html"
        return [tag, *[(" ".join(["word"] * rng.randint(1, 30)) if rng.random() < 0.5 or depth > 3 else tree(depth + 1)) for _ in range(rng.randint(1, 4))]]

    def written(x):
        return x if isinstance(x, str) else f"<{x[0]}>{''.join(map(written, x[1:]))}</{x[0]}>"

    def flat(x):
        yield x
        for i in x[1:]:
            if not isinstance(i, str):
                yield from flat(i)

    for _ in range(60):
        x = tree(0)
        root = H.parse(written(x))
        nodes, want = H.measure(root), list(flat(x))
        whole = root.links / max(root.chars, 1)
        assert [n.tag for n in nodes] == [w[0] for w in want]
        for n, w in zip(nodes, want):
            assert n.density == pytest.approx(density(w, whole))
            total = sum(density(i, whole) for i in w[1:] if not isinstance(i, str))
            assert n.total == pytest.approx(total or n.density * 1e-9)


def test_time_is_in_proportion_to_the_page():
    began = time.time()
    for part in ("<b>", '<p "', "<p a='", '<p a="x', "<blockquote>", "<li>", "<table><tr><td>", "<div><p>", "<!--", "<", "<p", "</b>", "<svg>", "<a href=x "):
        H.article_text(part * 100_000 + "end")
    assert time.time() - began < 60


def test_quotes_and_slashes():
    assert H.article_text("<p title=\"a > b\">x</p><p title='1>2'>y</p>") == "x\ny"
    root = H.parse("<div><a href=/x/>link</a> text</div>")
    assert H.measure(root) and root.links == 4 and root.chars == 8
