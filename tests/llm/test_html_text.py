import re
from html import unescape

import pytest

from cadenza.llm import html_text as h
from cadenza.tables import table
from tests.conftest import SF_SMALL

SCHEMA = "page_id long, url string, html string, text string, n_chars int, blocks string, words int"
LONG = "the quick brown fox jumps over the lazy dog and then runs far away into the deep dark woods " * 2


def texts(html):
    return [b[0] for b in h.read_blocks(html)]


@pytest.fixture(scope="module")
def tree(spark):
    return h.fit(spark)


def main(tree, html):
    blocks = h.read_blocks(html)
    return [b[0] for b, f in zip(blocks, h.features(blocks)) if tree.says(f)]


@pytest.mark.parametrize("html,want", [
    (None, []), ("", []), ("  \n ", []), ("plain &amp; simple", ["plain & simple"]),
    ("<p>one<p>two<br>lines</p>three", ["one", "two lines", "three"]),
    ("<p>a&nbsp;&lt;b&gt; &#233;&#x41;&copy</p>", ["a <b> éA©"]),
    ('<script>var t="</p>";x("<p>no</p>")</script><p>yes', ["yes"]),
    ("<script>never closed <p>no", []), ("<!-- <p>no</p> --><p>yes<!-- open <p>no", ["yes"]),
    ("<style>p{}</style><title>no</title><p>in<b>li</b>ne <i>kept", ["inline kept"]),
    ('<div title="a > b">x</div><p class=">">y', ["x", "y"]),
    ("a < b and 3<4 <p>next", ["a < b and 3<4", "next"]),
    ('<div class="x>broken<p>on</p>', ["broken", "on"]), ("<p>cut off <a href=", ["cut off"]),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", ["a", "b", "c", "d"]),
    ("</div></p><p>x</div></section>y", ["x", "y"]),
    ("<select><option>no</select><textarea>no</textarea><p>yes", ["yes"]),
])
def test_blocks(html, want):
    assert texts(html) == want


def test_counts_and_neighbours():
    blocks = h.read_blocks('<nav><a href="/">a b</a> c</nav><article><h1>t</h1><p>d e</p></article>')
    rows = [dict(zip(h.FEATURES, f)) for f in h.features(blocks)]
    assert [r["words"] for r in rows] == [3, 1, 2] and rows[0]["density"] == pytest.approx(2 / 3)
    assert [r["inside"] for r in rows] == [1, -1, -1] and rows[1]["heading"] == 1
    assert rows[1]["words_before"] == 3 and rows[1]["words_after"] == 2 and rows[2]["words_after"] == 0


@pytest.mark.parametrize("name,attrs,want", [
    ("div", ' class="main-content"', -1), ("div", " id=comments", 1), ("section", ' class="userComments"', 1),
    ("div", ' class="pagefooter"', 1), ("div", ' class="shadow"', 0), ("body", ' class="has-sidebar"', 0),
    ("article", "", -1), ("article", ' class="comment"', 1), ("nav", "", 1), ("div", "", 0),
    ("div", ' role="navigation"', 1), ("div", " class='post'", -1)])
def test_hints(name, attrs, want):
    assert h.hinted(name, attrs) == want


def test_the_tree_learns_its_table_and_other_pages(tree, monkeypatch):
    rows = h.labelled_blocks()
    wrong = sum(tree.says(f) != (y > 0.5) for f, y in rows)
    assert wrong <= 0.002 * len(rows)
    monkeypatch.setattr(h, "SEED", 9_000_000)
    rows = h.labelled_blocks()
    wrong = sum(tree.says(f) != (y > 0.5) for f, y in rows)
    assert wrong <= 0.01 * len(rows)


def test_pages_of_other_layouts(tree):
    """Layouts written by hand, not by the rule of the labelled table."""
    page = f"""<!doctype html><html><head><title>no</title></head><body class="single has-sidebar">
      <div id="top-nav"><a href=/>Home</a> <a href=/b>About us</a></div>
      <div class="cookie-consent"><p>{LONG}</p><button>OK</button></div>
      <div class="post-wrapper"><div class="post-text"><h2>A title</h2><p>{LONG}</p><p>Short.</p>
        <div class="advert"><p>{LONG}</p></div><ul><li>first</li><li>second <a href=x>link</a></li></ul>
        <pre>code   here</pre></div></div>
      <div class="comments-area"><h3>2 replies</h3><div class="comment"><p>{LONG}</p></div></div>
      <form><p>{LONG}</p><input name=q></form><div class="site-footer"><p>All rights reserved. {LONG}</p></div>"""
    flat = " ".join(LONG.split())
    assert main(tree, page) == ["A title", flat, "Short.", "first", "second link", "code here"]
    bare = f"<div><a href=1>One</a></div><div><a href=2>Two</a></div><p>{LONG}</p><p>{LONG}</p><div><a href=3>Three</a></div>"
    assert main(tree, bare) == [flat, flat]
    assert main(tree, "<nav><a href=1>One</a></nav><footer>words of a footer</footer>") == []


def plain_article(html):
    """The article of the given pages, by its tags alone."""
    inner = html[html.index("<article>") + 9:].partition("</article>")[0]
    parts = re.split(r"</?(?:h1|p)>", inner)
    lines = [" ".join(unescape(re.sub(r"<[^>]*>", " " if "<br>" in x else "", x)).split()) for x in parts]
    return "\n".join(x for x in lines if x)


def test_given_pages(spark, tree):
    pages = table(spark, SF_SMALL, "pages")
    source = {r.page_id: r for r in pages.collect()}
    got = h.extract(pages, tree).collect()
    assert len(got) == len(source)
    for r in got:
        assert r.text == plain_article(source[r.page_id].html) and r.n_chars == len(r.text)
        assert r.url == source[r.page_id].url


def test_compiled_tree_and_awkward_pages(spark, tree):
    """The column expression says what the tree says; null, empty, very
    long, repeated and empty tables."""
    pages = [html for html, _ in h.labelled_pages()[::7]]
    long = "<main>" + f"<p>{LONG}</p>" * 3000 + "</main>"
    rows = [(i, f"u{i}", p) for i, p in enumerate(pages)] + [(900, None, None), (901, "u", ""), (None, "u", long),
                                                            (901, "u", ""), (902, "u", "<p>" * 5000), (903, "u", "\x00 &#0;")]
    df = spark.createDataFrame([(*r, "t", 1, "b", 2) for r in rows], SCHEMA).repartition(3)
    got = h.extract(df, tree)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = [(r.page_id, r.url, r.text, r.n_chars) for r in got.collect()]
    want = [(i, u, "\n".join(main(tree, p)), len("\n".join(main(tree, p)))) for i, u, p in rows]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert h.extract(df.limit(0), tree).count() == 0
