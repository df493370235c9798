"""Main text of web pages from flat text blocks.

A page is read once, tag by tag, into a flat list of text blocks: what
stands between two block-level tags. A block has its number of words, the
share of them inside links (link density), what kind of element holds it,
and the same counts of the blocks before and after it. A decision tree,
trained on a small labelled table (``labelled_pages``), says which blocks
are main text. The tree is compiled into one Spark column expression over
the page's array of blocks, so that pages are neither exploded nor shuffled.

The labelled table is made by a rule: layouts of pages (article, blog,
bare markup, forum, reference, notice only) are filled with words, and the
filling knows which blocks are main text. It has ``PAGES`` pages of every
layout and is bounded by that.

Defined results: a null or empty page, and one without main text, has the
empty text; broken, unclosed and unknown tags, unclosed comments and
scripts, and a bare ``<`` are read as browsers do, near enough; a page of
any length is read whole; repeated rows return once each; extra columns
are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.session import checkpoint

#: Pages of every layout in the labelled table; depth of the tree.
PAGES, DEPTH, SEED = 30, 10, 12
#: Pages handled at once.
ROWS = 64

# fixed values: names of HTML elements
#: Elements whose content is not text of the page.
HIDDEN = ["script", "style", "noscript", "template", "title", "textarea", "select", "iframe", "object", "svg", "math",
          "canvas", "audio", "video", "button", "datalist", "noframes"]
#: Elements that end a block of text.
BLOCK = ["address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir",
         "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
         "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre",
         "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"]
#: Elements without content.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
#: Elements beside the main text, and those that hold it.
BESIDE = ["nav", "footer", "aside", "form", "menu", "dialog", "search", "fieldset"]
MAIN = ["article", "main"]
#: Words in the class, id or role of an element that tell what it holds.
BESIDE_WORDS = ["ad", "ads", "advert", "advertisement", "advertorial", "adbox", "banner", "breadcrumb", "breadcrumbs",
                "byline", "captcha", "comment", "comments", "commentlist", "complementary", "consent", "contentinfo",
                "cookie", "cookies", "copyright", "disclaimer", "discussion", "disqus", "feedback", "foot", "footer",
                "form", "gdpr", "head", "header", "links", "login", "masthead", "menu", "meta", "modal", "nav",
                "navbar", "navigation", "newsletter", "notice", "outbrain", "overlay", "pager", "pagination", "popup",
                "promo", "promoted", "promotion", "recommended", "related", "replies", "reply", "respond", "responses",
                "search", "share", "sharing", "sidebar", "signup", "skyscraper", "social", "sponsor", "sponsored",
                "subscribe", "subscription", "alert", "announcement", "notification", "paywall", "tags", "teaser", "toolbar", "topbar", "trending", "widget", "widgets"]
MAIN_WORDS = ["article", "articlebody", "body", "content", "entry", "main", "maincontent", "post", "posttext", "story",
              "text"]

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<hidden>" + "|".join(HIDDEN) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+>.*?(?:</(?P=hidden)\s*[^>]*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close_odd>/?)(?P<name_odd>[a-z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)", re.I | re.S)
_HINTS = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: The same, grown together with another word.
_GROWN = re.compile(r"(?:advert|cookie|comment|sponsor|promo|newsletter|sidebar)|.*(?:footer|header|sidebar|menu|banner|nav)$")

_BLOCK, _VOID = frozenset(BLOCK), frozenset(VOID)
#: What a start tag ends, if it stands open innermost.
_ENDS = {"li": ["li", "p"], "dt": ["dt", "dd", "p"], "dd": ["dt", "dd", "p"], "tr": ["tr", "td", "th", "p"],
         "td": ["td", "th", "p"], "th": ["td", "th", "p"], "option": ["option"]}


@lru_cache(maxsize=4096)
def hinted(name: str, attrs: str) -> int:
    """What an element says of its content: 1 beside the main text, -1 main
    text, 0 nothing."""
    if name in ("html", "body"):
        return 0
    found = {w.lower() for m in _HINTS.finditer(attrs) for w in _WORD.findall(m[1] or m[2] or m[3] or "")}
    if name in BESIDE or found.intersection(BESIDE_WORDS) or any(map(_GROWN.match, found)):
        return 1
    return -1 if name in MAIN or found.intersection(MAIN_WORDS) else 0


@dataclass
class _Reader:
    """The state of reading one page."""
    stack: list[tuple[str, int, bool]] = field(default_factory=list)   # name, hint, is it a header
    parts: list[str] = field(default_factory=list)
    links: list[str] = field(default_factory=list)
    in_link: int = 0
    blocks: list[tuple] = field(default_factory=list)

    def text(self, raw: str) -> None:
        self.parts.append(raw)
        if self.in_link:
            self.links.append(raw)

    def space(self) -> None:
        self.parts.append(" ")
        self.links.append(" ")

    def flush(self) -> None:
        words = unescape("".join(self.parts)).split() if self.parts else []
        if words:
            linked = len(unescape("".join(self.links)).split())
            hint = next((h for _, h, _ in reversed(self.stack) if h), 0)
            names = [n for n, _, _ in self.stack]
            self.blocks.append((" ".join(words), len(words), min(linked, len(words)), hint,
                                int(any(h < 0 for _, h, _ in self.stack)),
                                int(any(n in HEADINGS for n in names)), int("li" in names),
                                int(any(x for _, _, x in self.stack))))
        self.parts.clear()
        self.links.clear()

    def open(self, name: str, attrs: str) -> None:
        if name == "a":
            self.in_link = 1
        elif name == "br":
            self.space()
        if name not in _BLOCK:
            return
        self.flush()
        while self.stack and (self.stack[-1][0] in _ENDS.get(name, ["p"])
                              or name in HEADINGS and self.stack[-1][0] in HEADINGS):
            self.stack.pop()
        if name not in _VOID:
            hint = hinted(name, attrs[:2000])
            self.stack.append((name, hint, name == "header"))

    def close(self, name: str) -> None:
        if name == "a":
            self.in_link = 0
        if name not in _BLOCK:
            return
        self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == name:
                del self.stack[i:]
                break


def read_blocks(html: str | None) -> list[tuple]:
    """The text blocks of a page: text, words, words in links, what the
    nearest telling element says, and whether it stands in main text, a
    heading, a list item or a header."""
    page, at, html = _Reader(), 0, html or ""
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            page.text(html[at:m.start()])
        at = m.end()
        name = (m["name"] or m["name_odd"] or "").lower()
        if m["close"] or m["close_odd"]:
            page.close(name)
        elif name:
            page.open(name, m["attrs"] or "")
    if at < len(html):
        page.text(html[at:])
    page.flush()
    return page.blocks


#: What the tree sees of a block.
FEATURES = ["words", "density", "inside", "depth_main", "heading", "item", "in_header", "words_before",
            "density_before", "words_after", "density_after", "place", "any_main"]


def features(blocks: list[tuple]) -> list[list[float]]:
    n = len(blocks)
    words = [0, *(b[1] for b in blocks), 0]
    density = [0.0, *(b[2] / b[1] for b in blocks), 0.0]
    any_main = float(any(b[3] < 0 for b in blocks))
    return [[float(words[i]), density[i], float(b[3]), float(b[4]), float(b[5]), float(b[6]), float(b[7]),
             float(words[i - 1]), density[i - 1], float(words[i + 1]), density[i + 1], i / (n + 1), any_main]
            for i, b in enumerate(blocks, 1)]


# the labelled table

#: Set before main text while the labelled table is made.
_MARK = "\ue000"
_LETTERS = ["an", "be", "cor", "de", "el", "fi", "gra", "hin", "is", "lo", "mu", "nor", "ost", "per", "qua", "ri"]


class _Filler:
    """Words, links and sentences at random; ``main`` marks main text."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, lo: int, hi: int) -> str:
        r = self.r
        return " ".join("".join(r.choices(_LETTERS, k=r.randint(1, 3))) for _ in range(r.randint(lo, hi)))

    def link(self, lo: int = 1, hi: int = 3) -> str:
        return f'<a href="/x">{self.words(lo, hi)}</a>'

    def text(self) -> str:
        """A paragraph's words: from one word to several hundred, with links
        in some."""
        lo, hi = self.r.choice([(1, 4), (5, 15), (15, 60), (60, 300)])
        out = self.words(lo, hi)
        return f"{out} {self.link()} {self.words(3, 9)}" if self.r.random() < 0.2 else out

    def main(self, tag: str = "p", text: str | None = None) -> str:
        return f"<{tag}>{_MARK}{text or self.text()}</{tag}>"

    def paragraphs(self, lo: int = 1, hi: int = 8) -> str:
        kinds = ["p"] * 8 + ["h2", "blockquote", "li"]
        out = []
        for _ in range(self.r.randint(lo, hi)):
            kind = self.r.choice(kinds)
            if kind == "li":
                out.append("<ul>" + "".join(self.main("li") for _ in range(self.r.randint(2, 5))) + "</ul>")
            else:
                out.append(self.main(kind, self.words(1, 8) if kind == "h2" else None))
        return "".join(out)

    def long(self) -> str:
        """Paragraphs that are known by their words alone."""
        lo, hi = self.r.choice([(14, 40), (30, 60), (18, 200)])
        return "".join(self.main("p", self.words(lo, hi)) for _ in range(self.r.randint(1, 8)))

    def menu(self, tag: str = "ul") -> str:
        return f"<{tag}>" + "".join(f"<li>{self.link(1, 2)}</li>" for _ in range(self.r.randint(3, 9))) + f"</{tag}>"

    def beside(self, name: str, tag: str | None = None) -> str:
        """A box beside the main text, of any length, with or without links."""
        r = self.r
        inner = r.choice([lambda: self.menu(), lambda: self.words(2, 25), lambda: f"<p>{self.words(5, 90)}</p>",
                          lambda: f"<h3>{self.words(1, 4)}</h3><p>{self.words(10, 60)} {self.link()}</p>"])()
        tag = tag or r.choice(["div", "section", "aside", "ul" if inner.startswith("<li") else "div"])
        attr = r.choice(["class", "id"])
        return f'<{tag} {attr}="{name}">{inner}</{tag}>'

    def comments(self) -> str:
        one = self.r.choice(["comment", "comment-body", "reply"])
        tag = self.r.choice(["div", "li", "article"])
        rows = "".join(f'<{tag} class="{one}"><p>{self.words(1, 3)}</p><p>{self.words(3, 120)}</p></{tag}>'
                       for _ in range(self.r.randint(1, 5)))
        return f'<{self.r.choice(["section", "div"])} id="comments"><h3>{self.words(1, 2)}</h3>{rows}</div>'

    def boxes(self) -> str:
        names = self.r.sample(["ad", "ads", "sidebar", "cookie-notice", "newsletter", "related", "share", "banner",
                               "promo", "social-links", "breadcrumb", "popup", "widget"], self.r.randint(0, 4))
        return "".join(self.beside(n) for n in names)

    def form(self) -> str:
        return f"<form><label>{self.words(1, 3)}</label><input><p>{self.words(2, 30)}</p></form>"


def _article(f: _Filler) -> str:
    extra = f.boxes() if f.r.random() < 0.4 else ""
    inner = f.main("h1", f.words(1, 12)) + f.paragraphs() + extra + f.paragraphs(0, 3)
    late = (f.comments() if f.r.random() < 0.5 else "") + (f.form() if f.r.random() < 0.3 else "")
    inside = f.r.random() < 0.3
    tag = f.r.choice(["article", "main"])
    return (f"<nav>{f.menu()}</nav>{f.boxes()}<{tag}>{inner}{late if inside else ''}</{tag}>"
            f"{'' if inside else late}{f.boxes()}<footer>{f.words(2, 30)} {f.link()}</footer>")


def _blog(f: _Filler) -> str:
    name = f.r.choice(["content", "post", "entry-content", "main-content", "article-body", "story"])
    top = f"<header><h1>{f.words(1, 3)}</h1><p>{f.words(3, 9)}</p>{f.menu()}</header>"
    return (f'{top}<div id="page"><div class="{name}">{f.main("h2", f.words(2, 9))}{f.paragraphs(2, 9)}</div>'
            f'{f.comments() if f.r.random() < 0.6 else ""}<div class="sidebar">{f.menu()}{f.beside("widget")}</div></div>'
            f'<div id="footer">{f.words(3, 40)}</div>')


def _bare(f: _Filler) -> str:
    """No names at all: words and links must tell."""
    menu = "".join(f"<div>{f.link(1, 3)}</div>" for _ in range(f.r.randint(4, 9)))
    head = f.main("h1", f.words(2, 9)) if f.r.random() < 0.7 else ""
    return f"<div>{menu}</div><div>{head}{f.long()}</div><div>{menu}</div><div>{f.words(1, 6)} {f.link(2, 4)}</div>"


def _table(f: _Filler) -> str:
    return (f"<table><tr><td>{f.menu()}</td><td>{f.main('h1', f.words(2, 9))}{f.long()}</td><td>{f.menu()}</td></tr>"
            f"<tr><td>{f.link()} {f.link()}</td></tr></table>")


def _reference(f: _Filler) -> str:
    """Many links inside the main text."""
    def entry() -> str:
        return f.main("p", " ".join(f"{f.words(2, 9)} {f.link()}" for _ in range(f.r.randint(2, 9))))

    return (f'<div id="navigation">{f.menu()}</div><main>{f.main("h1", f.words(1, 4))}'
            + "".join(entry() for _ in range(f.r.randint(2, 7))) + f"</main>{f.boxes()}<footer>{f.menu()}</footer>")


def _headline(f: _Filler) -> str:
    """The title stands in the article's own header."""
    return (f"<header>{f.words(1, 3)} {f.menu()}</header><article><header>{f.main('h1', f.words(2, 12))}</header>"
            f"{f.paragraphs(1, 7)}<footer>{f.words(2, 9)}</footer></article><aside><p>{f.words(5, 80)}</p></aside>")


def _notice(f: _Filler) -> str:
    """No main text."""
    return f"<nav>{f.menu()}</nav>{f.beside('cookie-notice')}{f.form()}<footer><p>{f.words(3, 60)}</p></footer>"


LAYOUTS = [_article, _article, _blog, _bare, _table, _reference, _headline, _notice]


def labelled_pages() -> list[tuple[str, list[str]]]:
    """Pages with the main text blocks of each."""
    out = []
    for i, layout in enumerate(LAYOUTS):
        for k in range(PAGES):
            html = f"<html><body>{layout(_Filler(SEED + 1000 * i + k))}</body></html>"
            main = [b[0].lstrip(_MARK).strip() for b in read_blocks(html) if b[0].startswith(_MARK)]
            out.append((html.replace(_MARK, ""), main))
    return out


def labelled_blocks() -> list[tuple[list[float], float]]:
    """The labelled table: features of every block, and 1 for main text."""
    rows = []
    for i, layout in enumerate(LAYOUTS):
        for k in range(PAGES):
            marked = read_blocks(f"<html><body>{layout(_Filler(SEED + 1000 * i + k))}</body></html>")
            plain = [(b[0].replace(_MARK, ""), *b[1:]) for b in marked]
            rows += zip(features(plain), (float(b[0].startswith(_MARK)) for b in marked))
    return rows


# tree and extraction

@dataclass
class Tree:
    """A node: a split (feature, value, both sides) or a leaf's verdict."""
    verdict: bool = False
    feature: str | None = None
    value: float = 0.0
    at_most: Tree | None = None
    above: Tree | None = None

    def column(self, block: Column) -> Column:
        if self.feature is None:
            return F.lit(self.verdict)
        return F.when(block[self.feature] <= self.value, self.at_most.column(block)) \
            .otherwise(self.above.column(block))

    def says(self, row: list[float]) -> bool:
        node = self
        while node.feature is not None:
            node = node.at_most if row[FEATURES.index(node.feature)] <= node.value else node.above
        return node.verdict


def _tree(node) -> Tree:
    """A fitted tree from its JVM node; equal verdicts on both sides of a
    split are one leaf."""
    if node.subtreeDepth() == 0:
        return Tree(verdict=node.prediction() > 0.5)
    split = node.split()
    a, b = _tree(node.leftChild()), _tree(node.rightChild())
    if a.feature is None and b.feature is None and a.verdict == b.verdict:
        return a
    return Tree(feature=FEATURES[split.featureIndex()], value=float(split.threshold()), at_most=a, above=b)


def fit(spark: SparkSession) -> Tree:
    """The tree of the labelled table."""
    rows = spark.createDataFrame(labelled_blocks(), "f array<double>, label double").coalesce(1)
    rows = checkpoint(rows.select(array_to_vector("f").alias("features"), "label"))
    model = DecisionTreeClassifier(maxDepth=DEPTH, minInstancesPerNode=3, maxBins=128, seed=SEED).fit(rows)
    return _tree(model._java_obj.rootNode())


def blocks(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """Columns ``keep`` and ``blocks``, an array of text and features."""
    fields = ", ".join(["text: string", *(f"{c}: double" for c in FEATURES)])
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    kind = pa.list_(pa.struct([("text", pa.string()), *((c, pa.float64()) for c in FEATURES)]))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                found = [read_blocks(h) for h in part.column(len(keep)).to_pylist()]
                rows = [f for page in found for f in features(page)]
                columns = [pa.array([b[0] for page in found for b in page], pa.string()),
                           *(pa.array([r[j] for r in rows], pa.float64()) for j in range(len(FEATURES)))]
                ends = pa.array([0, *accumulate(map(len, found))], pa.int32())
                array = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, fields=list(kind.value_type)))
                yield pa.RecordBatch.from_arrays([*(part.column(j) for j in range(len(keep))), array],
                                                 [*keep, "blocks"])

    return pages.select(*keep, html_col).mapInArrow(run, f"{kinds}, blocks array<struct<{fields}>>")


def extract(pages: DataFrame, tree: Tree, keep: list[str] | None = None, html_col: str = "html") -> DataFrame:
    """Columns ``keep`` (default: page id and url), ``text`` (the main text
    blocks, one to a line) and ``n_chars``."""
    keep = keep or ["page_id", "url"]
    main = F.transform(F.filter("blocks", tree.column), lambda b: b["text"])
    rows = blocks(pages, keep, html_col).select(*keep, F.array_join(main, "\n").alias("text"))
    return rows.withColumn("n_chars", F.char_length("text").cast("bigint"))
