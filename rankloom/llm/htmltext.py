"""Main text of web pages by tag-path ratios.

A page is read into text nodes, each with its root-to-leaf tag path. Over all nodes of a path the mean text length, the mean
number of punctuation marks and the share of link text are taken; lengths and marks are smoothed along the page, and the three are fused into one
score per path. Paths under a fixed share of the page's mean score, each character counting alike, are not content. That decides on every page.

Structure goes in as a prior, which is 0 or 1: what lies in navigation, headers, footers, asides, forms, scripts and the like, or in
a container whose class, id or role says so, is scored 0, and so is what lies outside the article or main part where a page marks one. Headings,
paragraphs and inline elements are not judged by such names, nor within an article are sections by their id. A low block stays if it lies beside
content: in one frame with it or between parts of it, or in the same marked article; except menus, which are three or more links in a row. An
article none of whose paths reach the threshold, such as a teaser, goes. A heading stays if content follows it.

Defined results: a null or empty page, or one without content, has the text ''; unclosed, unknown and misnested tags are read as well as may be;
elements nested more than DEPTH deep count as parts of the one at that depth; a tag that the page's end cuts off is no text;
repeated rows stay repeated; null ids and urls stay null; other columns are not looked at.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship
from . import common

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)>|<(?P<odd>[a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>",
    re.S,
)
NAMED = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements whose text is none of the page's, elements that are never content, and those that hold nothing.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "annotation", "annotation-xml", "xmp", "noframes", "select"}
NEVER = {"head", "nav", "footer", "aside", "form", "menu", "button", "dialog", "fieldset", "label", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that begin and end blocks of text, those among them that end an open paragraph, and headings.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Blocks that hold others and may be told by their names as none of the content, and those whose direct parts lie beside each other.
CONTAINERS = BLOCKS - HEADINGS - {"p", "pre", "blockquote", "caption", "figcaption", "hr", "legend", "summary", "address"}
FRAMES = {"article", "body", "center", "div", "html", "main", "section"}
#: An open element that the start of another of the same group ends, up to an enclosing element of the second kind.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words of a class, id or role that mark what is not content, and those that mark content.
AROUND = set(
    "ad ads advert adverts advertisement advertising adbox adsense banner breadcrumb breadcrumbs comment comments commentlist commenting consent cookie cookies copyright disclaimer discussion disqus footer gdpr header "
    "login masthead menu menubar modal nav navbar navigation navigationbar newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommend recommended recommendations related reply replies respond search "
    "share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget alert contentinfo complementary form".split()
)
CONTENT = {"article", "articlebody", "main", "maincontent"}
#: Words that may stand beside one of those in a longer name, and words that make an element's header one of the article.
BESIDE = set("area bar block body bottom bottoms box button buttons col column container content foot footer form group head header inner item items left link links list main module outer page panel part post posts right section site slot text title top unit wrap wrapper".split())
HEADED = {"entry", "post", "article", "story"}
#: Threshold as a share of the page's mean score, the share of link text from which a block is an entry of a menu, and how many make one.
TAU, LINKS, MENU = 0.15, 0.5, 3
#: Elements that are open at once; browsers nest no deeper.
DEPTH = 512
#: A tag without an end.
CUT_OFF = re.compile(r"<(?:[a-zA-Z/?]|!(?:--|\[CDATA\[)?)")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？؟]")
SMOOTH = (0.25, 0.5, 0.25)


class Paths:
    """Tag paths as numbers: of each its parent and the frame it lies in; 0 is the empty path."""

    def __init__(self):
        self.number: dict[tuple[int, str], int] = {}
        self.parent, self.frame = [0], [0]

    def under(self, parent: int, tag: str, name: str) -> int:
        key = (parent, tag + name)
        if key not in self.number:
            self.number[key] = k = len(self.parent)
            self.parent.append(parent)
            self.frame.append(k if tag in FRAMES else self.frame[parent])
        return self.number[key]


class Node:
    """A piece of text: its path, block, whether it is named as none of the content, the marked article it lies in (0: none), link and heading."""

    __slots__ = ("path", "text", "block", "bad", "main", "link", "heading")

    def __init__(self, path, text, block, bad, main, link, heading):
        self.path, self.text, self.block, self.bad, self.main, self.link, self.heading = path, text, block, bad, main, link, heading


class Page:
    """Text nodes in order, the paths, and of each marked article the one around it."""

    def __init__(self):
        self.nodes: list[Node] = []
        self.paths, self.around = Paths(), [0]


def _words(name: str) -> list[str]:
    return re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())


def _against(words: list[str]) -> bool:
    """Whether one name speaks against content; a word among several others that have nothing to do with it says nothing."""
    return any(w in AROUND and (len(words) <= 2 or all(v in AROUND or v in BESIDE for v in words)) for w in words)


def _hints(attrs: str, ids: bool = True) -> tuple[str, bool, bool, bool]:
    """(class of the path, whether the attributes speak against content, whether for it, whether of a headline); without ids an id does not speak against it."""
    if not attrs or "=" not in attrs:
        return "", False, False, False
    against = in_favour = headed = False
    first = ""
    for m in NAMED.finditer(attrs):
        value = (m[2] or m[3] or m[4] or "").strip()
        names = list(map(_words, value.split()))
        against |= any(map(_against, names)) and (ids or m[1].lower() != "id")
        words = {w for n in names for w in n}
        in_favour |= bool(words & CONTENT or {"article", "body"} <= words) or value.lower().replace("-", "") in CONTENT
        headed |= bool(words & HEADED)
        first = first or (f".{value.split()[0]}" if m[1].lower() == "class" and value else "")
    return first, against, in_favour, headed


def read(page: str) -> Page:
    """The text nodes of a page; nodes of one block of text have one number."""
    made = Page()
    # an open element: (tag, path, bad, main, link, heading)
    root = ("", 0, False, 0, False, False)
    stack, open_, deeper, block, at = [root], {}, {}, 0, 0
    n, end_of_tags = len(page), page.rfind(">") + 1

    def text(part: str) -> None:
        if part and (part := html.unescape(part) if "&" in part else part):
            _, path, bad, main, link, heading = stack[-1]
            made.nodes.append(Node(path, part, block, bad, main, link, heading))

    def close(names: set[str], within: set[str] = frozenset()) -> None:
        if not any(open_.get(t) for t in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                for x in stack[k:]:
                    open_[x[0]] -= 1
                del stack[k:]
                return
            if stack[k][0] in within:
                return

    while m := TOKEN.search(page, at, end_of_tags):
        text(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<!--"):
            if not m[0].endswith("-->") and at == end_of_tags:
                at = n
            continue
        if m[0].startswith("<![CDATA["):
            if not m[0].endswith("]]>") and at == end_of_tags:
                at = n
            text(page[m.start() + 9 : at].removesuffix("]]>"))
            continue
        if m["end"]:
            tag = m["end"].lower()
            if tag in BLOCKS:
                block += 1
            elif tag == "br":
                text(" ")
            if deeper.get(tag):
                deeper[tag] -= 1
            else:
                close({tag}, BLOCKS - {tag} if tag not in BLOCKS else {"table"} if tag not in ("table", "body", "html", "article", "main", "div", "section") else frozenset())
            continue
        tag = (m["start"] or m["odd"] or "").lower()
        if not tag:
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}\\s*/?>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in BLOCKS:
            block += 1
            if tag not in ("caption", "tbody", "td", "tfoot", "th", "thead", "tr"):
                close({"p"}, {"article", "aside", "blockquote", "div", "li", "main", "section", "td", "button"})
        if tag in SIBLINGS:
            close(*SIBLINGS[tag])
        if tag in VOID:
            if tag == "br":
                text(" ")
            continue
        if (m["attrs"] or "").endswith("/") and tag not in BLOCKS:
            continue
        if len(stack) > DEPTH:
            deeper[tag] = deeper.get(tag, 0) + 1
            continue
        _, path, bad, main, link, heading = stack[-1]
        name, against, in_favour, headed = _hints(m["attrs"] or "", not (main and tag == "section"))
        if tag == "header":
            against = not (main or headed)
        against &= tag in CONTAINERS
        top = tag in ("html", "body", "main", "article")  # a theme's class on these says nothing
        bad = bad or tag in NEVER or (against and not top and not (in_favour and not main and tag != "div"))
        if tag in ("article", "main") or (in_favour and not bad and not main):
            made.around.append(main)
            main = len(made.around) - 1
        stack.append((tag, made.paths.under(path, tag, name), bad, main, link or tag == "a", heading or tag in HEADINGS))
        open_[tag] = open_.get(tag, 0) + 1
    rest = page[at:]
    cut = CUT_OFF.search(rest)
    text(rest[: cut.start()] if cut else rest)
    return made


def scores(of: list[Node]) -> dict[int, float]:
    """Fused score of each tag path over the given nodes: smoothed length times one more than the smoothed marks, times the share of text outside links."""
    length, links, number = {}, {}, {}
    for x in of:
        length[x.path] = length.get(x.path, 0) + len(x.text)
        links[x.path] = links.get(x.path, 0) + len(x.text) * x.link
        number[x.path] = number.get(x.path, 0) + 1
    marks: dict[int, int] = {}
    for x in of:
        marks[x.path] = marks.get(x.path, 0) + len(PUNCTUATION.findall(x.text))
    ratio = np.array([length[x.path] / number[x.path] for x in of])
    marked = np.array([marks[x.path] / number[x.path] for x in of])
    ratio, marked = (np.convolve(np.pad(v, 1, mode="edge"), SMOOTH, "valid") for v in (ratio, marked))
    total: dict[int, float] = {}
    for x, f in zip(of, ratio * (1 + marked)):
        total[x.path] = total.get(x.path, 0.0) + float(f)
    return {p: total[p] / number[p] * (1 - links[p] / length[p]) for p in total}


def _size(xs) -> int:
    return sum(len(x.text) for x in xs)


def menus(around: dict[int, list[Node]]) -> set[int]:
    """Blocks of MENU links or more, and of runs of so many blocks that are mostly link text."""
    found, run = set(), []
    for b, xs in [*around.items(), (None, [])]:
        if xs and 2 * _size(x for x in xs if x.link) > 2 * LINKS * _size(xs):
            run.append(b)
            if sum(x.link for x in xs) >= MENU:
                found.add(b)
            continue
        if len(run) >= MENU:
            found.update(run)
        run = []
    return found


def beside(page: Page, around: dict[int, list[Node]], kept: set[int]) -> set[int]:
    """Blocks, other than menus, in an article that holds a kept one; without articles in one frame with a kept block, or in a frame within it that lies between kept blocks of it."""
    frame, parent = page.paths.frame, page.paths.parent
    longest = {b: max(xs, key=lambda x: len(x.text)) for b, xs in around.items()}
    first, last, articles = {}, {}, set()
    for b in sorted(kept):
        f, article = frame[longest[b].path], longest[b].main
        first.setdefault(f, b)
        last[f] = b
        while article and article not in articles:
            articles.add(article)
            article = page.around[article]

    def near(b: int) -> bool:
        if longest[b].main:
            return longest[b].main in articles
        f = frame[longest[b].path]
        if f in first:
            return True
        while f:
            f = frame[parent[f]]
            if f in first and first[f] < b < last[f]:
                return True
        return False

    skip = menus(around)
    return {b for b in around if b not in kept and b not in skip and near(b)}


def content(page: Page) -> list[Node]:
    """The nodes that are content."""
    live = [x for x in page.nodes if not x.bad and x.text.strip()]
    of = [x for x in live if x.main] or live
    if not of:
        return []
    fused = scores(of)
    least = TAU * sum(len(x.text) * fused[x.path] for x in of) / _size(of)
    # inline elements share the fate of the block around them, headings that of what follows
    around: dict[int, list[Node]] = {}
    for x in of:
        around.setdefault(x.block, []).append(x)
    kept = {b for b, xs in around.items() if 2 * _size(x for x in xs if fused[x.path] >= least) > _size(xs)}
    kept |= beside(page, around, kept)
    marked = bool(of[0].main)
    keep, follows = set(), False
    for b in reversed(list(around)):
        heading = all(x.heading for x in around[b])
        if (b in kept and (marked or follows or not heading)) or (heading and follows):
            keep.add(b)
        follows = b in keep
    return [x for x in page.nodes if x.block in keep and not x.bad and (x.main or not marked)]


def main_text(page: str | None) -> str:
    """The main text of a page: its blocks, white space squeezed, joined by line ends."""
    blocks: dict[int, list[str]] = {}
    for x in content(read(page or "")):
        blocks.setdefault(x.block, []).append(x.text)
    return "\n".join(t for t in (" ".join("".join(parts).split()) for parts in blocks.values()) if t)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(t.as_py()) for t in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages."""
    ship(pages.sparkSession)
    picked = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return picked.mapInArrow(_batches, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
