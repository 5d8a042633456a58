import html
import re
import time
import tracemalloc

from pyspark.sql import functions as F

from rankloom.llm import htmltext


def plain(page):
    """For the tables' own template: what lies in the article element."""
    m = re.search(r"<article>(.*?)</article>", page or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", m[1] if m else "")
    blocks = (" ".join(html.unescape(re.sub(r"<[a-z/]+>", "", p.replace("<br>", " "))).split()) for p in parts)
    return "\n".join(b for b in blocks if b)


def test_whole_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    rows = htmltext.query(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)
        assert r.text == plain(pages[r.page_id].html), pages[r.page_id].html


LONG = "The council met on Tuesday, and after a long debate it agreed, by a narrow margin, to repair the old bridge. "


def test_no_article_element():
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body class="no-sidebar"><div id="header"><a href="/">Home</a> <a href="/n">News today</a></div>
    <ul class="menu"><li><a>One</a><li><a>Two, three</a></ul><div id="content"><h2>Bridge &amp; road</h2><div class="post"><p>{LONG}</p><p>Short, but <em>part</em> of it.</p><p>{LONG * 2}</p></div>
    <div class="comments"><p>{LONG} says a reader.</p></div></div><div class="sidebar"><p>{LONG}</p></div><div class="cookie-notice">We use cookies, really.</div><form><p>{LONG}</p></form>
    <script>var t = "</p>{LONG}";</script><div class="adBox">Buy now, pay later.</div><div id="footer">&copy; 2020 Someone, all rights.</div>"""
    long = LONG.strip()
    assert htmltext.main_text(page) == f"Bridge & road\n{long}\nShort, but part of it.\n{' '.join([long] * 2)}"


def test_article_with_surroundings():
    page = f"<body><header><p>{LONG}</p></header><nav><p>{LONG}</p></nav><main><article><header><h1>Title</h1></header><p>a<b>b</b>c &lt;d&gt; e\n f<br>g<p>{LONG}<ul><li>first<li>second</ul><aside>{LONG}</aside><section class='comments'>{LONG}</section><div class='share'>Share this</div></article></main><footer>{LONG}</footer>"
    assert htmltext.main_text(page) == f"Title\nabc <d> e f g\n{LONG.strip()}\nfirst\nsecond"


def test_odd_pages(spark):
    odd = [None, "", "<", "no markup, just text.", "<p", "<p>a<p>b", "<!-- <p>x</p> --><p>y", "<div><a href='x>y'>z</a> w, v.</div>", "<p>1 < 2 & 3 &#x41;&nbsp;b</p>", "<script>never", "<p>" * 3000 + "deep.", "<a href=\"" * 2000, "<article></article><p>outside, here.</p>", "<![CDATA[x, y.]]>"]
    want = ["", "", "<", "no markup, just text.", "", "a\nb", "y", None, "1 < 2 & 3 A b", "", "deep.", None, "outside, here.", "x, y."]
    pages = spark.createDataFrame([(i, None, t) for i, t in enumerate(odd)] + [(None, "u", "<p>n"), (2, "u", "<")], "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    rows = htmltext.extract(pages).collect()
    assert len(rows) == len(odd) + 2
    for r in rows:
        if r.page_id is not None and want[r.page_id] is not None:
            assert r.text == want[r.page_id], (odd[r.page_id][:50], r.text)
    assert htmltext.extract(pages.limit(0)).collect() == []


def test_names_of_headings_sections_and_paragraphs_drop_nothing():
    page = f"""<article><h2 id="search-algorithms">Search forms</h2><p class="notice">{LONG}</p><section id="discussion"><h3 id="related">Discussion</h3><p>{LONG * 2}</p></section>
    <p>See <span class="tags">the tags</span> here.</p><section class="comments"><p>{LONG}</p></section><div id="comments"><p>{LONG}</p></div></article>"""
    long = LONG.strip()
    assert htmltext.main_text(page) == f"Search forms\n{long}\nDiscussion\n{' '.join([long] * 2)}\nSee the tags here."


def test_lists_and_short_blocks_beside_content_stay():
    texts = [f"{k} {'x' * 70}, {'x' * 70}, {'x' * 70}, {'x' * 70}." for k in range(10)]
    items = [f"{k} {'y' * 37}." for k in range(5)]
    paragraphs = "".join(f"<p>{t}</p>" for t in texts)
    menu = "<ul class='x'>" + "".join(f"<li><a href='/{k}'>Page {k}</a></li>" for k in range(5)) + "</ul>"
    lists = "<ul>" + "".join(f"<li>{t}</li>" for t in items) + "</ul>"
    page = f"<body><div class='top'><span>Some site</span></div>{menu}<div class='post'>{paragraphs}<div class='w-1/2'>A caption</div><h2>List</h2>{lists}<table><tr><td>cell</td></tr></table><p>{texts[0]}</p>{menu}</div><div class='end'>Made by someone</div></body>"
    assert htmltext.main_text(page).split("\n") == [*texts, "A caption", "List", *items, "cell", texts[0]]


def plain_scores(nodes):
    """The scores by loops over all pairs of nodes and paths."""
    paths = [x.path for x in nodes]
    of = {p: [x for x in nodes if x.path == p] for p in paths}
    length = {p: sum(len(x.text) for x in xs) / len(xs) for p, xs in of.items()}
    marks = {p: sum(c in ".,;:!?…。，、；：！？؟" for x in xs for c in x.text) / len(xs) for p, xs in of.items()}
    smooth = lambda v, i: 0.25 * v[max(0, i - 1)] + 0.5 * v[i] + 0.25 * v[min(len(v) - 1, i + 1)]
    along, marked = [length[p] for p in paths], [marks[p] for p in paths]
    fused = [smooth(along, i) * (1 + smooth(marked, i)) for i in range(len(paths))]
    free = {p: 1 - sum(len(x.text) for x in xs if x.link) / sum(len(x.text) for x in xs) for p, xs in of.items()}
    return {p: sum(f for f, q in zip(fused, paths) if q == p) / len(xs) * free[p] for p, xs in of.items()}


MENU = "".join(f"<li><a href='/{k}'>Page {k}</a></li>" for k in range(6))
SENTENCE = "The bridge, built long ago, was repaired in spring; the road, too, was closed for a while."
BODY = [f"{k}. {SENTENCE} {SENTENCE}" for k in range(6)]
PARAGRAPHS = "".join(f"<p>{t}</p>" for t in BODY)
#: Pages without a name that tells content from the rest, some with a marked article, and the blocks that are content.
UNNAMED = [
    (f"<body><div><ul>{MENU}</ul></div><div><div>{PARAGRAPHS}</div></div><div><span>Made by someone</span></div></body>", BODY),
    (f"<body><div><div><div>Sign in</div><div>Cart</div></div></div><table><tr><td>{PARAGRAPHS}</td><td><ul>{MENU}</ul></td></tr></table></body>", BODY),
    (f"<body><main><article>{PARAGRAPHS}<ul>{MENU}</ul></article><article><h3>Teaser</h3><p><a>Read more</a></p></article></main></body>", BODY),
    (f"<body><article><div><a>Home</a> / <a>News</a> / <a>Town</a></div><h1>Bridge</h1>{PARAGRAPHS}</article></body>", ["Bridge", *BODY]),
    (f"<body><article>{PARAGRAPHS}<p>See <a>the other very long report on it</a></p><p>End</p></article></body>", [*BODY, "See the other very long report on it", "End"]),
]


def test_scores_against_plain_version(spark):
    pages = [p for p, _ in UNNAMED] + [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()[:20]]
    for page in pages:
        live = [x for x in htmltext.read(page).nodes if x.text.strip() and not x.bad]
        got, want = htmltext.scores(live), plain_scores(live)
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) <= 1e-9 * max(1, want[p]) for p in want)


def test_scores_decide(monkeypatch):
    want = ["\n".join(blocks) for _, blocks in UNNAMED]
    assert [htmltext.main_text(p) for p, _ in UNNAMED] == want
    monkeypatch.setattr(htmltext, "scores", lambda of: {x.path: 1.0 for x in of})
    off = [htmltext.main_text(p) for p, _ in UNNAMED]
    assert all(a != b for a, b in zip(off[:4], want))


def test_tables_without_article_element(spark):
    """Read as plain divisions, the tables' articles come out the same."""
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        assert htmltext.main_text(re.sub("<(/?)(article|main)", r"<\1div", r.html or "")) == plain(r.html)


def test_headlines_and_longer_names_stay():
    page = f"<article><header class='entry-header'><h1>Title</h1></header><div class='notice-board-history'><p>{LONG}</p></div><p>{LONG}</p></article>"
    assert htmltext.main_text(page) == f"Title\n{LONG.strip()}\n{LONG.strip()}"
    page = f"<div class='post'><header class='entry-header'><h1>Title</h1></header><p>{LONG}</p><div class='cookie-notice-box'>{LONG}</div><div class='comment-list'>{LONG}</div></div><header>{LONG}</header>"
    assert htmltext.main_text(page) == f"Title\n{LONG.strip()}"


def test_hostile_pages_are_read_in_linear_time():
    for part, n in (("<div>word ", 32_000), ("<a ", 333_000), ("<a", 500_000), ("<!-- ", 200_000), ('<a ="', 200_000), ("</x ", 200_000), ("<p>x", 100_000)):
        tracemalloc.start()
        began = time.process_time()
        htmltext.main_text(part * n)
        took, most = time.process_time() - began, tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert took < 20 and most < 200e6, (part, took, most)  # tracing makes it many times slower
    began = time.process_time()
    htmltext.main_text("<a " * 333_000)
    assert time.process_time() - began < 1
    deep = "<div>" * 600 + "<nav>" + "<div>" * 5 + "x" + "</div>" * 5 + "menu</nav>" + f"<p>{LONG}</p>" + "</div>" * 600 + f"<p>{LONG}</p>"
    assert htmltext.main_text(deep).count(LONG.strip()) == 2


def test_formulas_and_fallbacks_stay():
    page = "<html><body><article><p>The formula <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding='tex'>x = 1</annotation></math> holds for all of the cases above.</p><object><p>A picture of the house, as seen from the garden.</p></object></article></body></html>"
    assert htmltext.main_text(page) == "The formula x=1 holds for all of the cases above.\nA picture of the house, as seen from the garden."
