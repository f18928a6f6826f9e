"""Queries over small literal tables, for rules whose cases the test tables do not hold.

Each query builds its input from literals and runs an operator on it; its SQL
lists the rows that the operator's contract asks for.
"""

from __future__ import annotations

import gzip

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import html, safety
from ..functions import text as T
from ..functions import url as U
from ..operators import jobs as J
from ..operators import links as L
from ..operators import markdown as M
from ..operators import pagetext as P
from ..operators import pipeline as W
from ..operators import sitemap as X
from ..sources import readers, sinks
from ..streaming import events as E
from .registry import query

_TYPES = {"string": "varchar", "bigint": "bigint", "boolean": "boolean", "double": "double"}


def _value(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    return repr(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def rows(columns: str, want: list[tuple]) -> str:
    """SQL of the given rows; ``columns`` names and types them."""
    named = [c.split() for c in columns.split(", ")]
    out = ", ".join(f"cast({n} as {_TYPES[t]}) as {n}" for n, t in named)
    return f"select {out} from (values {', '.join('(' + ', '.join(map(_value, r)) + ')' for r in want)}) t({', '.join(n for n, _ in named)})"


def _in(spark, columns: str, data: list[tuple]):
    return spark.createDataFrame(data, columns)


def _texts(spark, data: list[tuple], f, name: str = "t"):
    """(n, out) of a text function applied to (n, text) rows."""
    return _in(spark, f"n bigint, {name} string", data).select("n", f(F.col(name)).alias("out"))


# --- HTML

_DOC = """<!DOCTYPE html><html><head><title> Pump &amp; Valve </title><link rel="stylesheet" href="/css/site.css"><script src="app.js"></script></head>
<body><nav><a href="/start">Start</a></nav><main id="content"><h1>Pumps</h1><p class="lead">How a pump is set up, in more words than a menu holds, so that this part is the content.</p>
<p><a href="parts.html">Parts</a> and <a href="https://other.example">others</a> <a href="mailto:x@y.example">mail</a></p><img src="/img/pump.png" alt="Pump"><img src='fan.png'></main></body></html>"""


@query(rows("n bigint, title string", [(1, "Pump & Valve"), (2, None), (3, None), (4, "")]))
def html_title_cases(spark, path):
    df = _in(spark, "n bigint, t string", [(1, _DOC), (2, "<p>no title</p>"), (3, None), (4, "<title></title>")])
    return df.select("n", html.title_udf("t").alias("title"))


@query(rows("pos bigint, link string", [(0, "https://docs.pump.example/start"), (1, "https://docs.pump.example/guide/parts.html"), (2, "https://other.example/"), (3, "mailto:x@y.example")]))
def html_link_cases(spark, path):
    df = _in(spark, "page_id bigint, html string, url string", [(1, _DOC, "https://docs.pump.example/guide/"), (2, None, "https://docs.pump.example/"), (3, "<a>no target</a><a href=''></a>", None)])
    return L.extract(df).select(F.col("pos").cast("bigint").alias("pos"), "link")


@query(rows("pos bigint, asset string", [(0, "https://h.example/img/pump.png"), (1, "https://h.example/d/fan.png"), (2, "https://h.example/css/site.css"), (3, "https://h.example/d/app.js")]))
def html_asset_cases(spark, path):
    df = _in(spark, "html string, url string", [(_DOC, "https://h.example/d/"), (None, "https://h.example/")])
    return df.select(F.posexplode(html.assets_udf("html", "url")).alias("pos", "asset")).select(F.col("pos").cast("bigint").alias("pos"), "asset")


@query(rows("selectors string, out string", [("h1", "Pumps"), ("main#content h1", "Pumps"), ("main > h1", "Pumps"), ("p.lead", "How a pump is set up, in more words than a menu holds, so that this part is the content."), ("h1|title", "Pumps\n\n Pump &amp; Valve "), ("div.none", None), ("[[", None), ("img[src$='.png'], nav", '<a href="/start">Start</a>\n\n\n\n')]))
def html_selector_cases(spark, path):
    lists = ["h1", "main#content h1", "main > h1", "p.lead", "h1|title", "div.none", "[[", "img[src$='.png'], nav"]
    df = _in(spark, "html string", [(_DOC,)])
    return df.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, lists)), F.array(*(html.selected_udf(s.split("|"))("html") for s in lists)))).alias("selectors", "out"))


@query(rows("n bigint, out string", [(1, "<h1>Long</h1><p>" + "word " * 30 + "</p>"), (2, "<p>" + "text " * 30 + "</p>"), (3, "<main>too short</main><p>all</p>"), (4, None), (5, "<b>x</b>")]))
def html_content_cases(spark, path):
    long = "<h1>Long</h1><p>" + "word " * 30 + "</p>"
    data = [(1, f"<nav>menu</nav><main>{long}</main>"), (2, f"<main>short</main><div class='page-content'><p>{'text ' * 30}</p></div>"), (3, "<main>too short</main><p>all</p>"), (4, None), (5, "<b>x</b>")]
    return L.content_places(_in(spark, "page_id bigint, html string", data), L.CrawlConfig()).select(F.col("page_id").alias("n"), F.col("content").alias("out"))


@query(rows("n bigint, out string", [(1, '<img src="assets/h.example/a.png" alt="A"><img src="/unknown.png"><script src="assets/h.example/x.js"></script>'), (2, '<img alt="first" src="assets/h.example/a.png">'), (3, "<p>none</p>"), (4, "<img src=/a.png>"), (5, None)]))
def html_rewrite_cases(spark, path):
    data = [(1, '<img src="/a.png" alt="A"><img src="/unknown.png"><script src="/x.js"></script>'), (2, "<img alt=\"first\" src='/a.png'>"), (3, "<p>none</p>"), (4, "<img src=/a.png>"), (5, None)]
    df = _in(spark, "page_id bigint, html string", data).withColumn("url", F.lit("https://h.example/d/"))
    assets = _in(spark, "url string, content_type string", [("https://h.example/a.png", "image/png"), ("https://h.example/x.js", "application/javascript"), ("https://h.example/unknown.png", "text/html")])
    return W.with_assets(df, assets).where("page_id <> 4").select(F.col("page_id").alias("n"), F.col("html").alias("out")).union(df.where("page_id = 4").select("page_id", html.rewrite_udf("html", "url", F.create_map(F.lit("https://h.example/a.png"), F.lit("b.png")))))


_HTML = [("<h1>Top</h1><p>Some <b>bold</b> and <i>slanted</i> text.</p>", "# Top\n\nSome **bold** and *slanted* text."), ("<ul><li>one</li><li>two</li></ul>", "* one\n* two"), ("<ol><li>one</li><li>two</li></ol>", "1. one\n2. two"), ('<p><a href="https://x.example/">link</a></p>', "[link](https://x.example/)"), ('<pre><code class="language-sh">run  it\n</code></pre>', "```sh\nrun  it\n```"), ("", ""), ("<div><div><p>deep</p></div></div>", "deep"), ("<p>a<!-- note -->b</p>", "ab"), ("<p>one <span>two</span></p>", "one two"), ("<script>x()</script><style>p{}</style><p>kept</p>", "kept"), ("<blockquote><p>said</p></blockquote>", "> said"), ("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2|3</td></tr></table>", "| a | b |\n| --- | --- |\n| 1 | 2\\|3 |"), ('<p><img src="i.png" alt="I"></p><hr><h3>End</h3>', "![I](i.png)\n\n---\n\n### End"), ('<p>x<a href="/e"> </a>y</p>', "xy"), ("<div>" * 3000 + "<p>far down</p>" + "</div>" * 3000, "far down")]


@query(rows("n bigint, out string", [(i, want) for i, (_, want) in enumerate(_HTML)]))
def html_markdown_cases(spark, path):
    return _texts(spark, [(i, t) for i, (t, _) in enumerate(_HTML)], lambda c: html.to_markdown_udf(c))


_PAGE_MD = "# Pumps\n\nHow a pump is set up, in more words than a menu holds, so that this part is the content.\n\n[Parts](parts.html) and [others](https://other.example) [mail](mailto:x@y.example)\n\n![Pump](/img/pump.png)![](fan.png)"


@query(rows("page_id bigint, host string, path string, title string, links bigint, markdown string", [(1, "h.example", "guide/pumps.md", "Pump & Valve", 4, _PAGE_MD), (2, "unknown", "none", "none", 0, "none")]))
def html_convert_cases(spark, path):
    df = _in(spark, "page_id bigint, url string, html string", [(1, "https://h.example/guide/pumps.html", _DOC), (2, "no url", None)])
    out = W.convert(df)
    return out.select("page_id", "host", F.coalesce("path", F.lit("none")).alias("path"), F.coalesce("title", F.lit("none")).alias("title"), "links", F.coalesce("markdown", F.lit("none")).alias("markdown"))


_MD = [("# T\n\ntext **b** `c`", "<h1>T</h1>\n<p>text <strong>b</strong> <code>c</code></p>"), ("Title\n====\n\nSub\n---", "<h1>Title</h1>\n<h2>Sub</h2>"), ("* a\n* b\n\n1. c", "<ul>\n<li>a</li>\n<li>b</li>\n</ul>\n<ol>\n<li>c</li>\n</ol>"), ("~~old~~ *new*", "<p><del>old</del> <em>new</em></p>"), ("```py\na < b\n```", '<pre><code class="language-py">a &lt; b\n</code></pre>'), ("| a | b |\n|---|---|\n| 1 | 2 |", "<table>\n<thead><tr><th>a</th><th>b</th></tr></thead>\n<tbody><tr><td>1</td><td>2</td></tr></tbody>\n</table>"), ("> quoted\n\n---", "<blockquote>\n<p>quoted</p>\n</blockquote>\n<hr />"), ("[x](https://x.example) ![y](y.png)", '<p><a href="https://x.example">x</a> <img src="y.png" alt="y" /></p>'), ("", "")]


@query(rows("n bigint, out string", [(i, want) for i, (_, want) in enumerate(_MD)]))
def md_to_html_cases(spark, path):
    return _texts(spark, [(i, t) for i, (t, _) in enumerate(_MD)], lambda c: html.to_html_udf(c))


_PREVIEW = [("# Big\n#### Small\n##### five", "<h1>Big</h1>\n<h4>Small</h4>\n<p>##### five</p>"), ("a **b** *c* __d__ ***e***", "<p>a <strong>b</strong> <em>c</em> <strong>d</strong> <strong><em>e</em></strong></p>"), ("<script>alert(1)</script>", "<p>&lt;script&gt;alert(1)&lt;/script&gt;</p>"), ("[ok](https://x.example/a_b_c) [bad](javascript:x)", '<p><a href="https://x.example/a_b_c" target="_blank" rel="noopener">ok</a> bad</p>'), ("- one\n* two\n1. three", "<ul><li>one</li><li>two</li></ul>\n<ol><li>three</li></ol>"), ("> said\n---\n", "<blockquote>said</blockquote>\n<hr>\n<div></div>"), ("```sh\nx < 1\n**no**\n```", "<pre><code>x &lt; 1\n**no**</code></pre>"), ("`a*b*`", "<p><code>a*b*</code></p>")]


@query(rows("n bigint, out string", [(i, want) for i, (_, want) in enumerate(_PREVIEW)]))
def md_preview_cases(spark, path):
    return _texts(spark, [(i, t) for i, (t, _) in enumerate(_PREVIEW)], lambda c: html.preview_udf(c))


@query(rows("n bigint, starts boolean, body string", [(1, True, "<h1>T</h1>\n"), (2, True, "\n")]))
def html_export_cases(spark, path):
    out = _texts(spark, [(1, "# T"), (2, "")], lambda c: html.page_of_udf(c))
    return out.select("n", F.col("out").startswith("<!DOCTYPE html>\n<html>\n<head>").alias("starts"), F.regexp_extract("out", r"(?s)<body>(.*)</body>", 1).alias("body"))


# --- Markdown

_UI = "# Setup\nCopyPage OpenMarkdown EditPage\nCopyPage\nEdit  page\nCopy page Copy code\nkept: Copy code here\n  We use  cookies to count visits\nSubscribe to our newsletter\nCopy code\n\nend"
_LONG = "A line of words that is long enough to count as a section of its own when it comes again. " * 2
_TOC = "* [One](#one)\n* [Two](#two)\n- [Three](x.html#three)"


def _joined(*parts):
    return "\n\n".join(parts)


_MD_RULES = {
    "boilerplate": (M.strip_ui, [(_UI, "# Setup\nCopy page Copy code\nkept: Copy code here\n\nend"), ("a\r\nCopy code\r\nb\r\n", "a\nb"), ("", ""), ("copy page", "")]),
    "dedup": (M.dedup, [(_joined(_LONG, "a", _LONG, "b", "a", "c"), _joined(_LONG, "a", "b", "a", "c")), (_joined("1", "2", "3", _TOC, "4", "5"), _joined("1", "2", "3", "4", "5")), (_joined("1", _TOC), _joined("1", _TOC)), (_joined("1", "2", "3", "* plain\n* list\n* here", "4", "5"), _joined("1", "2", "3", "* plain\n* list\n* here", "4", "5"))]),
    "stubs": (M.strip_trailing_stubs, [(_joined("Full text stands here.", "## A", "Body of some length that ends.", "## B", "🔧 Tools", "Set\n---"), _joined("Full text stands here.", "## A", "Body of some length that ends.")), (_joined("Full text stands here.", "b is a text that is long enough", "c.", "* short item"), _joined("Full text stands here.", "b is a text that is long enough", "c.")), (_joined("## A", "## B", "## C", "## D"), _joined("## A", "## B", "## C", "## D")), (_joined("text.", "## A", "## B"), _joined("text.", "## A", "## B")), (_joined("", "## A", "## B", "## C"), ""), (_joined("x.", "y.", "z.", "## H\nwith a line"), _joined("x.", "y.", "z.", "## H\nwith a line"))]),
    "collapse": (M.collapse_blank, [("a\n\n\n\nb\n\nc", "a\n\nb\n\nc"), ("\n\n\n", "\n\n")]),
    "links": (M.remove_empty_links, [("see [here]() and [there]( ) or [x](y)", "see here and there or [x](y)"), ("[]()", "[]()")]),
    "images": (M.remove_broken_images, [("a ![alt]() b ![]( ) c ![ok](i.png)", "a  b  c ![ok](i.png)")]),
    "scripts": (M.strip_script_and_style, [("a<script src='x'>\nb()</script>c<STYLE>p{}</STYLE>d", "acd"), ("<script>open", "<script>open")]),
    "anchors": (M.strip_empty_links, [('a<a href="#x" class="k"> </a>b<a href="#y">t</a>', 'ab<a href="#y">t</a>')]),
    "clean": (M.clean, [("[Click]( ) ![Alt]()", "Click "), (_joined("# T", "Copy code", _LONG, "x.", _LONG, "y.", "z.", "## End"), _joined("# T", "", _LONG, "x.", "y.", "z.").replace("\n\n\n\n", "\n\n")), ("", "")]),
    "clean_compat": (lambda c: M.clean(c, compat=True), [("![Alt]()", "!Alt")]),
    "toc": (lambda c: M.is_toc(c).cast("string"), [(_TOC, "true"), ("* [a](#a)\n* [b](#b)", "false"), ("* [a](#a)\n* b\n* c", "false"), ("* [a](#a)\ntext\n* [b](#b)\n* c", "true")]),
}
_RULE_ROWS = [(name, i, a, z) for name, (_, cases) in _MD_RULES.items() for i, (a, z) in enumerate(cases)]


@query(rows("rule string, n bigint, out string", [(name, i, z) for name, i, _, z in _RULE_ROWS]))
def md_rule_cases(spark, path):
    df = _in(spark, "rule string, n bigint, t string", [r[:3] for r in _RULE_ROWS])
    out = None
    for name, (f, _) in _MD_RULES.items():
        out = F.when(F.col("rule") == name, f(F.col("t"))) if out is None else out.when(F.col("rule") == name, f(F.col("t")))
    return df.select("rule", "n", out.alias("out"))


@query(rows("n bigint, title string", [(1, "Hi"), (2, "Set"), (3, "stem"), (4, "stem"), (5, "First")]))
def md_title_cases(spark, path):
    return _in(spark, "n bigint, t string", [(1, "x\n# Hi \n"), (2, "Set\n====\n"), (3, "none"), (4, ""), (5, "# First\n\n# Second")]).select("n", M.title(F.col("t"), F.lit("stem")).alias("title"))


# --- pages of books

_BODY = [f"Body {w} one stands here.\nMore of {w} follows.\nAnd {w} ends the page." for w in ("alpha", "beta", "gamma", "delta", "epsilon")]
_BOOKS = {
    "manual": ([f"Pump Manual\n{b}\nwww.pump.example" for b in _BODY], _BODY),
    "chapters": ([f"Part {i} / Setup of pumps\n{b}" for i, b in enumerate(_BODY, 1)], _BODY),
    "two pages": ([f"Pump Manual\n{b}" for b in _BODY[:2]], [f"Pump Manual\n{b}" for b in _BODY[:2]]),
    "numbers": (["42\n" + _BODY[0], "Page 5\n" + _BODY[1], _BODY[2] + "\n- 3 -"], _BODY[:3]),
    "kept number": (["first line\nsecond line\nthird line\nfourth line\nfifth line\nthe count\n42\nof parts\nsixth line\nseventh line\neighth line\nninth line\ntenth line"], ["first line\nsecond line\nthird line\nfourth line\nfifth line\nthe count\n42\nof parts\nsixth line\nseventh line\neighth line\nninth line\ntenth line"]),
    "roman": (["iv\nOne line of text.", "1 of 10\nAnother line of text."], ["One line of text.", "Another line of text."]),
    "running": (["\n".join([*(f"{w} line {k}" for k in "abcdef"), str(i + 3), *(f"{w} line {k}" for k in "ghijkl")]) for i, w in enumerate(("alpha", "beta", "gamma"))], ["\n".join(f"{w} line {k}" for k in "abcdefghijkl") for w in ("alpha", "beta", "gamma")]),
    "notes": (["A claim[1] stands here[22].\nMore text.\n___\n1. First note\n2) Second note"], ["A claim stands here.\nMore text."]),
    "notices": (["© 2020 Pump\nBody line one.\nThe copyrighted text.\nBody line two.\nDraft - do not distribute"], ["Body line one.\nThe copyrighted text.\nBody line two."]),
    "inner notice": (["\n".join([*(f"line {k}" for k in "abcdef"), "the © sign stays", *(f"line {k}" for k in "ghijkl")])], ["\n".join([*(f"line {k}" for k in "abcdef"), "the © sign stays", *(f"line {k}" for k in "ghijkl")])]),
    "blanks": (["a line\n \n\n\nb line", "", None, "  \n", "last line"], ["a line\n\nb line", "last line"]),
}


@query(rows("book string, page_no bigint, out string", [(b, i, t) for b, (_, want) in _BOOKS.items() for i, t in enumerate(want)]))
def clean_book_cases(spark, path):
    pages = _in(spark, "book string, page_no int, text string", [(b, i, t) for b, (given, _) in _BOOKS.items() for i, t in enumerate(given)])
    return P.clean_pages(pages).select("book", F.col("page_no").cast("bigint").alias("page_no"), F.col("text").alias("out"))


@query(rows("sig string, top boolean, uses bigint", [("pump manual", True, 5), ("www.pump.example", False, 5)]))
def clean_header_cases(spark, path):
    pages = _in(spark, "book string, page_no int, text string", [("b", i, t) for i, t in enumerate(_BOOKS["manual"][0])])
    return P.frequent_edges(pages.select("book", "page_no", P.page_lines(F.col("text")).alias("lines")), P.book_sizes(pages)).select("sig", "top", "uses")


@query(rows("page_no bigint, line_no bigint", [(0, 6), (1, 6), (2, 6)]))
def clean_sequence_cases(spark, path):
    pages = _in(spark, "book string, page_no int, text string", [("b", i, t) for i, t in enumerate(_BOOKS["running"][0])])
    return P.sequential_numbers(pages.select("book", "page_no", P.page_lines(F.col("text")).alias("lines")), P.book_sizes(pages)).select(F.col("page_no").cast("bigint").alias("page_no"), F.col("line_no").cast("bigint").alias("line_no"))


@query(rows("form string, part bigint, content string", [("pdf", 0, "# B\n\n## Page 1\n\none\n\n## Page 2\n\ntwo"), ("single", 0, "# S\n\nalone"), ("epub", 0, "# B\n\none\n\n---\n\ntwo"), ("images", 0, "# B\n\n## Extracted Images\n\n![i](a.png)\n\n![j](b.png)\n\n---\n\n## Page 1\n\none\n\n## Page 2\n\ntwo"), ("cut", 0, "# B\n\none"), ("cut", 1, "\n\n---\n\ntwo")]))
def import_book_cases(spark, path):
    two = _in(spark, "book string, page_no int, text string", [("B", 0, "one"), ("B", 1, "two")])
    one = _in(spark, "book string, page_no int, text string", [("S", 0, "alone")])
    images = _in(spark, "book string, pos int, ref string", [("B", 1, "![j](b.png)"), ("B", 0, "![i](a.png)")])
    made = {"pdf": sinks.book(two), "single": sinks.book(one), "epub": sinks.book(two, "epub"), "images": sinks.book(two, images=images), "cut": sinks.book(two, "epub", size=4)}
    out = None
    for form, df in made.items():
        part = df.select(F.lit(form).alias("form"), "part", "content")
        out = part if out is None else out.unionByName(part)
    return out


# --- urls, links, safety

_PATHS = [("https://h.example/docs/guide", "docs/guide.md", "h.example/docs/guide"), ("https://h.example/", "index.md", "h.example/index.asset"), ("https://h.example", "index.md", "h.example/index.asset"), ("https://h.example/page.html", "page.md", "h.example/page.html"), ("https://h.example/a/b.php?x=1#y", "a/b.md", "h.example/a/b.php"), ("https://h.example/../../etc/passwd", "etc/passwd.md", "h.example/etc/passwd"), ("https://h.example/d/", "d/index.md", "h.example/d"), ("no url", None, None)]


@query(rows("url string, page_path string, asset_path string", _PATHS))
def url_path_cases(spark, path):
    return _in(spark, "url string", [(u,) for u, *_ in _PATHS]).select("url", U.page_path(F.col("url")).alias("page_path"), U.asset_path(F.col("url")).alias("asset_path"))


_RESOLVE = [("https://h.example/docs/", "/about", "https://h.example/about"), ("https://h.example/docs/", "page2.html", "https://h.example/docs/page2.html"), ("https://h.example/docs/a", "../b?x=1", "https://h.example/b?x=1"), ("https://h.example/docs/", "https://o.example", "https://o.example/"), ("https://h.example/docs/", "//c.example/x", "https://c.example/x"), ("https://h.example/p?q=1", "#top", "https://h.example/p?q=1#top"), (None, "/about", None), ("https://h.example/", "http://[bad", None)]


@query(rows("n bigint, resolved string", [(i, w) for i, (_, _, w) in enumerate(_RESOLVE)]))
def link_resolve_cases(spark, path):
    df = _in(spark, "page_id bigint, url string, links array<string>", [(i, b, [h]) for i, (b, h, _) in enumerate(_RESOLVE)])
    return L.listed(df).select(F.col("page_id").alias("n"), "resolved")


_PREFIXES = [(" /docs ", "/docs"), ("docs", "/docs"), ("/docs?x#y", "/docs"), ("/", "/"), ("  ", None), ("#x", None), (None, None)]


@query(rows("n bigint, prefix string", [(i, w) for i, (_, w) in enumerate(_PREFIXES)]))
def path_prefix_cases(spark, path):
    return _in(spark, "n bigint, t string", [(i, t) for i, (t, _) in enumerate(_PREFIXES)]).select("n", U.path_prefix(F.col("t")).alias("prefix"))


_PRIVATE = ["http://localhost/", "http://127.0.0.1/x", "http://127.9.9.9/", "http://10.0.0.1/", "http://172.16.0.1/", "http://172.31.255.1/", "http://192.168.1.1/", "http://169.254.1.1/", "http://0.0.0.0/", "http://[::1]/", "http://[fe80::1]/", "http://printer.local/", "nonsense", "file:///etc/passwd"]
_PUBLIC = ["https://docs.pump.example/", "http://8.8.8.8/", "http://172.32.0.1/", "http://[2001:4860::8888]/"]


@query(rows("url string, private boolean, start string", [(u, True, "refused") for u in _PRIVATE] + [(u, False, "ok") for u in _PUBLIC]))
def ssrf_cases(spark, path):
    def start(u):
        try:
            L.CrawlConfig().check(u)
            return "ok"
        except ValueError:
            return "refused"

    df = _in(spark, "url string, start string", [(u, start(u)) for u in _PRIVATE + _PUBLIC])
    return df.select("url", safety.is_private(F.col("url")).alias("private"), "start")


_CONFIGS = [({}, "ftp://h.example/", "refused"), ({"max_depth": 0}, None, "refused"), ({"page_limit": 0}, None, "refused"), ({"headless_strategy": ""}, None, "refused"), ({"exclude_patterns": ["["]}, None, "refused"), ({"include_patterns": ["["]}, None, "refused"), ({"ssrf_protection": False}, "http://localhost/", "ok"), ({}, "https://h.example/", "ok"), ({}, "https://", "refused"), ({"exclude_patterns": [""]}, None, "ok")]


@query(rows("n bigint, result string", [(i, w) for i, (_, _, w) in enumerate(_CONFIGS)]))
def crawl_config_cases(spark, path):
    out = []
    for i, (kw, seed, _) in enumerate(_CONFIGS):
        try:
            L.CrawlConfig(**kw).check(seed)
            out.append((i, "ok"))
        except ValueError:
            out.append((i, "refused"))
    return _in(spark, "n bigint, result string", out)


_MIMES = [("image/png", True), ("image/svg+xml; charset=utf-8", True), ("FONT/woff2", True), ("text/css", True), ("text/html", False), ("Text/HTML; charset=x", False), ("application/xhtml+xml", False), ("application/javascript", True), ("application/x-msdownload", False), ("", True), (None, True), ("application/pdf", True), ("application/zip", False)]


@query(rows("n bigint, allowed boolean", [(i, w) for i, (_, w) in enumerate(_MIMES)]))
def asset_mime_cases(spark, path):
    return _in(spark, "n bigint, t string", [(i, t) for i, (t, _) in enumerate(_MIMES)]).select("n", safety.is_allowed_mime(F.col("t")).alias("allowed"))


@query(rows("n bigint", [(1,), (5,)]))
def asset_fetch_cases(spark, path):
    df = _in(spark, "n bigint, status int, content_type string, body binary", [(1, 200, "image/png", b"x"), (2, 404, "image/png", b"x"), (3, 200, "text/html", b"x"), (4, 200, "image/png", None), (5, 206, None, b"")])
    return readers.allowed_assets(df).select("n")


_ERRORS = [("Permission denied (os error 13)", True, False), ("No space left on device", True, False), ("read-only file system", True, False), ("failed: os error 28", True, False), ("operation timed out", False, True), ("Connection refused", False, True), ("dns error: no record", False, True), ("404 Not Found", False, False), (None, False, False)]


@query(rows("n bigint, disk boolean, transient boolean", [(i, d, t) for i, (_, d, t) in enumerate(_ERRORS)]))
def error_kind_cases(spark, path):
    df = _in(spark, "n bigint, t string", [(i, t) for i, (t, *_) in enumerate(_ERRORS)])
    return df.select("n", safety.is_disk_error(F.col("t")).alias("disk"), safety.is_transient_error(F.col("t")).alias("transient"))


@query(rows("status bigint, transient boolean, wait bigint", [(200, False, 1000), (404, False, 2000), (408, True, 4000), (429, False, 8000), (500, True, 16000), (599, True, 32000), (600, False, 64000)]))
def fetch_status_cases(spark, path):
    df = _in(spark, "status bigint, attempt int", [(s, i) for i, s in enumerate([200, 404, 408, 429, 500, 599, 600])])
    return df.select("status", safety.is_transient_status(F.col("status")).alias("transient"), safety.backoff_ms(F.col("attempt")).alias("wait"))


_FETCHED = [("plain", None, 200, "auto", "plain"), ("", "drawn", 200, "auto", "drawn"), ("plain", "drawn", 200, "always", "drawn"), ("plain", "drawn", 200, "never", "plain"), ("plain", None, 500, "auto", None), (None, "drawn", 404, "auto", "drawn"), ("  ", None, 200, "auto", "  ")]


@query(rows("n bigint, body string, retry boolean", [(i, w, s == 500) for i, (_, _, s, _, w) in enumerate(_FETCHED)]))
def fetch_render_cases(spark, path):
    out = None
    for kind in ("auto", "always", "never"):
        df = _in(spark, "n bigint, html string, rendered string, status int", [(i, h, r, s) for i, (h, r, s, k, _) in enumerate(_FETCHED) if k == kind])
        part = readers.fetched(df, kind).select("n", "body", "retry")
        out = part if out is None else out.unionByName(part)
    return out


_MIME_EXT = [("image/jpeg", "jpg"), ("image/jpg", "jpg"), ("IMAGE/PNG", "png"), ("image/gif", "gif"), ("image/svg+xml", "svg"), ("image/webp", "webp"), ("image/tiff", "bin"), (None, "bin")]


@query(rows("n bigint, ext string", [(i, w) for i, (_, w) in enumerate(_MIME_EXT)]))
def image_extension_cases(spark, path):
    return _in(spark, "n bigint, t string", [(i, t) for i, (t, _) in enumerate(_MIME_EXT)]).select("n", safety.image_extension(F.col("t")).alias("ext"))


_FORMATS = [("bytes", "0", "0 B"), ("bytes", "1023", "1023 B"), ("bytes", "1024", "1.0 KB"), ("bytes", "1536", "1.5 KB"), ("bytes", "104857600", "100 MB"), ("uptime", "0", "00:00:00"), ("uptime", "3661", "01:01:01"), ("uptime", "360000", "100:00:00"), ("name", "a b/ü.md", "a_b_ü.md"), ("extension", "/x/Book.EPUB", "epub"), ("extension", "none", ""), ("local", "sm:LOC", "loc"), ("local", "loc", "loc")]


@query(rows("kind string, given string, out string", _FORMATS))
def format_cases(spark, path):
    c, k = F.col("given"), F.col("kind")
    number = F.expr("try_cast(given as bigint)")
    out = F.when(k == "bytes", T.format_bytes(number)).when(k == "uptime", T.format_uptime(number)).when(k == "name", T.safe_name(c)).when(k == "extension", T.extension(c)).otherwise(U.local_name(c))
    return _in(spark, "kind string, given string", [r[:2] for r in _FORMATS]).select("kind", "given", out.alias("out"))




@query(rows("link string, kept boolean", [("https://h.example/docs/api/x", True), ("https://h.example/docs/guide", True), ("https://h.example/docs/login", False), ("https://h.example/blog", False), ("https://h.example/v2/a", True), ("https://o.example/docs/x", False), ("http://10.0.0.1/docs/x", False), ("mailto:a@h.example", False)]))
def link_filter_cases(spark, path):
    given = ["https://h.example/docs/api/x", "https://h.example/docs/guide", "https://h.example/docs/login", "https://h.example/blog", "https://h.example/v2/a", "https://o.example/docs/x", "http://10.0.0.1/docs/x", "mailto:a@h.example"]
    df = _in(spark, "link string", [(u,) for u in given])
    kept = L.admit(df, L.CrawlConfig(include_patterns=["/v2/.*", ""], path_prefix="docs?x", exclude_patterns=[".*/login.*"]), "h.example").withColumn("kept", F.lit(True))
    return df.join(kept, "link", "left").select("link", F.coalesce("kept", F.lit(False)).alias("kept"))


_ROBOTS = {"a.example": "User-agent: *\nDisallow: /private/\nAllow: /private/open\nCrawl-delay: 5\n", "b.example": "User-agent: other\nDisallow: /\n", "c.example": "# all closed\nUser-agent: *\nDisallow: / # everything\n", "d.example": "User-agent: *\nDisallow:\n", "e.example": "User-agent: leafmill\nDisallow: /x\nUser-agent: *\nDisallow: /\n", "f.example": None}
_ASKED = [("a.example", "/private/x", False), ("a.example", "/private/open/y", True), ("a.example", "/", True), ("b.example", "/any", True), ("c.example", "/any", False), ("d.example", "/any", True), ("e.example", "/any", True), ("e.example", "/xy", False), ("none.example", "/any", True), ("f.example", "/any", True)]


@query(rows("host string, path string, allowed boolean, delay bigint", [(h, p, w, 5 if h == "a.example" else -1) for h, p, w in _ASKED]))
def robots_cases(spark, path):
    rules = L.robots_rules(_in(spark, "host string, body string", list(_ROBOTS.items())), "leafmill")
    df = _in(spark, "host string, path string", [r[:2] for r in _ASKED]).join(rules, "host", "left")
    return df.select("host", "path", L.robots_allowed(F.col("path"), F.col("allow"), F.col("disallow")).alias("allowed"), F.coalesce("crawl_delay", F.lit(-1)).cast("bigint").alias("delay"))


_SITE = {"/": ["/a", "/b", "https://o.example/x"], "/a": ["/b", "/", "/c"], "/b": ["/d", "/a"], "/c": ["/e"], "/d": ["/"], "/e": [], "/alone": ["/"]}
_H = "https://h.example"


@query(rows("run string, url string, depth bigint", [("deep", _H + "/", 0), ("deep", _H + "/a", 1), ("deep", _H + "/b", 1), ("deep", _H + "/c", 2), ("deep", _H + "/d", 2), ("few", _H + "/", 0), ("few", _H + "/a", 1), ("few", _H + "/b", 1), ("queue", _H + "/", 0), ("queue", _H + "/a", 1), ("queue", _H + "/b", 2)]))
def crawl_cases(spark, path):
    edges = _in(spark, "src string, pos int, link string", [(_H + s, i, t if t.startswith("http") else _H + t) for s, ts in _SITE.items() for i, t in enumerate(ts)])
    pages = _in(spark, "url string", [(_H + u,) for u in _SITE])
    runs = {"deep": L.crawl(edges, pages, _H + "/", L.CrawlConfig(max_depth=2)), "few": L.crawl(edges, pages, _H + "/", L.CrawlConfig(max_depth=5, page_limit=3)), "queue": L.crawl(edges, pages, _H + "/", L.CrawlConfig(max_depth=2), queue=1)}
    out = None
    for name, df in runs.items():
        part = df.select(F.lit(name).alias("run"), "url", F.col("depth").cast("bigint").alias("depth"))
        out = part if out is None else out.unionByName(part)
    return out


_PROFILES = [("apiDocs", 3, 500, True, 4, 3), ("wiki", 4, 2000, True, 5, 3), ("blog", 2, 100, False, 4, 4), ("documentation", 3, 1000, True, 5, 2), ("custom", 2, 1000, True, 0, 0)]


@query(rows("profile string, depth bigint, pages bigint, robots boolean, selectors bigint, excludes bigint", _PROFILES))
def profile_cases(spark, path):
    made = [(p, c.max_depth, c.page_limit, c.respect_robots_txt, len(c.content_selectors), len(c.exclude_patterns)) for p, c in ((p, L.profile_config(p)) for p, *_ in _PROFILES)]
    return _in(spark, "profile string, depth bigint, pages bigint, robots boolean, selectors bigint, excludes bigint", made)


# --- sitemaps


def _urlset(*items):
    return "<?xml version='1.0'?><urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>" + "".join(items) + "</urlset>"


def _index(*subs):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{s}</loc></sitemap>" for s in subs) + "</sitemapindex>"


_BODIES = {
    "https://h.example/full.xml": _urlset("<url><loc>https://h.example/1</loc><lastmod>2024-01-02</lastmod><priority>0.8</priority></url>", "<url><loc><![CDATA[https://h.example/2?a=1&b=2]]></loc></url>").encode(),
    "https://h.example/cut.xml": b"<urlset><url><loc>https://h.example/3</loc></url><url><loc>https://h.ex",
    "https://h.example/root.xml": b"<rss></rss>",
    "https://h.example/bad.xml": b"not xml at all",
    "https://h.example/sub.xml.gz": gzip.compress(_urlset("<url><loc>https://h.example/4</loc></url>", "<url><loc>https://h.example/1</loc></url>").encode()),
    "https://h.example/plain.xml.gz": b"no gzip",
    "https://h.example/index.xml": _index("https://h.example/full.xml", "https://h.example/sub.xml.gz", "https://h.example/root.xml", "https://h.example/index.xml").encode(),
    "https://h.example/none.xml": None,
}


@query(rows("url string, kind string, entries bigint, subs bigint, failed boolean", [("https://h.example/full.xml", "urlset", 2, 0, False), ("https://h.example/cut.xml", "urlset", 1, 0, False), ("https://h.example/root.xml", "none", 0, 0, True), ("https://h.example/bad.xml", "none", 0, 0, True), ("https://h.example/sub.xml.gz", "urlset", 2, 0, False), ("https://h.example/plain.xml.gz", "none", 0, 0, True), ("https://h.example/index.xml", "index", 0, 4, False), ("https://h.example/none.xml", "none", 0, 0, True)]))
def sitemap_parse_cases(spark, path):
    p = _in(spark, "url string, body binary", list(_BODIES.items())).select("url", X.parse("url", "body").alias("p"))
    return p.select("url", F.coalesce("p.kind", F.lit("none")).alias("kind"), F.size("p.entries").cast("bigint").alias("entries"), F.size("p.subs").cast("bigint").alias("subs"), F.col("p.error").isNotNull().alias("failed"))


@query(rows("run string, url string, lastmod string, priority double, truncated boolean", [("all", "https://h.example/1", "2024-01-02", 0.8, False), ("all", "https://h.example/2?a=1&b=2", "none", -1.0, False), ("all", "https://h.example/4", "none", -1.0, False), ("two", "https://h.example/1", "2024-01-02", 0.8, True), ("two", "https://h.example/2?a=1&b=2", "none", -1.0, True)]))
def sitemap_expand_cases(spark, path):
    bodies = _in(spark, "url string, body binary", list(_BODIES.items()))
    show = lambda df, run: df.select(F.lit(run).alias("run"), "url", F.coalesce("lastmod", F.lit("none")).alias("lastmod"), F.round(F.coalesce(F.col("priority").cast("double"), F.lit(-1.0)), 3).alias("priority"), "truncated")
    return show(X.expand(bodies, ["https://h.example/index.xml"])[0], "all").unionByName(show(X.expand(bodies, ["https://h.example/index.xml"], urls=2)[0], "two"))


@query(rows("url string, depth bigint, failed boolean", [("https://h.example/index.xml", 0, False), ("https://h.example/full.xml", 1, False), ("https://h.example/sub.xml.gz", 1, False), ("https://h.example/root.xml", 1, True)]))
def sitemap_source_cases(spark, path):
    bodies = _in(spark, "url string, body binary", list(_BODIES.items()))
    return X.expand(bodies, ["https://h.example/index.xml"])[1].select("url", F.col("depth").cast("bigint").alias("depth"), F.col("error").isNotNull().alias("failed"))


@query(rows("host string, sitemap string, pos bigint", [("a.example", "https://a.example/map.xml", 1), ("a.example", "https://a.example/sitemap.xml", 2), ("b.example", "https://b.example/sitemap.xml", 1), ("b.example", "https://b.example/sitemap_index.xml", 2)]))
def sitemap_discover_cases(spark, path):
    robots = _in(spark, "host string, body string", [("a.example", "Sitemap: https://a.example/map.xml\nsitemap:https://a.example/sitemap.xml\nSitemap: https://a.example/map.xml"), ("b.example", "User-agent: *"), ("c.example", None)])
    there = _in(spark, "url string", [("https://a.example/sitemap.xml",), ("https://b.example/sitemap.xml",), ("https://b.example/sitemap_index.xml",)])
    return X.discover(robots, there).select("host", "sitemap", F.col("pos").cast("bigint").alias("pos"))


# --- jobs, batches, templates

_JOB = "id string, url string, status string, batch_id string, start_time string, end_time string"
_JOBS = [("j1", "https://pump.example", "completed", None, "2024-01-03", None), ("j2", "https://fan.example", "failed", "b1", "2024-01-02", None), ("j3", "https://fan.example/x", "completed", "b2", "2024-01-04", None), ("j4", None, "running", None, None, "2024-01-09")]
_BATCHES = [("b1", "Pumps", ["https://pump.example/1"], "completed", "2024-01-05", None), ("b2", "Fans", ["https://fan.example/2"], "failed", "2024-01-06", "2024-01-07"), ("b3", None, None, "queued", "2024-01-01", None)]
_BATCH = "id string, name string, urls array<string>, status string, created_at string, start_time string"


def _jobs(spark):
    return _in(spark, _JOB, _JOBS), _in(spark, _BATCH, _BATCHES)


@query(rows("run string, kind string, id string, children bigint", [("all", "job", "j4", 0), ("all", "batch", "b2", 1), ("all", "batch", "b1", 1), ("all", "job", "j1", 0), ("all", "batch", "b3", 0), ("failed", "batch", "b2", 0), ("failed", "batch", "b1", 1), ("batch", "batch", "b1", 1), ("batch", "batch", "b2", 1), ("batch", "batch", "b3", 0), ("pump", "job", "j1", 0), ("pump", "batch", "b1", 0), ("X", "batch", "b1", 1), ("X", "batch", "b2", 1), ("X", "job", "j1", 0)]))
def history_group_cases(spark, path):
    jobs, batches = _jobs(spark)
    runs = {"all": (None, ""), "failed": ("failed", ""), "batch": ("batch", ""), "pump": (None, "PUMP"), "X": (None, "X")}
    out = None
    for name, (status, text) in runs.items():
        part = J.history_groups(jobs, batches, status, text).select(F.lit(name).alias("run"), "kind", "id", "children")
        out = part if out is None else out.unionByName(part)
    return out


@query(rows("run string, id string", [("completed", "j1"), ("completed", "j3"), ("batch", "j2"), ("batch", "j3"), ("B2", "j3"), ("fan", "j2"), ("fan", "j3")]))
def history_job_cases(spark, path):
    jobs, _ = _jobs(spark)
    runs = {"completed": ("completed", ""), "batch": ("batch", ""), "B2": (None, "B2"), "fan": (None, "FAN")}
    out = None
    for name, (status, text) in runs.items():
        part = J.matching_jobs(jobs, status, text).select(F.lit(name).alias("run"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query(rows("pos bigint, id string, status string", [(1, "b2", "failed"), (2, "b1", "active"), (3, "b3", "queued")]))
def batch_list_cases(spark, path):
    _, batches = _jobs(spark)
    live = batches.where("id = 'b1'").withColumn("status", F.lit("active"))
    listed = J.list_batches(live, batches)
    return listed.select(F.row_number().over(Window.orderBy(F.desc("created_at"))).cast("bigint").alias("pos"), "id", "status")


@query(rows("kind string, id string", [("batch", "b2"), ("batch", "b3"), ("job", "j1"), ("job", "j3"), ("job", "j4")]))
def delete_batch_cases(spark, path):
    jobs, batches = _jobs(spark)
    left, rest = J.delete_cascade(batches, jobs, "b1")
    return left.select(F.lit("batch").alias("kind"), "id").unionByName(rest.select(F.lit("job").alias("kind"), "id"))


@query(rows("run string, url string", [("all", "u1"), ("all", "u2"), ("all", "u3"), ("text", "u2"), ("url", "u3"), ("marked", "u1"), ("marked", "u3"), ("both", "u3"), ("found", "u1")]))
def page_filter_cases(spark, path):
    pages = _in(spark, "url string, title string", [("u1", "Pumps"), ("u2", "Fans"), ("u3", None)])
    marks, hits = _in(spark, "url string", [("u1",), ("u3",), ("gone",)]), _in(spark, "url string", [("u1",), ("u9",), ("u1",)])
    runs = {"all": J.filter_pages(pages), "text": J.filter_pages(pages, "FAN"), "url": J.filter_pages(pages, "U3"), "marked": J.filter_pages(pages, bookmarks=marks), "both": J.filter_pages(pages, "u3", marks), "found": J.filter_pages(pages, "u", matches=hits)}
    out = None
    for name, df in runs.items():
        part = df.select(F.lit(name).alias("run"), "url")
        out = part if out is None else out.unionByName(part)
    return out


@query(rows("n bigint, error string", [(1, None), (2, "Template name must not be empty"), (3, "Template URL is invalid"), (4, "Template name must not be empty"), (5, "Template URL is invalid")]))
def template_check_cases(spark, path):
    df = _in(spark, "n bigint, name string, url string", [(1, " A ", "https://a.example"), (2, "  ", "https://a.example"), (3, "B", "no url"), (4, None, None), (5, "C", None)])
    return df.select("n", J.template_error(F.col("name"), F.col("url")).alias("error"))


@query(rows("id string, name string, url string", [("t1", "New", "https://n.example"), ("t2", "Kept", "https://k.example"), ("t3", "Third", "https://t.example")]))
def template_store_cases(spark, path):
    store = _in(spark, "id string, name string, url string", [("t1", "Old", "https://o.example"), ("t2", "Kept", "https://k.example"), ("t9", "Gone", "https://g.example")])
    new = _in(spark, "id string, name string, url string", [("t1", " New ", "https://n.example"), ("t3", "Third", "https://t.example"), ("t4", " ", "https://x.example"), ("t5", "Bad", "bad")])
    return sinks.store_remove(J.save_templates(store, new), ["t9"])


@query(rows("id string, v string", [("a", "new"), ("b", "old"), ("c", "new")]))
def store_cases(spark, path):
    store = _in(spark, "id string, v string", [("a", "old"), ("b", "old"), ("d", "old")])
    return sinks.store_remove(sinks.store_upsert(store, _in(spark, "id string, v string", [("a", "new"), ("c", "new")])), ["d", "none"])


@query(rows("id string, notes string", [("add", "k=v|u=text"), ("change", "k=v|u=text"), ("blank", "k=v"), ("null", "k=v"), ("empty", "u=text")]))
def annotation_cases(spark, path):
    df = _in(spark, "id string, notes map<string,string>, t string", [("add", {"k": "v"}, " text "), ("change", {"k": "v", "u": "old"}, "text"), ("blank", {"k": "v", "u": "old"}, "  "), ("null", {"k": "v", "u": "old"}, None), ("empty", None, "text")])
    return df.select("id", F.array_join(F.array_sort(F.transform(F.map_entries(J.annotate(F.col("notes"), F.lit("u"), F.col("t"))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|").alias("notes"))


@query("select id, coalesce(list_sum(list_transform(results, lambda r: coalesce(r.links_count, 0))), 0)::bigint as links from jobs")
def job_links(spark, path):
    return J.total_links(spark.read.parquet(f"{path}/jobs.parquet"))


@query("select id, left(id, 8) as short_id, r.url as url, coalesce(nullif(r.title, ''), r.url) as label from (select id, unnest(results) as r from jobs)")
def job_display(spark, path):
    return J.display(spark.read.parquet(f"{path}/jobs.parquet"))


@query("select distinct config.output_dir as output_dir from jobs where config.output_dir is not null")
def output_folders(spark, path):
    j = spark.read.parquet(f"{path}/jobs.parquet")
    return sinks.output_folders(j.where("lower(status) = 'running'"), j)


@query(rows("main string, zip string, formats string", [("out/h.example/main", "out/h.example/zip", "out/h.example/formats"), ("out/unknown/main", "out/unknown/zip", "out/unknown/formats")]))
def output_layout_cases(spark, path):
    df = _in(spark, "url string", [("https://H.example:8080/x",), ("no url",)])
    return df.select(sinks.layout(F.lit("out/"), F.col("url")).alias("l")).select("l.*")


@query(rows("bytes bigint, jobs bigint, pages bigint, fail double", [(30, 3, 3, 33.333333)]))
def dashboard_cases(spark, path):
    df = _in(spark, "id string, status string, start_time string, end_time string, results array<struct<url:string>>", [("a", "Failed", None, None, [("u",)]), ("b", "completed", None, None, [("u",), ("v",)]), ("c", "queued", None, None, None)])
    out = J.dashboard(df, "2024-01-01T00:00:00Z", _in(spark, "id string, bytes bigint", [("a", 10), ("b", 20)]))
    return out.select(F.col("total_size_bytes").alias("bytes"), "jobs", F.col("pages_saved").alias("pages"), F.round("fail_rate", 6).alias("fail"))


@query(rows("run string, id string", [("get", "j2")]))
def store_get_cases(spark, path):
    jobs, _ = _jobs(spark)
    return readers.get(jobs, "j2").unionByName(readers.get(jobs, "none")).select(F.lit("get").alias("run"), "id")


@query(rows("url string, content string", [("https://h.example/a", "A"), ("https://h.example/b/", ""), ("no url", "U")]))
def page_content_cases(spark, path):
    files = _in(spark, "host string, path string, content string", [("h.example", "a.md", "A"), ("o.example", "b/index.md", "B"), ("unknown", "unnamed.md", "U"), ("h.example", "c.md", "C")])
    return readers.with_content(_in(spark, "url string", [("https://h.example/a",), ("https://h.example/b/",), ("no url",)]), files)


@query("select url from sitemap_entries order by url nulls first limit 500")
def sitemap_shown(spark, path):
    return X.shown(spark.read.parquet(f"{path}/sitemap_entries.parquet")).select("url")


@query(rows("n bigint, path string", [(1, "a.html"), (2, "b.md"), (3, "x/c.md")]))
def page_lookup_cases(spark, path):
    files = _in(spark, "path string, content string", [("file:/out/x/c.md", "C"), ("file:/out/x/cc.md", "D"), ("file:/out/b.md", "B"), ("file:/out/a.html", "A")])
    out = None
    for n, p in ((1, "a.html"), (2, "b.md"), (3, "x/c.md")):
        part = readers.read_page(files, p).select(F.lit(n).cast("bigint").alias("n"), F.lit(p).alias("path"))
        out = part if out is None else out.unionByName(part)
    return out


# --- events

_PROGRESS = {"pages_crawled": 2, "page_limit": 10, "current_url": "https://h.example/a", "depth": 1, "max_depth": 3, "start_time": None}
_EVENT = "event_id bigint, event_type string, job_id string, batch_id string, status string, level string, message string, kind string, progress struct<pages_crawled:bigint,page_limit:bigint,current_url:string,depth:int,max_depth:int,start_time:string>, page struct<url:string,title:string,status:int,links_count:int>, current_index bigint, total bigint, current_job_id string"
_EVENTS = [
    ({"event_type": "progress", "job_id": "j", "progress": _PROGRESS}, "info", "Crawling https://h.example/a (depth 1/3)", '{"type":"progress","jobId":"j","progress":{"pagesCrawled":2,"pageLimit":10,"currentUrl":"https://h.example/a","depth":1,"maxDepth":3}}'),
    ({"event_type": "progress"}, "info", "Crawling ... (depth 0/0)", '{"type":"progress"}'),
    ({"event_type": "pageComplete", "page": {"url": "u", "title": "", "status": 200, "links_count": 4}}, "success", "Completed: u (no title)", '{"type":"pageComplete","page":{"url":"u","title":"","status":200,"linksCount":4}}'),
    ({"event_type": "error", "message": None, "kind": "disk"}, "error", "Error: Unknown error", '{"type":"error","kind":"disk"}'),
    ({"event_type": "log", "level": "warn", "message": "slow"}, "info", "slow", '{"type":"log","level":"warn","message":"slow"}'),
    ({"event_type": "jobStatusChanged", "status": "failed"}, "info", "Job status: failed", '{"type":"jobStatusChanged","status":"failed"}'),
    ({"event_type": "batchStatusChanged", "batch_id": "b", "status": None}, "info", "Batch status: ", '{"type":"batchStatusChanged","batchId":"b"}'),
    ({"event_type": "batchProgress", "current_index": 2, "total": 5, "current_job_id": "0123456789"}, "info", "Batch progress: 2/5 (child 01234567)", '{"type":"batchProgress","currentIndex":2,"total":5,"currentJobId":"0123456789"}'),
    ({"event_type": "other"}, "info", "Unknown event", '{"type":"other"}'),
]


def _events(spark):
    names = [c.split()[0] for c in _EVENT.split(", ")]
    return _in(spark, _EVENT, [tuple({"event_id": i, **e}.get(n) for n in names) for i, (e, *_) in enumerate(_EVENTS)])


@query(rows("event_id bigint, level string, line string", [(i, level, line) for i, (_, level, line, _) in enumerate(_EVENTS)]))
def event_log_cases(spark, path):
    return J.log_lines(_events(spark))


@query(rows("event_id bigint, json string", [(i, j) for i, (*_, j) in enumerate(_EVENTS)]))
def event_json_cases(spark, path):
    return E.to_json(_events(spark))


@query(rows("job_id string, event_id bigint", [("a", 3), ("a", 4), ("b", 9)]))
def persist_due_cases(spark, path):
    data = [("a", 1, 0.0), ("a", 2, 4.0), ("a", 3, 11.0), ("a", 4, 31.0), ("a", 5, 32.0), ("b", 7, 0.0), ("b", 8, 1.0), ("b", 9, 2.0), ("b", 10, 3.0)]
    df = _in(spark, "job_id string, event_id bigint, s double", data).withColumn("ts", F.timestamp_seconds("s"))
    a, b = df.where("job_id = 'a'"), df.where("job_id = 'b'")
    return J.persist_due(a).unionByName(J.persist_due(b, pages=3))
