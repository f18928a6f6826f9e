from pyspark.sql import functions as F

from leafmill.functions import html, safety
from leafmill.functions import text as T
from leafmill.functions import url as U


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first()


def many(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


def test_page_and_asset_paths(spark):
    urls = ["https://e.com/docs/guide", "https://e.com/", "https://e.com/page.html", "https://e.com/a/b/", "https://e.com/a?q=1#f", "https://e.com/../../etc/x", "https://e.com/v1.2", "https://e.com/.x", "nonsense", None, ""]
    assert many(spark, urls, U.page_path) == ["docs/guide.md", "index.md", "page.md", "a/b/index.md", "a.md", "etc/x.md", "v1.md", "unnamed.md", None, None, None]
    assert many(spark, ["https://e.com/i/l.png?x", "https://e.com", None], U.asset_path) == ["e.com/i/l.png", "e.com/index.asset", None]


def test_validity_hosts_and_prefix(spark):
    assert many(spark, ["https://a.b/c", "http://a.b", "ftp://a.b", "a.b", None, "https://"], U.is_valid_url) == [True, True, False, False, False, False]
    assert many(spark, ["https://u:p@A.B:80/c", None], U.host) == ["a.b", None]
    assert many(spark, [" docs/x?y ", "/", "", None], U.path_prefix) == ["/docs/x", "/", None, None]


def test_resolution():
    base = "https://example.com/docs/"
    assert [U.resolve_one(base, h) for h in ("/about", "https://external.com", "page2.html", "../x/./y", None)] == ["https://example.com/about", "https://external.com/", "https://example.com/docs/page2.html", "https://example.com/x/y", None]
    assert U.resolve_one(None, "rel") is None and U.resolve_one("https://a.b", "http://[bad") is None


def test_private_addresses(spark):
    bad = ["http://localhost/", "http://127.0.0.1", "http://10.0.0.1:8080/x", "http://172.16.0.1", "http://172.31.255.1", "http://192.168.1.1", "http://169.254.169.254", "http://0.0.0.0", "http://[::1]/", "http://p.local", "nonsense", "file:///etc/passwd", "http://[fe80::1]/", "http://[fd00::1]/", None]
    good = ["https://example.com", "http://8.8.8.8", "http://172.32.0.1", "http://172.15.0.1"]
    assert many(spark, bad, safety.is_private) == [True] * len(bad)
    assert many(spark, good, safety.is_private) == [False] * len(good)


def test_mime_status_and_error_texts(spark):
    assert many(spark, ["image/png", "text/html; charset=x", "application/json", "text/css", "", None, "application/zip", "application/xhtml+xml"], safety.is_allowed_mime) == [True, False, True, True, True, True, False, False]
    assert many(spark, [500, 503, 408, 404, 200, None], safety.is_transient_status, "int") == [True, True, True, False, False, False]
    assert many(spark, ["No space left", "os error 5", "fine", None], safety.is_disk_error) == [True, True, False, False]
    assert many(spark, ["operation timed out", "DNS failure", "fine"], safety.is_transient_error) == [True, True, False]


def test_text_helpers(spark):
    nb = " "
    assert many(spark, [f"{nb} a {nb}\n", "", None], T.ws_trim) == ["a", "", None]
    assert many(spark, ["a\r\nb\n", "", "x", None], T.lines) == [["a", "b"], [], ["x"], None]
    assert many(spark, ["  Chapter 12 -  Guide "], T.signature) == ["chapter - guide"]
    assert many(spark, ["aXxA", None], lambda c: T.occurrences(c, "x")) == [2, 0]
    assert many(spark, ["b" * 100 + "KEY" + "c" * 200], lambda c: T.preview(c, "key")) == ["…" + "b" * 80 + "KEY" + "c" * 120 + "…"]
    assert many(spark, [0, 512, 2048, 150 * 1024, 5 * 1024**2], T.format_bytes, "bigint") == ["0 B", "512 B", "2.0 KB", "150 KB", "5.0 MB"]
    assert many(spark, [3661], T.format_uptime, "bigint") == ["01:01:01"]


PAGE = """<html><head><title> Test &amp; Page </title><link rel='stylesheet' href='/s.css'><script src="/a.js"></script><style>p{}</style></head>
<body><nav><a href="/nav">n</a></nav><main id="content"><h1>Head</h1><p>One <b>bold</b> <a href="/about">about</a><p>Two<ul><li>x<li>y</ul><pre><code class="language-py">a = 1
</code></pre><img src="/images/logo.png" alt="L"><table><tr><th>A</th></tr><tr><td>1</td></tr></table><!-- gone --></main></body></html>"""


def test_html_tree():
    assert html.title(PAGE) == "Test & Page" and html.title("<p>x") is None and html.title(None) is None
    assert html.links(PAGE, "https://e.com/docs/") == ["https://e.com/nav", "https://e.com/about"]
    assert html.assets(PAGE, "https://e.com/") == ["https://e.com/images/logo.png", "https://e.com/s.css", "https://e.com/a.js"]
    assert html.selected(PAGE, ["main#content h1"]) == "Head" and html.selected(PAGE, ["div.none"]) is None and html.selected(PAGE, ["[[", "h1"]) == "Head"
    assert html.content(PAGE).startswith("<h1>Head") and html.content("<p>a</p>") == "<p>a</p>"
    out = html.rewrite_assets(PAGE, "https://e.com/", {"https://e.com/images/logo.png": "assets/e.com/images/logo.png"})
    assert 'src="assets/e.com/images/logo.png"' in out and 'src="/a.js"' in out


def test_markdown_both_ways():
    md = html.to_markdown(PAGE)
    assert "# Head" in md and "One **bold** [about](/about)" in md and "* x\n* y" in md and "```py\na = 1\n```" in md and "| A |" in md and "gone" not in md and "p{}" not in md
    assert html.to_markdown("") == "" and html.to_markdown(None) is None and html.to_markdown("<a href=\"/x\"> </a>") == ""
    h = html.to_html("# T\n\nText `a<b` **b**\n\n- x\n- y\n\nSet\n===\n\n| a |\n|---|\n| 1 |\n\n```\n<x>\n```\n\n> q")
    for part in ("<h1>T</h1>", "<code>a&lt;b</code>", "<strong>b</strong>", "<li>x</li>", "<h1>Set</h1>", "<td>1</td>", "&lt;x&gt;", "<blockquote>"):
        assert part in h
    assert html.to_html(None) is None and html.to_html("") == ""
