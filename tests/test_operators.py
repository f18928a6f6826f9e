import pytest
from pyspark.sql import functions as F

from leafmill.operators import jobs, links, markdown, pagetext, search, sitemap
from leafmill.sources import readers, sinks


def md(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def test_markdown_steps(spark):
    assert md(spark, "# A\nCopyPage OpenMarkdown EditPage\nkept Copy code here\nWe use cookies to x\nSubscribe to our newsletter\nCopy code", markdown.strip_ui) == "# A\nkept Copy code here"
    long = "x" * 90
    assert md(spark, "\n\n".join([long, "a", long, "b", "a", "c"]), markdown.dedup) == "\n\n".join([long, "a", "b", "a", "c"])
    toc = "* [a](#a)\n* [b](#b)\n* [c](#c)"
    assert md(spark, "\n\n".join(["1.", "2.", "3.", toc, "4.", "5."]), markdown.dedup) == "\n\n".join(["1.", "2.", "3.", "4.", "5."])
    assert md(spark, "\n\n".join([toc, "1."]), markdown.dedup) == "\n\n".join([toc, "1."])
    assert md(spark, "A full sentence stands here.\n\n## H\n\nText of some length that ends.\n\n## Next\n\n🔧 Tools", markdown.strip_trailing_stubs) == "A full sentence stands here.\n\n## H\n\nText of some length that ends."
    assert md(spark, "## A\n\n## B\n\n## C\n\n## D", markdown.strip_trailing_stubs) == "## A\n\n## B\n\n## C\n\n## D"
    assert md(spark, "a\n\n\n\nb", markdown.collapse_blank) == "a\n\nb"
    assert md(spark, "[Click]( ) ![Alt]()", markdown.clean) == "Click "
    assert md(spark, "![Alt]()", lambda c: markdown.clean(c, compat=True)) == "!Alt"
    t = lambda c: markdown.title(c, F.lit("stem"))
    assert [md(spark, x, t) for x in ("x\n# Hi \n", "Set\n====\n", "none", "")] == ["Hi", "Set", "stem", "stem"]
    assert md(spark, None, markdown.clean) is None and md(spark, "", markdown.clean) == ""


def book(spark, pages):
    return spark.createDataFrame([("b", i, t) for i, t in enumerate(pages)], "book string, page_no int, text string")


def cleaned(spark, pages, **kw):
    return [r["text"] for r in pagetext.clean_pages(book(spark, pages), **kw).orderBy("page_no").collect()]


def test_headers_and_footers(spark):
    out = cleaned(spark, [f"Pump Room Guide\nBody {c} one.\nmore {c}\npump.example/guide" for c in "abcde"])
    assert out == [f"Body {c} one.\nmore {c}" for c in "abcde"]
    kept = cleaned(spark, ["Pumps\nbody a\nx", "Pumps\nbody b\ny"])
    assert all("Pumps" in t for t in kept)
    assert all("Part" not in t for t in cleaned(spark, [f"Part {i} / Valves\ntext {c}\nend {c}" for i, c in enumerate("abcde")]))


def test_page_numbers(spark):
    assert cleaned(spark, ["Page 5\nbody one is here", "- 3 -\nbody two is here"]) == ["body one is here", "body two is here"]
    seq = [f"first {c}\nsecond {c}\nthird {c}\n{i + 1}\nfourth {c}\nfifth {c}\nsixth {c}" for i, c in enumerate("abcde")]
    assert all(str(i + 1) not in t.split("\n") for i, t in enumerate(cleaned(spark, seq, headers_footers=False)))


def test_footnotes_and_notices(spark):
    assert cleaned(spark, ["A claim[1] here\nand more[2]\n___\n1. note\n2. note"]) == ["A claim here\nand more"]
    body = "\n".join(["© Acme", *(f"line {c}" for c in "abcdefghij"), "All rights reserved"])
    out = cleaned(spark, [body])[0]
    assert "©" not in out and "reserved" not in out
    inner = "\n".join([*(f"line {c}" for c in "abcdef"), "the © sign", *(f"line {c}" for c in "ghijkl")])
    assert "©" in cleaned(spark, [inner])[0]


def test_empty_pages_go(spark):
    assert cleaned(spark, ["", None, "  \n ", "text stays here"]) == ["text stays here"]
    assert cleaned(spark, []) == []


ROBOTS = "User-agent: a\nDisallow: /\n# c\nUser-agent: *\nDisallow: /p/\nAllow: /p/open\nCrawl-delay: 4.2\nDisallow:\nSitemap: https://h/s.xml\n"


def test_robots(spark):
    r = spark.createDataFrame([("h", ROBOTS), ("g", None)], "host string, body string")
    rule = links.robots_rules(r, "other").first()
    assert rule["disallow"] == ["/p/"] and rule["allow"] == ["/p/open"] and rule["crawl_delay"] == 5
    assert links.robots_rules(r, "A").first()["disallow"] == ["/"]
    df = spark.createDataFrame([("/p/x",), ("/p/open/1",), ("/q",)], "p string")
    got = df.select(links.robots_allowed(F.col("p"), F.array(F.lit("/p/open")), F.array(F.lit("/p/")))).collect()
    assert [x[0] for x in got] == [False, True, True]
    assert [x["sitemap"] for x in sitemap.from_robots(r).collect()] == ["https://h/s.xml"]


def test_admission_and_config(spark):
    df = spark.createDataFrame([("https://h.com/docs/a",), ("https://h.com/login",), ("https://sub.h.com/docs/a",), ("http://10.0.0.1/docs",), (None,), ("mailto:x",)], "link string")
    got = [r["link"] for r in links.admit(df, links.CrawlConfig(exclude_patterns=["login"], path_prefix="docs/"), "h.com").collect()]
    assert got == ["https://h.com/docs/a"]
    for bad in (links.CrawlConfig(max_depth=0), links.CrawlConfig(include_patterns=["["]), links.CrawlConfig(headless_strategy="")):
        with pytest.raises(ValueError):
            bad.check()
    assert links.profile_config("wiki").max_depth == 4


def test_crawl(spark):
    h = "https://h.com/"
    edges = spark.createDataFrame([(h, 0, h + "a"), (h, 1, h + "b"), (h + "a", 0, h), (h + "a", 1, h + "c"), (h + "b", 0, h + "c"), (h + "c", 0, h + "d"), (h, 2, "https://other.com/"), (h + "b", 1, h + "missing")], "src string, pos int, link string")
    pages = spark.createDataFrame([(h,), (h + "a",), (h + "b",), (h + "c",), (h + "d",), ("https://other.com/",)], "url string")
    got = [(r["url"], r["depth"]) for r in links.crawl(edges, pages, h, links.CrawlConfig(max_depth=2)).collect()]
    assert got == [(h, 0), (h + "a", 1), (h + "b", 1), (h + "c", 2)]
    assert links.crawl(edges, pages, h, links.CrawlConfig(max_depth=2, page_limit=2)).count() == 2


def test_search(spark):
    p = spark.createDataFrame([(1, "https://h/key", "Key key", "a key"), (2, "u", None, None), (3, "u", "t", "key key")], "page_id int, url string, title string, content string")
    got = [(r["page_id"], r["relevance"]) for r in search.search(p, "KEY").collect()]
    assert got == [(1, 26), (3, 2)]
    with pytest.raises(ValueError):
        search.search(p, " ")


def test_sitemaps(spark):
    ok = b'<?xml version="1.0"?><urlset xmlns="x"><url><loc><![CDATA[https://h/a?x&y]]></loc><lastmod>2024</lastmod><priority>0.8</priority></url><url><loc>https://h/b</loc></url><url><loc> </loc></url></urlset>'
    idx = b"<sitemapindex><sitemap><loc>https://h/s.xml</loc></sitemap></sitemapindex>"
    cut = b"<urlset><url><loc>https://h/a</loc></url><url><loc>https"
    one = sitemap.parse_body(ok)
    assert [e["url"] for e in one["entries"]] == ["https://h/a?x&y", "https://h/b"] and abs(one["entries"][0]["priority"] - 0.8) < 1e-9
    assert sitemap.parse_body(idx)["subs"] == ["https://h/s.xml"] and len(sitemap.parse_body(cut)["entries"]) == 1
    assert sitemap.parse_body(b"<html></html>")["error"] and sitemap.parse_body(b"no xml")["error"] and sitemap.parse_body(None)["error"]
    import gzip

    assert sitemap.unpack("x", gzip.compress(ok)) == ok and sitemap.unpack("x", gzip.compress(b"0" * 1000), 100) is None
    df = spark.createDataFrame([("https://h/i.xml", idx), ("https://h/s.xml", ok)], "url string, body binary")
    entries, sources = sitemap.expand(df, ["https://h/i.xml"])
    assert entries.count() == 2 and {r["url"]: r["depth"] for r in sources.collect()} == {"https://h/i.xml": 0, "https://h/s.xml": 1}


def test_jobs(spark):
    df = spark.createDataFrame([("completed", 30, "2024-01-01T00:00:00Z", "2024-01-01T00:10:00Z"), ("completed", 30, "bad", None), ("running", 60, "2024-01-01T00:00:00+00:00", None)], "s string, n int, a string, z string")
    got = [r[0] for r in df.select(jobs.velocity(F.col("s"), F.col("n"), F.col("a"), F.col("z"), F.lit("2024-01-01T00:01:00Z"))).collect()]
    assert got == [3.0, 0.0, 60.0]
    one = spark.range(1)
    arr = F.array(F.lit("a"), F.lit("b"))
    assert one.select(jobs.toggle(arr, F.lit("a")), jobs.toggle(arr, F.lit("c"))).first()[:] == (["b"], ["a", "b", "c"])
    m = F.create_map(F.lit("u"), F.lit("old"))
    assert one.select(jobs.annotate(m, F.lit("u"), F.lit(" new ")), jobs.annotate(m, F.lit("u"), F.lit("  "))).first()[:] == ({"u": "new"}, {})
    tree = {r["path"]: (r["depth"], r["pages"], r["page"]) for r in jobs.site_tree(spark.createDataFrame([(1, "https://h.com/a/b"), (2, "https://h.com/a/b"), (3, "odd"), (4, None)], "page_id int, url string")).collect()}
    assert tree == {"h.com": (1, 2, None), "h.com/a": (2, 2, None), "h.com/a/b": (3, 2, 2), "odd": (1, 1, 3)}


def test_exports(spark, tmp_path):
    files = spark.createDataFrame([("b.md", "# B\n\ntext"), ("a/x.md", "A")], "path string, content string")
    assert sinks.merged(files, []).first()["content"] == "A\n\n---\n\n# B\n\ntext"
    assert {r["json"] for r in sinks.json_records(files).collect()} == {'{"content":"# B\\n\\ntext","source":"b.md","title":"B"}', '{"content":"A","source":"a/x.md","title":"x"}'}
    for kind in ("md_files", "json_files", "html_files", "merged_md", "merged_json", "merged_html"):
        sinks.export(files, kind, str(tmp_path / kind), "job")
    assert (tmp_path / "md_files/a/x.md").read_text() == "A" and "<h1>B</h1>" in (tmp_path / "html_files/b.html").read_text()
    with pytest.raises(NotImplementedError):
        sinks.export(files, "pdf_files", str(tmp_path))
    sinks.zip_folder(str(tmp_path / "md_files"), str(tmp_path / "x.zip"))
    assert readers.archives(spark, str(tmp_path)).first()["job_id"] == "x"
    assert readers.markdown_files(spark, str(tmp_path / "md_files")).count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "jobs").mkdir()
    (tmp_path / "jobs/a.json").write_text('{"id": "a", "url": "u"}')
    (tmp_path / "jobs/bad.json").write_text("{oops")
    assert [r["id"] for r in readers.json_store(spark, str(tmp_path / "jobs"), readers.JOB).collect()] == ["a"]
    import zipfile

    (tmp_path / "books").mkdir()
    with zipfile.ZipFile(tmp_path / "books/b.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        z.writestr("o/c.opf", '<package><metadata><title>Book</title></metadata><manifest><item id="c1" href="1.html" media-type="x"/></manifest><spine><itemref idref="c1"/></spine></package>')
        z.writestr("o/1.html", "<h1>One</h1><p>Text</p>")
    (tmp_path / "books/p.txt").write_text("page one\fpage two")
    (tmp_path / "books/x.doc").write_text("?")
    rows = {(r["path"].rsplit("/", 1)[1], r["page_no"]): (r["text"], r["error"]) for r in readers.import_files(spark, str(tmp_path / "books")).collect()}
    assert rows[("b.epub", 0)] == ("# One\n\nText", None) and rows[("p.txt", 1)] == ("page two", None) and rows[("x.doc", None)][1]
