import io
import zipfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.functions import html
from leafmill.operators import pagetext, sitemap
from leafmill.plans import shared
from leafmill.sources import readers, sinks


def test_ranks_of_hot_and_null_groups(spark):
    rows = [("hot", i * 7 % 1000, i % 13) for i in range(1000)] + [(None, i, 2) for i in range(30)] + [(f"g{i % 9}", i, None) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, k int, w int")
    w = Window.partitionBy("g").orderBy("k")
    want = {tuple(r) for r in df.select("g", "k", F.row_number().over(w) - 1).collect()}
    assert {(r["g"], r["k"], r["at"]) for r in shared.ranked(df, ["g"], ["k"], "at").collect()} == want
    before = F.coalesce(F.sum(F.coalesce("w", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    want = {tuple(r) for r in df.select("g", "k", before).collect()}
    assert {(r["g"], r["k"], r["at"]) for r in shared.ranked(df, ["g"], ["k"], "at", F.coalesce("w", F.lit(0))).collect()} == want
    assert [r["at"] for r in shared.ranked(df, [], ["k", "g", "w"], "at").orderBy("at").collect()] == list(range(len(rows)))
    assert shared.ranked(df.limit(0), ["g"], ["k"], "at").count() == 0


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return Context._jsc

            @staticmethod
            def getCheckpointDir():
                return Context._jsc

            @staticmethod
            def isDefined():
                return False

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Context

    with pytest.raises(RuntimeError):
        shared.folder(Session)


@pytest.mark.parametrize("size", [1, 40, 10_000])
def test_parts_make_up_the_whole(spark, size):
    files = spark.createDataFrame([(f"d{i % 3}/{i:02}.md", f"text {i} é" if i % 5 else None) for i in range(25)], "path string, content string")
    rows = sorted((r["path"].split("/"), r["content"] or "") for r in files.collect())
    parts = sinks.merged(files, [], size).orderBy("part").collect()
    assert "".join(r["content"] for r in parts) == sinks.SEPARATOR.join(c for _, c in rows) and (len(parts) > 5) == (size < 100)
    records = {r["path"]: r["json"] for r in sinks.json_records(files).collect()}
    whole = "".join(r["content"] for r in sinks.merged_json(files, size).orderBy("part").collect())
    assert whole == "[\n" + ",\n".join(records["/".join(k)] for k, _ in rows) + "\n]"


def test_merged_exports(spark, tmp_path):
    files = spark.createDataFrame([("b.md", "# B"), ("a/x.md", "A *b*")], "path string, content string")
    sinks.export(files, "merged_md", str(tmp_path), "job")
    sinks.export(files, "merged_html", str(tmp_path), "job")
    sinks.export(files, "merged_json", str(tmp_path), "job")
    assert (tmp_path / "job-merged.md").read_text() == "A *b*\n\n---\n\n# B"
    page = (tmp_path / "job-merged.html").read_text()
    assert page.startswith("<!DOCTYPE html>") and page.endswith("</body>\n</html>") and "<p>A <em>b</em></p>\n<hr />\n<h1>B</h1>" in page
    assert sorted(x.name for x in tmp_path.iterdir() if not x.name.startswith(".")) == ["job-merged.html", "job-merged.json", "job-merged.md"]
    (tmp_path / "main").mkdir()
    (tmp_path / "main/p.md").write_text("x")
    assert zipfile.ZipFile(sinks.export_job(str(tmp_path), "j1")).namelist() == ["p.md"]
    with pytest.raises(FileNotFoundError):
        sinks.export_job(str(tmp_path / "none"), "j1")


def test_deep_and_broken_html():
    deep = "<div>" * 100_000 + "<p>far <b>down</b></p>" + "</span>" * 100_000
    assert "far" in html.to_markdown(deep) and html.text_of(html.parse(deep)) == "far down"
    assert html.links("<ul><li>" * 5000 + "<a href='/x'>x</a>", "https://h.example/") == ["https://h.example/x"]
    assert html.page("<p>a<p>b", None) == (None, [], [], "a\n\nb") and html.page(None, None) == (None, [], [], None)
    assert html.page("<!", "https://h.example/")[1] == [] and html.preview_html(None) is None
    assert html.preview_html("a\0b [x](https://e.example/\"onclick=1)") == '<p>ab <a href="https://e.example/&quot;onclick=1" target="_blank" rel="noopener">x</a></p>'


def test_epub_images(spark):
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        z.writestr("o/c.opf", '<package><metadata><title>My Book</title></metadata><manifest><item id="i1" href="img/a.jpg" media-type="image/jpg"/><item id="i2" href="b.xyz" media-type="image/tiff"/><item id="c1" href="1.html" media-type="x"/></manifest><spine><itemref idref="c1"/></spine></package>')
        z.writestr("o/1.html", '<p><img src="a.jpg" alt="A"> and <img src="b.xyz"></p>')
        z.writestr("o/img/a.jpg", b"AA")
        z.writestr("o/b.xyz", b"BB")
    title, chapters = readers.epub_chapters(body.getvalue())
    assert title == "My Book" and chapters == [(0, "![A](images/My_Book_1.jpg) and ![](images/My_Book_2.bin)")]
    assert readers.epub_image_files(body.getvalue()) == [("images/My_Book_1.jpg", b"AA"), ("images/My_Book_2.bin", b"BB")]


def test_pages_numbered_anew_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(pagetext, "CHUNK", 4)
    df = spark.createDataFrame([(b, i, f"t{i}") for b in ("a", None) for i in range(0, 30, 3)], "book string, page_no int, text string")
    got = sorted((r["book"] or "", r["page_no"], r["text"]) for r in pagetext.renumber(df).collect())
    assert got == sorted((b, k, f"t{i}") for b in ("a", "") for k, i in enumerate(range(0, 30, 3)))


def test_files_of_a_folder(spark, tmp_path):
    pages = sinks.pages_out(spark.createDataFrame([("https://h.example/a", "A"), (None, "N"), ("https://o.example/b/", None)], "url string, content string"))
    sinks.write_pages(pages, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert {tuple(r) for r in back.select("host", "path", "content").collect()} == {("h.example", "a.md", "A"), ("unknown", "unnamed.md", "N"), ("o.example", "b/index.md", None)}
    (tmp_path / "s").mkdir()
    for i in range(4):
        (tmp_path / f"s/{i}.bin").write_bytes(b"x" * (i + 1))
    assert readers.folder_size(spark, str(tmp_path / "s")).first()["bytes"] == 10 and readers.folder_size(spark, str(tmp_path / "s"), 2).first()["bytes"] == 3


def test_fetches_are_tried_again(spark, tmp_path):
    script = {"ok": [(200, b"x")], "late": [(503, b""), (408, b""), (204, b"y")], "gone": [(404, b"z")], "down": [OSError("Connection refused")] * 9, "bad": [ValueError("no such scheme")]}

    def getter():
        left = {k: list(v) for k, v in script.items()}

        def get(url):
            got = left[url].pop(0)
            if isinstance(got, Exception):
                raise got
            return got

        return get

    waits = []
    assert readers.fetch_one(getter(), "ok", wait=waits.append) == (200, b"x", None, 1)
    assert readers.fetch_one(getter(), "late", wait=waits.append) == (204, b"y", None, 3) and waits == [1.0, 2.0]
    assert readers.fetch_one(getter(), "gone", wait=waits.append) == (404, None, "status 404", 1)
    assert readers.fetch_one(getter(), "down", wait=waits.append) == (None, None, "Connection refused", 4) and waits == [1.0, 2.0, 1.0, 2.0, 4.0]
    assert readers.fetch_one(getter(), "bad", wait=waits.append) == (None, None, "no such scheme", 1)
    urls = spark.createDataFrame([("https://h.example/a",), (None,), ("https://h.example/b",)], "url string")
    got = readers.fetch_pages(urls, lambda u: (200, u.encode()) if u.endswith("a") else (404, b""), wait=lambda s: None)
    assert sorted(tuple(r) for r in got.collect()) == [("https://h.example/a", 200, bytearray(b"https://h.example/a"), None, 1), ("https://h.example/b", 404, None, "status 404", 1)]


def test_assets_are_written_by_host(spark, tmp_path):
    df = spark.createDataFrame([("https://h.example/i/a.png", b"A"), ("nonsense", b"B"), ("https://h.example/../b.css", b"C")], "url string, body binary")
    got = {r["url"]: r["path"] for r in sinks.write_assets(df, str(tmp_path)).collect()}
    assert got == {"https://h.example/i/a.png": "h.example/i/a.png", "https://h.example/../b.css": "h.example/b.css"}
    assert (tmp_path / "h.example/i/a.png").read_bytes() == b"A" and (tmp_path / "h.example/b.css").read_bytes() == b"C"


def test_a_stopped_expansion_keeps_what_was_read(spark):
    bodies = spark.createDataFrame([("i", b"<sitemapindex><sitemap><loc>s</loc></sitemap></sitemapindex>"), ("s", b"<urlset><url><loc>u</loc></url></urlset>")], "url string, body binary")
    assert sitemap.expand(bodies, ["i"])[0].count() == 1
    entries, sources = sitemap.expand(bodies, ["i"], stop=lambda: True)
    assert entries.count() == 0 and [r["url"] for r in sources.collect()] == ["i"]
