from pyspark.sql import functions as F

from leafmill import settings
from leafmill.functions.register import register
from leafmill.operators import links, pipeline
from leafmill.streaming import events as E

HTML = "<html><head><title>One</title></head><body><main><h1>One</h1><p>A full sentence stands here, long enough to be content of the page and to be kept by the rules.</p><p><img src='/l.png' alt='L'> <a href='/b'>b</a></p><script>x()</script></main></body></html>"


def test_convert_with_assets(spark):
    p = spark.createDataFrame([(1, "https://h.com/a/", HTML), (2, "nonsense", None)], "page_id int, url string, html string")
    a = spark.createDataFrame([("https://h.com/l.png", "image/png"), ("https://h.com/x.html", "text/html")], "url string, content_type string")
    out = {r["page_id"]: r for r in pipeline.convert(pipeline.with_assets(p, a), links.CrawlConfig()).collect()}
    assert out[1]["title"] == "One" and out[1]["path"] == "a/index.md" and out[1]["links"] == 1
    assert "![L](assets/h.com/l.png)" in out[1]["markdown"] and "x()" not in out[1]["markdown"]
    assert out[2]["markdown"] is None and out[2]["host"] == "unknown"


def test_batches():
    def one(u):
        if "bad" in u:
            raise RuntimeError("no " + u)

    s = pipeline.run_batch(["a", "bad1", "bad2", "c"], one)
    assert s.status == "completed" and s.error == "2 child failures:\nno bad1\nno bad2" and len(s.children) == 4
    assert pipeline.run_batch(["bad", "c"], one, "stop").status == "failed"
    assert pipeline.run_batch(["a"], one, stop=lambda: True).status == "cancelled"


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("select resolve_url('https://h.com/d/', 'x'), html_to_md('<h1>T</h1>'), md_to_html('# T')").first()[:] == ("https://h.com/d/x", "# T", "<h1>T</h1>")
    rows = spark.sql("select * from parse_sitemap(cast('<urlset><url><loc>https://h/a</loc></url></urlset>' as binary))").collect()
    assert [(r["kind"], r["url"]) for r in rows] == [("urlset", "https://h/a")]


def test_settings(tmp_path):
    f = str(tmp_path / "s.json")
    assert settings.load(f) == settings.AppSettings()
    settings.save(f, settings.AppSettings(output_dir=" "), theme="dark")
    assert settings.load(f).theme == "dark" and settings.load(f).output_dir == "output"


def test_auto_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "completed"), (2, "a", "completed"), (3, "b", "running")], "event_id long, job_id string, status string").withColumn("ts", F.current_timestamp())
    df.write.parquet(str(tmp_path / "in"))
    got = []
    E.auto_export(E.read(spark, str(tmp_path / "in"), df.schema, 10), got.append, str(tmp_path / "c")).awaitTermination(60)
    assert got == ["a"]
