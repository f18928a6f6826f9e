"""Functions and a table function of this engine for use in SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import html, url


class ParseSitemap:
    """Rows (kind, url, lastmod, priority) of one sitemap body."""

    def eval(self, body: bytes):
        from ..operators.sitemap import parse_body, unpack

        got = parse_body(unpack("", bytes(body) if body is not None else None))
        for e in got["entries"]:
            yield got["kind"], e["url"], e["lastmod"], e["priority"]
        for s in got["subs"]:
            yield got["kind"], s, None, None


def register(spark: SparkSession) -> None:
    """html_title, html_links, html_assets, html_to_md, md_to_html, html_content, resolve_url and the table function parse_sitemap."""
    for name, f in {"html_title": html.title_udf, "html_links": html.links_udf, "html_assets": html.assets_udf, "html_to_md": html.to_markdown_udf, "md_to_html": html.to_html_udf, "html_content": html.content_udf(), "resolve_url": url.resolve}.items():
        spark.udf.register(name, f)
    spark.udtf.register("parse_sitemap", udtf(ParseSitemap, returnType="kind string, url string, lastmod string, priority double"))
